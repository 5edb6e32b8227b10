"""Tries of conversations, chat formatting and whitening, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import chat, conversations, registry, trie, whitening

SCHEMA = "conv_id long, turn int, role string, text string, depth int, key string, n int, node long"
TRICKY = r"\### Assistant: </turn> ok"


def rows_of(convs):
    return [(c, t, role, text, 1, "k", 2, 3) for c, turns in convs.items() for t, (role, text) in turns]


def awkward():
    """Copies, shared beginnings, one long conversation twice, a turn twice, nulls, empty and long texts."""
    r = random.Random(2)
    said = [("user", "hi"), ("assistant", ""), (None, "x"), ("user", None), ("system", "é" * 30), ("a:b\n", TRICKY), ("user", "long " * 40_000)]
    convs = {c: [(t, r.choice(said[: 3 + c % 5])) for t in range(r.randint(0, 9))] for c in range(-9, 60)}
    convs |= {100 + c: convs[17] for c in range(0, 200, 7)}
    long = [(t, r.choice(said[:5])) for t in range(90)]
    convs |= {1000: long, 1001: long, 1005: long[:14], 1010: [*long[:14], (14, ("user", "else"))]}
    convs |= {2000: [(None, ("user", "first")), (3, ("user", "b")), (3, ("user", "b")), (3, ("user", "a")), (2, ("assistant", "c"))]}
    return {c: turns for c, turns in convs.items() if turns}


def in_order(turns):
    known = [(t is not None, t or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or "") for t, (role, text) in turns]
    return [(role, text) for _, _, role, _, text in sorted(known)]


def expected_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    ends = {}
    for c, turns in convs.items():
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = saved.get(path, 0) + own
        leaves[path] = leaves.get(path, 0) or 1
        if path:
            for found, n in ((kids, 1), (leaves, leaves[path]), (saved, saved[path])):
                found[path[:-1]] = found.get(path[:-1], 0) + n
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in nodes.items())


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([*rows_of(awkward()), (None, 1, "user", "nobody's", 1, "k", 2, 3)], SCHEMA)


def plain(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[0]))


def by_depth(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


def test_trie_of_rebuilt_conversations(table):
    convs = {c: in_order(turns) for c, turns in awkward().items()}
    base = lambda c: c - (c % 5 if c >= 0 else -(-c % 5))
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    rebuilt = {c: convs.get(base(c), [])[: heads[c]] + convs[c][heads[c] :] for c in convs}
    assert any(not t for t in rebuilt.values())
    assert plain(trie.trie(*conversations.with_shared_heads(conversations.placed_turns(table)))) == by_depth(expected_trie(rebuilt))


def test_trie_of_conversations_as_they_are(table):
    """Fourteen shared turns of different conversations are fourteen levels; copies of ninety are none."""
    convs = {c: in_order(turns) for c, turns in awkward().items()}
    placed = conversations.placed_turns(table)
    assert plain(trie.trie(placed, placed.select("conv_id").distinct())) == by_depth(expected_trie(convs))


def test_small_tries(spark, table):
    placed = conversations.placed_turns(table)
    assert trie.trie(*conversations.with_shared_heads(conversations.placed_turns(table.limit(0)))).count() == 0
    alone = trie.trie(placed.where("conv_id = 1000"), spark.createDataFrame([(1000,)], "conv_id long"))
    assert plain(alone) == by_depth(expected_trie({1000: in_order(awkward()[1000])}))
    silent = trie.trie(placed.where("false"), spark.createDataFrame([(5,), (3,)], "conv_id long")).collect()
    assert [tuple(r) for r in silent] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_chat_round_trip(table):
    found = {r["conv_id"]: r for r in chat.formatted(table).collect()}
    digests = {r["conv_id"]: r for r in chat.digests(chat.formatted(table)).collect()}
    convs = {c: in_order(turns) for c, turns in awkward().items()}
    assert set(found) == set(digests) == set(convs)
    for c, turns in convs.items():
        whole, spans = found[c]["formatted"], found[c]["spans"]
        assert found[c]["rewritten_at"] is None and "".join(whole[s["start"] : s["end"]] for s in spans) == whole
        assert [chat.read(whole[s["start"] : s["end"]]) for s in spans] == turns
        assert [chat.unescape(whole[s["text_start"] : s["text_end"]]) for s in spans] == [t for _, t in turns]
        masked = "".join(text for role, text in turns if role == "assistant")
        d = digests[c]
        assert (d["n_turns"], d["loss_chars"], d["formatted_chars"]) == (len(turns), len(masked), len(whole))
        assert d["loss_sha256"] == hashlib.sha256(masked.encode()).hexdigest()
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert chat.formatted(table.limit(0)).count() == 0 and chat.digests(chat.formatted(table.limit(0))).count() == 0


def test_control_strings_do_not_survive():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(["#", "\\", "</turn>", "/", "<", "turn>", "\n", "a", "### user: "]) for _ in range(r.randint(0, 12)))
        shown = chat.escape(text)
        assert chat.unescape(shown) == text and "###" not in shown and "</turn>" not in shown
        assert chat.read(chat.render([(text, text)])) == (text, text)


def without_old_thoughts(turns):
    """Only the last turn keeps what it thought."""
    return "".join(f"<{r}>{t if i == len(turns) - 1 else t.partition('|')[2] or t}</{r}>" for i, (r, t) in enumerate(turns))


def test_templates_of_others():
    plain_text = lambda x: x
    rewriting = chat.Template(without_old_thoughts, plain_text, lambda part: ("", part))
    turns = [("user", "q"), ("assistant", "think|say"), ("user", "more"), ("assistant", "x")]
    whole, spans, at = chat.spans(turns, rewriting, frozenset({"assistant"}))
    assert (whole, spans, at) == (without_old_thoughts(turns), [], 2)
    assert chat.spans(turns[:2], rewriting, frozenset({"assistant"}))[2] is None
    # a text that begins as the end mark does, one that is trimmed, and a template that says how long a text is
    tricky = [("user", "</u"), ("assistant", "</a"), ("assistant", "")]
    whole, spans, _ = chat.spans(tricky, rewriting, frozenset({"assistant"}))
    assert [whole[s["text_start"] : s["text_end"]] for s in spans] == ["</u", "</a", ""] and [s["loss"] for s in spans] == [False, True, True]
    trimming = chat.Template(lambda ts: "".join(f"[{t.strip()}]" for _, t in ts), plain_text, lambda part: ("", part))
    assert [s["loss"] for s in chat.spans([("assistant", " a "), ("assistant", "b")], trimming, frozenset({"assistant"}))[1]] == [False, True]


@pytest.mark.parametrize("spread", [1, 300])
def test_whitening(spark, spread):
    r = np.random.default_rng(5)
    good = (r.normal(0, spread, (400, 12)) @ r.normal(0, 1, (12, 12)) + 3).tolist()
    rows = [*enumerate(good), (7, good[0]), (None, good[1]), (900, None), (901, []), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [None] + [1.0] * 11), (905, [1.0, 2.0])]
    found = whitening.whitened(spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, component int, whitened double")).collect()
    kept = [(i, v) for i, v in rows[:402]]
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    apart = np.array(x, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    order = np.argsort(values)[::-1][:8]
    white = apart @ vectors[:, order] / np.sqrt(values[order])
    assert len(found) == 8 * n and {f["n"] for f in found} == {n} and max(f["identity_error"] for f in found) < 1e-9
    least = (1 << 63) - 1
    assert sorted((str(i), e) for (i, _), e in zip(kept, exact) if e <= least) == sorted((str(f["vec_id"]), f["deviation"]) for f in found if f["component"] == 1 and f["deviation"] is not None)
    for k in range(8):
        mine = {str(f["vec_id"]): f["whitened"] for f in found if f["component"] == k + 1 and f["vec_id"] != 7}
        theirs = {str(i): white[j, k] for j, (i, _) in enumerate(kept) if i != 7}
        sign = np.sign(mine["0"] * theirs["0"])
        assert all(abs(mine[i] - sign * theirs[i]) < 1e-6 for i in theirs)
        assert all(abs(f["explained"] - values[order[k]] / values.sum()) < 1e-9 for f in found if f["component"] == k + 1)


def test_whitening_without_variance(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened(table([])).count() == whitening.whitened(table([(1, None)])).count() == whitening.whitened(table([(1, [1.0, 2.0])] * 5)).count() == 0
    flat = whitening.whitened(table([(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])).collect()
    assert {f["component"] for f in flat} == {1} and len(flat) == 20 and abs(flat[0]["explained"] - 1) < 1e-12 and flat[0]["identity_error"] < 1e-9
    huge = whitening.whitened(spark.createDataFrame([(i, [1e300 * i, -1e9 * i]) for i in range(3)], "vec_id long, embedding array<double>")).collect()
    assert len({f["vec_id"] for f in huge}) == 3 and all(f["deviation"] is None for f in huge if f["component"] == 1 and f["vec_id"] == 0)


def test_queries_over_clashing_names(spark):
    assert {"op11_prefix_trie", "op12_chat_format", "op13_whitening"} <= set(registry.QUERIES)
    found = chat.digests(chat.formatted(spark.createDataFrame([(1, None, None, None, 4, "s", 2, 3)], SCHEMA))).collect()
    assert [tuple(r)[:4] for r in found] == [(1, 1, hashlib.sha256(b"\n\n").hexdigest(), 0)]
