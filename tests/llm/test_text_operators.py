"""The operators over documents, on small tables with awkward rows, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, minhash, mixing, quality, substrings, suffixes

WORDS = [f"w{i}" for i in range(400)]
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component string"


def prose(random_, n):
    return " ".join(random_.choice(WORDS) for _ in range(n))


def awkward_rows():
    """Copies, near copies, shared passages, runs of one word, nulls, empty and long texts, repeated rows."""
    r = random.Random(3)
    base, passage = prose(r, 300), prose(r, 120)
    texts = [base, base, base + " tail", None, "", "  \t\n ", "one two", "one two", "é" * 700, "é" * 500 + " x", "a " * 400, "b a " * 300]
    texts += [prose(r, 80) + " " + passage + " " + prose(r, 90) for _ in range(6)]
    words = base.split()
    texts += [" ".join(w if i % 71 else "other" for i, w in enumerate(words)), " ".join(w if i % 9 else "other" for i, w in enumerate(words))]
    texts += [prose(r, 3000) + "\n\n" + passage, prose(r, 5) + " " + " ".join(passage.split()[:60]), " nb sp " * 30, "日本語のテキスト" * 80, "日本語のテキスト" * 80 + "。"]
    rows = [(i, x, ("en", "fr", None)[i % 3], ("s1", None, "s2", "s1")[i % 4], len(x or ""), 0.5, "x") for i, x in enumerate(texts)]
    return [*rows, rows[0], (None, base, "en", "s1", 1, None, None), (7, prose(r, 60), None, "s9", 2, 0.1, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is not None, v) for v in x)


def test_passages(docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = [(1 << 62 if i is None else i, SPACE.findall((x or "").encode())) for i, x in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, i), i)
    expected = []
    for (i, _), (at, w) in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < at:
                gone.update(range(k, k + 50))
        rest = b" ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(rest).hexdigest()))
    found = substrings.deduplicated(docs).select("id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert substrings.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("group", [256, 1])
def test_repeats(docs, nothing, group):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = {}
    for _, raw in rows:
        for k in range(len(raw) - 399):
            seen[raw[k : k + 400]] = seen.get(raw[k : k + 400], 0) + 1
    expected = []
    for i, raw in rows:
        gone = bytearray(len(raw))
        for k in range(len(raw) - 399):
            if seen[raw[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        expected.append((i, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    found = suffixes.deduplicated(docs, group=group).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert suffixes.deduplicated(nothing).count() == 0


@pytest.mark.parametrize(("window", "group"), [(400, 256), (256, 256), (128, 1)])
def test_repeats_but_the_first(docs, window, group):
    rows = [(1 << 62 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    first = {}
    for i, raw in rows:
        for k in range(len(raw) - window + 1):
            g = raw[k : k + window]
            first[g] = min(first.get(g, (i, k)), (i, k))
    expected = []
    for i, raw in rows:
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if first[raw[k : k + window]] < (i, k):
                gone[k : k + window] = b"\1" * window
        expected.append((None if i == 1 << 62 else i, sum(gone), hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    found = suffixes.deduplicated(docs, window=window, group=group, keep_first=True).select("id", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_repeats_cut_texts(docs):
    cut = suffixes.trimmed_documents(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("doc_id = 1").first()["text"] == ""
    assert cut.where("doc_id = 6").first()["text"] == "one two"


@pytest.mark.parametrize("size", [1, 3, 40])
def test_interval_expansion(size):
    r = random.Random(size)
    segments = [bytes(r.choice(b"ab") for _ in range(r.randint(20, 60))) for _ in range(size)]
    segments += [segments[0], segments[0][5:] + b"zz", b"a" * 70, b"\0" * 40]
    at, places = 0, {}
    for s in segments:
        for k in range(len(s) - 15):
            places.setdefault(s[k : k + 16], []).append(at + k)
        at += len(s) + 1
    expected = {p for found in places.values() if len(found) > 1 for p in found}
    assert set(suffixes.repeated(segments, 16, 4).nonzero()[0].tolist()) == expected


def longest_match(a, b):
    """Words of a and b that an alignment matches, by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def near_classes(rows):
    """Classes by the share of the longer text's words that the two have in common, in order."""
    texts = [(i, SPACE.findall((t or "").encode())) for i, t in rows]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(texts):
        for b, (_, y) in enumerate(texts[:a]):
            need = 0.8 * max(len(x), len(y))
            if x and y and min(len(x), len(y)) >= need and len(set(x) & set(y)) > 1 and longest_match(x, y) >= need:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, least[find(k)]) for k, (i, _) in enumerate(texts)]


@pytest.mark.parametrize("seed", range(40))
def test_matches(seed):
    r = random.Random(seed)
    a = [r.randint(0, r.choice((3, 50))) for _ in range(r.randint(1, 60))]
    b = [x for x in a if r.random() > 0.15]
    for _ in range(r.randint(0, 9)):
        b.insert(r.randint(0, len(b)), r.randint(0, 50))
    most = longest_match(a, b)
    for need in range(max(len(a), len(b)) + 2):
        assert minhash.matches(np.array(a), np.array(b, dtype=np.int64), need) == (need <= most)


def test_near_copies(docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    found = [(r["id"], r["component_id"]) for r in minhash.near_duplicates(docs, block=2).where("id is not null").collect()]
    # both texts with id 7 are one node
    assert sorted(x for x in found if x[0] != 7) == sorted(x for x in near_classes(rows) if x[0] != 7)
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.where("text is not null and doc_id in (0, 1, 2)").count() == 1 and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id in (3, 4, 5)").count() == 3


def test_different_texts_of_one_id_are_apart(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    found = [(r["id"], r["component_id"]) for r in minhash.near_duplicates(docs, block=2).where("id is not null").collect()]
    assert sorted(found) == sorted(near_classes(rows))


def test_different_texts_of_one_id_keep_their_own_classes(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    few = spark.createDataFrame([(9, one), (9, two), (4, one + " end"), (12, two + " end"), (12, one + " stop")], "doc_id long, text string")
    found = {(r["id"], r["text_key"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(few).collect()}
    key = lambda i, t: (i, hashlib.sha256(t.encode()).hexdigest())
    assert found == {key(9, one): (4, False), key(9, two): (9, True), key(4, one + " end"): (4, True), key(12, two + " end"): (9, False), key(12, one + " stop"): (4, False)}
    assert sorted(tuple(r) for r in minhash.one_of_each(few).collect()) == [(4, one + " end"), (9, two)]


def test_contamination(spark, docs, nothing):
    text = awkward_rows()[12][1].split()
    items = [(1, " ".join(text[85:110]).upper()), (2, "one, TWO"), (3, None), (4, "--"), (5, "w1 w2 nowhere"), (None, " ".join(text[85:110])), (1, " ".join(text[85:110]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = []
    for i, t, *_ in awkward_rows():
        w, hit, names = low(t), set(), set()
        for item, x in items:
            y = low(x)
            n = min(13, len(y))
            grams = {tuple(y[k : k + n]) for k in range(len(y) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    names.add("" if item is None else str(item))
        expected.append((i, len(w), len(hit), sorted(names)))
    for size in (100_000, 20):
        found = decontaminate.contamination(docs, bench, looked_up_words=size).select("id", "n_words", "n_hit", "items").collect()
        assert sorted(((*r[:3], list(r[3])) for r in found), key=lambda x: (*key(x[:3]), x[3])) == sorted(expected, key=lambda x: (*key(x[:3]), x[3]))
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.where("doc_id = 6").count() == 0 and clean.where("doc_id = 3").count() == 1
    assert decontaminate.contamination(nothing, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_mix(docs, nothing):
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    sizes, taken = {}, {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = max(r["size"] for r in found)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(taken[r["source"]] - r["target"]) <= largest
    assert sum({r["source"]: r["target"] for r in found}.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(docs.repartition(3, "text")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix(nothing).count() == 0


def test_quality(spark, docs, nothing):
    r = random.Random(1)
    rows = [(i, prose(r, 60) + "." if i % 2 else " ".join(f"{w}***" for w in prose(r, 60).split())) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(400)), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    found = {x["id"]: x["score"] for x in quality.scored(table, model).collect()}
    assert all((found[i] >= 0.5) == bool(i % 2) for i in found)
    assert quality.scored(docs, model).count() == docs.count() and quality.scored(nothing, model).count() == 0
    assert quality.good_documents(docs, model).columns == docs.columns
    assert quality.train(nothing, labels).score(quality.np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_language(spark, docs, nothing):
    r = random.Random(2)
    make = {"aa": "la le lo mi ma", "bb": "sch ung keit der", "cc": "the ing tion of", "dd": "ción ado que las", "ee": "ение ого при на"}
    rows = [(i, " ".join(r.choice(make[lang].split()) + r.choice(make[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(sorted(make) * 30)]
    table = spark.createDataFrame([*rows, (1000, "123 ...", None), (1001, None, "aa"), (None, "la le", "aa")], "doc_id long, text string, lang string")
    found = {x["id"]: x for x in language.identified(table, language.train(table)).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows)
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und" and found[1000]["score"] == 0
    assert all(0 <= x["score"] <= 1 for x in found.values())
    assert language.identified(docs, language.train(nothing)).where("lang_pred <> 'und'").count() == 0
    one = language.train(table.where("lang = 'aa'"))
    assert language.identified(table.where("doc_id = 0"), one).first()["lang_pred"] == "aa"


def test_many_languages_have_distinct_codewords():
    code = language.codewords(40)
    gaps = [(code[a] != code[b]).sum() for a in range(40) for b in range(a)]
    assert min(gaps) > 10


def test_other_column_names(docs):
    other = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("source").alias("size"), F.lit(1).alias("uid"), F.lit(2).alias("key"))
    assert substrings.deduplicated(other, id_col="id", text_col="body").count() == docs.count()
    assert suffixes.trimmed_documents(other, id_col="id", text_col="body").columns == other.columns
    assert minhash.one_of_each(other, id_col="id", text_col="body").columns == other.columns
    assert mixing.mix(other, id_col="id", text_col="body", source_col="size").count() == docs.count()
