"""The pipeline's stages, each on its own input, against brute force on the smallest tables."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import quality
from tessera.session import materialize

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage makes of those before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = made[name] = materialize(stage(spark, docs, SF), f"test-{name}")
    return made


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    for name in list(STAGES)[:-1]:
        assert steps[name].columns == steps["documents"].columns


def test_quality_rejects(spark, steps):
    docs = steps["documents"]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["id"] for r in quality.scored(docs, model).where("score < 0.3").collect()}
    assert bad and set(texts(steps["quality"])) == set(texts(docs)) - bad
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels[i] != (i not in bad) for i in labels) <= 0.1 * len(labels)


def longest_match(a, b):
    """Words of a and b that an alignment matches, by the table of all prefixes."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row[-1]


def test_one_of_each_class_stays(steps):
    before, after = texts(steps["quality"]), texts(steps["near_copies"])
    number = {}
    rows = {i: np.array([number.setdefault(x, len(number)) for x in WORD.findall(t.encode())]) for i, t in before.items()}
    sets = {i: {tuple(w[k : k + 5].tolist()) for k in range(max(len(w) - 4, min(len(w), 1)))} for i, w in rows.items()}
    pairs = [(i, j) for i, x in rows.items() for j, y in rows.items() if i < j and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) > 0 and sets[i] & sets[j]]
    pairs = [(i, j) for i, j in pairs if longest_match(rows[i], rows[j]) >= 0.8 * max(len(rows[i]), len(rows[j]))]
    label = {i: i for i in sets}
    for _ in range(8):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert set(after) == {i for i in label if label[i] == i} and all(after[i] == before[i] for i in after)


def test_repeats_are_cut(steps):
    before, after, n = texts(steps["near_copies"]), texts(steps["repeats"]), corpus_pipeline.PASSAGE_BYTES
    first = {}
    for i, t in before.items():
        raw = t.encode()
        for k in range(len(raw) - n + 1):
            first[raw[k : k + n]] = min(first.get(raw[k : k + n], (i, k)), (i, k))
    for i, t in before.items():
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            if first[raw[k : k + n]] < (i, k):
                gone[k : k + n] = b"\1" * n
        assert after[i] == bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert all(r["n_chars"] == len(r["text"]) for r in steps["repeats"].collect())


def test_passages_of_fifty_words_stay_once(spark, steps):
    """Of a passage of a little over fifty words that several documents have, the first copy is left."""
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("aeiourstlnm") for _ in range(r.randint(2, 9))) for _ in range(n))
    passages = [prose(51 + i % 10) for i in range(30)]
    rows = [(i, f"{prose(60)}\n{passages[i % 30]}\n{prose(90)}") for i in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], steps["documents"].schema)
    after = texts(STAGES["repeats"](spark, docs, SF))
    assert all((passages[i % 30] in after[i]) == (i < 30) for i in range(100))
    assert all(after[i] == t for i, t in rows[:30]) and all(len(after[i]) >= len(t) - len(passages[i % 30]) - 9 for i, t in rows)


def test_contaminated_documents_go(spark, steps):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = [low(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(y[k : k + min(13, len(y))]) for y in items if y for k in range(len(y) - min(13, len(y)) + 1)}
    clean = set()
    for i, t in texts(steps["repeats"]).items():
        w, hit = low(t), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert set(texts(steps["decontaminate"])) == clean


def test_mix_reaches_targets(spark, steps):
    found = steps["mix"].collect()
    assert {r["doc_id"] for r in found} == set(texts(steps["decontaminate"]))
    taken, largest = {}, max(r["size"] for r in found)
    for r in found:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= largest for r in found)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, found))
