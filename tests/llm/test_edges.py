"""Columns of any names, tables without rows, very long texts, and accuracy on held-out rows of the given tables."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, html, language, minhash, quality, registry, suffixes, vectors, warc

SF = "/root/testdata/sf0.001"
#: Names that operators use inside.
CLASHING = ["id", "key", "row", "row_key", "uid", "of", "w", "m", "n", "rep", "size", "score", "spans", "found", "digest", "payload", "host", "classes", "hash", "lang_pred", "component_id", "vec", "copies", "item", "item_id", "label", "features"]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def crowded(df):
    """A table with further columns, of names that operators use inside."""
    return df.withColumns({c: F.lit(f"{c}?") for c in CLASHING if c not in df.columns})


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_crowded_documents(spark):
    docs, labels, items = table(spark, "documents"), table(spark, "labels"), table(spark, "benchmark")
    model = quality.train(docs, labels)
    same(quality.scored(docs, model), quality.scored(crowded(docs), model))
    same(quality.scored(docs, model), quality.scored(docs, quality.train(crowded(docs), crowded(labels))))
    same(decontaminate.contamination(docs, items), decontaminate.contamination(crowded(docs), items.withColumn("w", F.lit(1)).withColumn("key", F.lit(2))))
    known = language.train(docs)
    same(language.identified(docs, known), language.identified(crowded(docs), known))
    same(language.identified(docs, known), language.identified(docs, language.train(crowded(docs))))
    same(minhash.near_duplicates(docs), minhash.near_duplicates(crowded(docs)))


def test_crowded_pages_and_vectors(spark):
    pages, embeddings = table(spark, "pages"), table(spark, "embeddings")
    same(html.main_text(pages), html.main_text(crowded(pages)))
    same(warc.round_trip(pages), warc.round_trip(crowded(pages)))
    same(vectors.near_duplicates(embeddings), vectors.near_duplicates(crowded(embeddings)))


def test_stages_without_rows(spark):
    docs = table(spark, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "quality":  # a classifier needs rows to learn from
            out = stage(spark, docs.limit(0), SF)
            assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_stages_on_awkward_rows(spark):
    docs = table(spark, "documents")
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(90_000 + i, t, lang, source, None) for i, (t, lang, source) in enumerate([(None, None, None), ("", "en", "s"), (" \n\t", None, "s"), (long, "en", None), (long + " x", "en", "s"), ("é" * 3000, "fr", "s")])]
    some = docs.limit(20).unionByName(spark.createDataFrame([*rows, rows[0], (None, "only this", "en", "s", 1)], docs.schema))
    before = {name: stage(spark, some, SF).collect() for name, stage in corpus_pipeline.STAGES[1:4]}
    ids = lambda name: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in before[name] if r["doc_id"] is None or r["doc_id"] >= 90_000)
    assert ids("near_copies") == [-1, *(90_000 + i for i in (0, 1, 2, 3, 5))]
    assert ids("repeats") == ids("decontaminate") == [-1, 90_000, *(90_000 + i for i in range(6))]
    cut = {r["doc_id"]: r["text"] for r in before["repeats"]}
    assert cut[90_003] == long and len(cut[90_004]) < 600 and cut[90_000] is None and cut[90_001] == ""


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scored = [(r["predicted"], labels[r["doc_id"]]) for r in registry.op1_quality(spark, sf).where("held_out").collect() if labels.get(r["doc_id"]) is not None]
    assert len(scored) > 50 and np.mean([p == q for p, q in scored]) >= 0.95
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = [(r["lang_pred"], docs[r["doc_id"]]) for r in registry.op8_language(spark, sf).where("held_out").collect() if docs[r["doc_id"]] is not None]
    assert len(found) > 100 and np.mean([p == q for p, q in found]) >= 0.97


def edited(r, words, rate):
    return [f"new{r.randint(0, 10**6)}" if r.random() < rate else w for w in words]


def test_recall_of_edited_copies(spark):
    """Words replaced at random places at a rate of one in ten: nine in ten copies are found at least."""
    r = random.Random(9)
    base = [[f"t{r.randint(0, 5000)}" for _ in range(r.randint(200, 400))] for _ in range(150)]
    rows = [(2 * i + j, " ".join(w if j == 0 else edited(r, w, 0.1))) for i, w in enumerate(base) for j in (0, 1)]
    found = {x["id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(150)) >= 0.95 * 150
    assert all(found[2 * i] == 2 * i for i in range(150))


def test_sketches_of_texts_with_more_shingles_than_places(monkeypatch):
    """With six bits for places, texts of 2000 shingles are sketched by coarse places: still by order, still alike for near copies."""
    monkeypatch.setattr(minhash, "_PLACE", np.uint64(63))
    labels = minhash.mixed(np.arange(1, 2001, dtype=np.uint64))
    near = labels.copy()
    near[::40] = minhash.mixed(np.arange(9000, 9050, dtype=np.uint64))
    bounds = np.array([0, 2000])
    a, b, back = (minhash.sketch_keys(x, bounds)[0] for x in (labels, near, labels[::-1].copy()))
    assert (a != 0).sum() > 20 and ((a == b) & (a != 0)).sum() > 20 and ((a == back) & (a != 0)).sum() < 5


def test_very_long_repeats(spark):
    """A text of two million bytes that repeats itself, against what the bytes say."""
    r = random.Random(4)
    part = "".join(r.choice("abcdefgh ") for _ in range(200_000))
    text = part + "".join(r.choice("xyz ") for _ in range(1_600_000)) + part
    found = suffixes.deduplicated(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (found["n_bytes"], found["n_removed"], found["n_spans"]) == (2_000_000, 400_000, 2)


def test_contexts_of_a_long_text_take_the_memory_of_a_piece(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_pydict({"uid": [b"a", b"b", b"c"], "id": [1, 2, 3], "text": [text, None, text[:700] + text[:900] + "x" * 2000]})
    tracemalloc.start()
    found = suffixes.contexts(batch, 256, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)
    for part in (len(text), 1000, 256):  # at once, and in pieces of all kinds of places
        monkeypatch.setattr(suffixes, "_PART", part)
        assert suffixes.contexts(batch.slice(2 if part < 1000 else 0), 256, 64).equals(found.slice(2 if part < 1000 else 0))
