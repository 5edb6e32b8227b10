"""Incremental updates of an index: what they write, remove and embed."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tessera.operators import index, versions


def counting():
    """An embedder that tasks get by value: a text's length and first letter."""

    def embed(texts):
        return [[float(len(x)), float(ord(x[0]))] for x in texts]

    return embed


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


META = index.IndexMeta(model="m", most_tokens=10)


def docs_of(spark, texts, names=None):
    return spark.createDataFrame([(i, (names or {}).get(i, f"d{i}"), t) for i, t in texts.items()], "doc_id long, source string, text string")


def state(spark, path):
    return sorted((r["doc_id"], r["doc_name"], r["chunk_id"], r["text"], tuple(r["vector"])) for r in index.load(spark, path)[0].collect())


def built(spark, docs):
    made, _ = index.build(docs, counting(), META)
    return sorted((r["doc_id"], r["doc_name"], r["chunk_id"], r["text"], tuple(r["vector"])) for r in made.collect())


def test_an_update_writes_what_changes(spark, path):
    texts = {i: "\n\n".join(f"part {j} of {i} " + "x" * 30 for j in range(3)) for i in range(100)}
    meta, written, gone = index.update(docs_of(spark, texts), counting(), META, path)
    assert (written, gone, meta.dim) == (300, 0, 2) and state(spark, path) == built(spark, docs_of(spark, texts))

    def no(texts):
        raise AssertionError("nothing should be embedded")

    # nothing changes: nothing is embedded or written
    assert index.update(docs_of(spark, texts), no, META, path)[1:] == (0, 0)
    # one document of a hundred: a chunk of it changes, another document goes, one gets a name
    texts[7] = texts[7].replace("part 1", "item 1")
    del texts[9]
    meta2, written, gone = index.update(docs_of(spark, texts, {11: "new name"}), counting(), META, path)
    assert (written, gone) == (1 + 3, 1 + 3 + 3) and meta2.created == meta.created
    assert state(spark, path) == built(spark, docs_of(spark, texts, {11: "new name"}))
    _, record = versions.latest(spark, path)
    assert len(record["folders"]) == 2 and record["rows"] == 304
    # what was removed can come back
    texts[9] = "again"
    index.update(docs_of(spark, texts), counting(), META, path)
    assert state(spark, path) == built(spark, docs_of(spark, texts))


def test_compaction_and_vacuum(spark, path, monkeypatch):
    monkeypatch.setattr(index, "MOST_CHANGES", 3)
    texts = {i: f"text {i}" for i in range(20)}
    for i in range(5):
        texts[i] = f"other {i}"
        index.update(docs_of(spark, texts), counting(), META, path)
        assert state(spark, path) == built(spark, docs_of(spark, texts))
    assert len(versions.latest(spark, path)[1]["folders"]) <= 3
    index.compact(spark, path)
    record = versions.latest(spark, path)[1]
    assert (len(record["folders"]), record["removed"], record["rows"], record["dead"]) == (1, [], 20, 0)
    index.vacuum(spark, path, keep=1)
    assert state(spark, path) == built(spark, docs_of(spark, texts)) and len(versions.numbers(spark, path)) == 1
    # many removals make a compaction
    index.update(docs_of(spark, {i: t for i, t in texts.items() if i < 10}), counting(), META, path)
    assert versions.latest(spark, path)[1]["dead"] == 0 and len(state(spark, path)) == 10


def test_other_settings_and_repeated_documents(spark, path):
    docs = docs_of(spark, {1: "a", 2: "b"})
    nobody = spark.createDataFrame([(None, "n", "nobody's")], docs.schema)
    for _ in range(2):
        index.update(docs.unionByName(docs).unionByName(nobody), counting(), META, path)
    assert len(state(spark, path)) == 2
    assert index.update(docs, counting(), index.IndexMeta(model="other", most_tokens=10), path)[1:] == (2, 0)
    assert index.update(docs, counting(), index.IndexMeta(model="other", most_tokens=10), path, force=True)[1] == 2
    assert index.update(docs.limit(0), counting(), index.IndexMeta(model="other", most_tokens=10), path)[1:] == (0, 2) and state(spark, path) == []
    with pytest.raises(FileNotFoundError):
        index.load(spark, path + "-none")


def test_two_updates_at_once(spark, path):
    """Whoever comes second works from the first's version: the index is what one of them asked for, whole."""
    first, second = {i: f"text {i}" for i in range(10)}, {i: f"text {i + i % 2}" for i in range(12)}
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda t: index.update(docs_of(spark, t), counting(), META, path), (first, second)))
    assert state(spark, path) in (built(spark, docs_of(spark, first)), built(spark, docs_of(spark, second))) and len(versions.numbers(spark, path)) in (2, 3)  # the third is a compaction
