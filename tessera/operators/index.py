"""A vector index of chunks: incremental builds, and search by cosine similarity."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import allowed
from tessera.functions.vectors import cosine
from tessera.operators import versions
from tessera.operators.chunks import chunks
from tessera.operators.nearest import best_of, search_block
from tessera.session import materialize, release

KEYS = ["doc_id", "chunk_id", "chunk_hash"]
EMBED_BATCH = 100


@dataclass(frozen=True)
class IndexMeta:
    provider: str = ""
    model: str = ""
    dim: int = 0
    most_tokens: int = 400
    overlap: int = 0
    version: int = 1
    created: str = ""
    updated: str = ""

    def compatible(self, other: IndexMeta) -> bool:
        """Whether vectors may be kept: no setting differs; empty ones and zeros fit all."""
        pairs = zip(astuple_settings(self), astuple_settings(other), strict=True)
        return all(not a or not b or a == b for a, b in pairs)


def astuple_settings(meta: IndexMeta) -> tuple:
    return meta.provider, meta.model, meta.dim, meta.most_tokens, meta.overlap


def reusable(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks with the vector of the equal old chunk (same document, place and hash), or null."""
    known = old.where(F.size("vector") > 0).select(*KEYS, "vector").dropDuplicates(KEYS)
    return new.join(known, KEYS, "left")


def to_embed(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.join(old.where(F.size("vector") > 0).select(*KEYS), KEYS, "left_anti")


def embedded(parts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> DataFrame:
    """Chunks with vectors from ``embed``, which gets at most ``batch`` texts at a time, in the tasks."""
    parts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    kinds = parts.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def run(frames):
        for whole in frames:
            for at in range(0, len(whole), batch):  # whatever the session's batches are when the job starts
                frame = whole.iloc[at : at + batch]
                vectors = embed(frame["text"].tolist())
                if len(vectors) != len(frame):
                    raise ValueError(f"{len(vectors)} vectors for {len(frame)} texts")
                yield frame.assign(vector=pd.Series(vectors, index=frame.index))

    return parts.mapInPandas(run, f"{kinds}, vector array<float>")


def merged(new: DataFrame, old: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """All chunks of the new documents: vectors are kept where a chunk is unchanged, others are embedded.
    Documents that are gone are not in it."""
    kept = reusable(new, old).where("vector is not null")
    return kept.unionByName(embedded(to_embed(new, old), embed))


def ordered(index: DataFrame) -> DataFrame:
    return index.orderBy("doc_name", "chunk_id")


def build(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], meta: IndexMeta, *, old: DataFrame | None = None, old_meta: IndexMeta | None = None, force: bool = False, include: list[str] = (), exclude: list[str] = (), per_document: int = 0, id_col: str = "doc_id", name_col: str = "source", text_col: str = "text") -> tuple[DataFrame, IndexMeta]:
    """The index of the documents that ``include`` and ``exclude`` allow, and its settings.

    The old index is used if its settings fit and ``force`` is not set."""
    docs = docs.where(allowed(F.col(name_col), include, exclude))
    new = chunks(docs, id_col=id_col, name_col=name_col, text_col=text_col, most=meta.most_tokens, overlap=meta.overlap, per_document=per_document)
    usable = old is not None and not force and (old_meta is None or meta.compatible(old_meta))
    index = materialize(merged(new, old, embed) if usable else embedded(new, embed), "index")
    now = datetime.now(UTC).isoformat()
    first = index.select(F.size("vector").alias("dim")).first()
    dim = first["dim"] if first else (old_meta.dim if old_meta else 0)
    return index, replace(meta, dim=dim, created=(old_meta.created if usable and old_meta else "") or now, updated=now)


def _record(meta: IndexMeta, folders: list[str], removed: list[str], rows: int, dead: int, source: str = "") -> dict:
    return {"meta": asdict(meta), "folders": folders, "removed": removed, "rows": rows, "dead": dead, "source": source}


def _settings(record: dict) -> IndexMeta:
    return IndexMeta(**{k: record["meta"].get(k, default) for k, default in asdict(IndexMeta()).items()})


def save(index: DataFrame, meta: IndexMeta, path: str) -> None:
    """Write the whole index as a new version; readers see the one before or this one."""
    spark, name = index.sparkSession, f"chunks-{uuid.uuid4().hex}"
    index.write.parquet(f"{path}/{name}")
    rows = spark.read.parquet(f"{path}/{name}").count()
    versions.commit(spark, path, lambda n, record: _record(meta, [name], [], rows, 0))


def _live(spark: SparkSession, path: str, record: dict) -> DataFrame:
    """The chunks of a version: those of all its folders but the ones that a later folder has removed."""
    numbered = [spark.read.parquet(f"{path}/{name}").withColumn("__written", F.lit(i)) for i, name in enumerate(record["folders"])]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    removed = [spark.read.parquet(f"{path}/{name}").withColumn("__removed", F.lit(record["folders"].index(name.replace("removed-", "chunks-")))) for name in record["removed"]]
    if not removed:
        return rows.drop("__written")
    last = reduce(DataFrame.unionByName, removed).groupBy(*KEYS).agg(F.max("__removed").alias("__removed"))
    return rows.join(last, KEYS, "left").where("__removed is null or __written >= __removed").drop("__written", "__removed")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, IndexMeta]:
    """The newest version's chunks and settings."""
    n, record = versions.latest(spark, path)
    if record is None:
        raise FileNotFoundError(f"no index in {path}")
    meta = _settings(record)
    return _live(spark, path, record), replace(meta, version=meta.version or 1)


#: Folders of changes, and the share of removed chunks, from which on an update writes the index anew.
MOST_CHANGES, MOST_REMOVED = 16, 0.2


def update(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], meta: IndexMeta, path: str, *, force: bool = False, include: list[str] = (), exclude: list[str] = (), per_document: int = 0, source: str = "", id_col: str = "doc_id", name_col: str = "source", text_col: str = "text") -> tuple[IndexMeta, int, int]:
    """Bring the index in ``path`` to what ``build`` of these documents would be, and write only what changes: a folder
    of chunks that are new (these alone are embedded) or whose document has another name, and one of the keys of
    chunks that are gone. (settings, chunks written, chunks removed).

    Without an index, with settings that don't fit, or with ``force`` all is written. Folders of changes are put together
    with ``compact`` once there are ``MOST_CHANGES``, or once ``MOST_REMOVED`` of all written chunks are
    gone. If another writer is first, the change is worked out again from that one's version. Equal
    chunks of one document and place are one; documents without an id are left out. ``source`` stands for the documents and how they are cut: if the
    newest version was made from the same, nothing is read."""
    spark = docs.sparkSession
    _, known = versions.latest(spark, path)
    if source and known and not force and known.get("source") == source and meta.compatible(_settings(known)):
        return _settings(known), 0, 0
    docs = docs.where(allowed(F.col(name_col), include, exclude) & F.col(id_col).isNotNull())
    new = chunks(docs, id_col=id_col, name_col=name_col, text_col=text_col, most=meta.most_tokens, overlap=meta.overlap, per_document=per_document)
    new = materialize(new.dropDuplicates(KEYS), "chunks")
    done: dict = {}

    def change(n: int, record: dict | None) -> dict:
        old_meta = _settings(record) if record else None
        usable = record is not None and not force and meta.compatible(old_meta)
        name = uuid.uuid4().hex
        now = datetime.now(UTC).isoformat()
        if usable:
            old = _live(spark, path, record)
            known = old.where(F.size("vector") > 0).select(*KEYS, F.col("doc_name").alias("old_name"), "vector")
            both = new.join(known, KEYS, "left")
            renamed = both.where("vector is not null and not (doc_name <=> old_name)").drop("old_name")
            added = embedded(both.where("vector is null").drop("vector", "old_name"), embed).unionByName(renamed)
            kept = new.select(*KEYS, F.col("doc_name").alias("new_name"))
            gone = old.join(kept, KEYS, "left").where("new_name is null or not (doc_name <=> new_name) or size(vector) <= 0").select(*KEYS)
            gone.write.parquet(f"{path}/removed-{name}")
        else:
            added = embedded(new, embed)
        added.write.parquet(f"{path}/chunks-{name}")
        written = spark.read.parquet(f"{path}/chunks-{name}")
        n_written = written.count()
        n_gone = spark.read.parquet(f"{path}/removed-{name}").count() if usable else 0
        first = written.select(F.size("vector").alias("dim")).first()
        dim = first["dim"] if first else (old_meta.dim if usable else 0)
        made = replace(meta, dim=dim, created=(old_meta.created if usable else "") or now, updated=now)
        done.update(meta=made, written=n_written, gone=n_gone)
        if not usable:
            return _record(made, [f"chunks-{name}"], [], n_written, 0, source)
        if not n_written and not n_gone:
            return record | {"meta": asdict(made), "source": source}
        removed = [*record["removed"], *([f"removed-{name}"] if n_gone else [])]
        return _record(made, [*record["folders"], f"chunks-{name}"], removed, record["rows"] + n_written, record["dead"] + n_gone, source)

    _, record = versions.commit(spark, path, change)
    release(new)
    if len(record["folders"]) > MOST_CHANGES or record["dead"] > MOST_REMOVED * record["rows"]:
        compact(spark, path)
    return done["meta"], done["written"], done["gone"]


def compact(spark: SparkSession, path: str) -> None:
    """Write the index anew as one folder; nothing is embedded. A change that another writer makes meanwhile stays."""

    def change(n: int, record: dict | None) -> dict:
        name = f"chunks-{uuid.uuid4().hex}"
        _live(spark, path, record).write.parquet(f"{path}/{name}")
        return record | {"folders": [name], "removed": [], "rows": spark.read.parquet(f"{path}/{name}").count(), "dead": 0}

    versions.commit(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the files that only versions before the newest ``keep`` have."""
    return versions.vacuum(spark, path, keep, lambda record: record["folders"] + record["removed"])


def scored(records: DataFrame, query: list[float], vector_col: str = "vector") -> DataFrame:
    """Records with their similarity to one query vector, which is a literal in the plan: nothing is shuffled."""
    return records.withColumn("score", cosine(F.col(vector_col), F.array(*map(F.lit, query)).cast("array<double>")))


def search(records: DataFrame, query: list[float], *, k: int = 6, min_score: float = 0.0, vector_col: str = "vector", ties: tuple[str, ...] = ("doc_name", "chunk_id")) -> DataFrame:
    """The k most similar records (0: all) at ``min_score`` or more, ties by name and chunk. Each task
    keeps k rows, so the driver's share is k rows a task."""
    found = scored(records, query, vector_col).where(F.col("score") >= min_score).orderBy(F.desc("score"), *ties)
    return found.limit(k) if k > 0 else found


def search_many(records: DataFrame, queries: DataFrame, *, k: int = 6, min_score: float = 0.0, vector_col: str = "vector", query_col: str = "query", query_id: str = "query_id", ties: tuple[str, ...] = ("doc_name", "chunk_id"), most_queries: int = 10_000) -> DataFrame:
    """The k best records for each query, of any number of queries; exact, ties by ``ties``. Queries are dealt
    into blocks by their id, of half of ``most_queries`` on average; each task keeps the best of its rows for a
    block (``nearest.search_block``), and only those are shuffled. Of several blocks each has its result written before
    the next is searched; a query lies in one block, so the results need no merging."""

    def best(block: DataFrame) -> DataFrame:
        found = search_block(records, block, k=k, least=min_score, vector_col=vector_col, query_col=query_col, ties=ties)
        return best_of(found, query_id, ties, k)

    n = queries.count()
    if n <= most_queries:
        return best(queries)
    blocks = -(-2 * n // most_queries)
    queries = materialize(queries, "queries")
    number = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    return reduce(DataFrame.unionByName, [materialize(best(queries.where(number == i)), "found") for i in range(blocks)])
