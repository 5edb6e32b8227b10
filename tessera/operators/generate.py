"""From a project to the prompt that is sent: a fresh index, the chunks that match, and what they were."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators import index, projects, prompts

# How documents are cut for retrieval.
CHUNK_TOKENS, CHUNK_OVERLAP = 400, 60


@dataclass(frozen=True)
class Retrieval:
    """What is asked for, and what holds where nothing is (``config_``); 0 and empty mean nothing."""

    provider: str = ""
    model: str = ""
    k: int = 0
    min_score: float = 0.0
    config_k: int = 0
    config_min_score: float = 0.0
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    per_document: int = 0
    reindex: bool = False


@dataclass(frozen=True)
class Prepared:
    """A prompt, its tokens, the retrieved chunks in order (their number is the search's k), and how many
    chunks the index wrote and removed for it."""

    prompt: str
    tokens: int
    evidence: tuple[Row, ...] = ()
    written: int = 0
    removed: int = 0


def content_digest(docs: DataFrame, id_: str = "id", name: str = "name", text: str = "text") -> str:
    """What stands for the ids, names and texts of some documents whatever their order: their number and 128 bits,
    put together from the documents' own by sums that are taken before the shuffle."""
    own = F.sha1(F.concat_ws("\0", F.col(id_).cast("string"), F.coalesce(name, F.lit("")), F.sha1(F.coalesce(F.col(text), F.lit("")))))
    parts = docs.select(F.xxhash64(own).alias("a"), F.xxhash64(own, F.lit(1)).alias("b"))
    found = parts.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum(F.pmod("a", F.lit(1 << 32))).alias("sum")).first()
    return "-".join(str(found[c] or 0) for c in ("n", "a", "b", "sum"))


def prompt_of(docs: DataFrame, project: projects.Project, task: str | None = None) -> str:
    """A project's prompt without retrieval. Its tokens are counted before anything is brought together: above the
    quota of a project that is an error."""
    tokens = docs.agg(F.sum("tokens")).first()[0] or 0
    if tokens > prompts.PROJECT_TOKENS:
        raise ValueError(f"{tokens} tokens exceed a project's {prompts.PROJECT_TOKENS}")
    row = prompts.prompt_documents(docs.withColumn("project", F.lit(project.name))).first()
    return prompts.build_prompt(project.instructions, row["prompt_docs"] if row else "", task)


def prepare(spark: SparkSession, project_path: str, index_path: str, embed: Callable[[list[str]], list[list[float]]], asked: Retrieval | None = Retrieval(), task: str | None = None) -> Prepared:
    """The prompt of the project in ``project_path``, with the chunks that match its instructions in front of the
    documents. ``asked`` None: without retrieval.

    The index in ``index_path`` is brought up to date first: what stands for the documents and settings is
    compared with what the index was made from, so if neither has changed nothing is cut or embedded but the
    instructions; else changed chunks alone are. Without a match the prompt is the project's own."""
    docs, project = projects.load(spark, project_path)
    prompt = prompt_of(docs, project, task)
    count = lambda text: max(bool(text), len(text) * 3 // 10)
    if asked is None:
        return Prepared(prompt, count(prompt))
    meta = index.IndexMeta(provider=asked.provider, model=asked.model, most_tokens=CHUNK_TOKENS, overlap=CHUNK_OVERLAP)
    source = f"{content_digest(docs)} {sorted(asked.include)} {sorted(asked.exclude)} {asked.per_document}"
    _, written, removed = index.update(docs, embed, meta, index_path, force=asked.reindex, include=list(asked.include), exclude=list(asked.exclude), per_document=asked.per_document, source=source, id_col="id", name_col="name")
    vectors = embed([project.instructions])
    if not vectors:
        raise ValueError("no vector for the instructions")
    k, least = prompts.retrieval_settings(asked.k, asked.min_score, asked.config_k, asked.config_min_score)
    chunks, _ = index.load(spark, index_path)
    found = index.search(chunks, vectors[0], k=k, min_score=least).select("doc_id", "doc_name", "chunk_id", "text", "score").collect()
    prompt = prompts.with_context(prompt, [(r["doc_name"], r["chunk_id"], r["text"]) for r in found])
    return Prepared(prompt, count(prompt), tuple(found), written, removed)
