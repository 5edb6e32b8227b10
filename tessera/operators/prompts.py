"""Projects of documents: quotas, token counts, prompts, and what evidence a prompt rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import is_dataset_document, preview, prompt_tokens
from tessera.operators.ranges import running_sums

# Tokens of a project, and number and tokens of its dataset summaries.
PROJECT_TOKENS, PROJECT_WARNING = 200_000, 100_000
SUMMARY_DOCUMENTS, SUMMARY_WARNING = 20, 150_000


def token_totals(docs: DataFrame, project: str = "project", text: str = "text") -> DataFrame:
    return docs.groupBy(project).agg(F.sum(prompt_tokens(F.col(text))).cast("long").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def overhead(total: Column, documents: Column, instructions: Column) -> Column:
    return F.greatest(F.lit(0), total - documents - instructions)


def project_quota(docs: DataFrame, added: Column | None = None, project: str = "project", text: str = "text") -> DataFrame:
    """(project, tokens, state): ``error`` above the quota, ``warn`` above half of it."""
    totals = token_totals(docs, project, text).withColumn("tokens", F.col("tokens") + (added if added is not None else F.lit(0)))
    return totals.select(project, "tokens", F.when(F.col("tokens") > PROJECT_TOKENS, "error").when(F.col("tokens") > PROJECT_WARNING, "warn").otherwise("ok").alias("state"))


def dataset_quota(docs: DataFrame, project: str = "project", name: str = "name", description: str = "description", text: str = "text") -> DataFrame:
    """(project, summaries, tokens, state) of the dataset summaries among a project's documents."""
    is_summary = is_dataset_document(F.col(name), F.col(description))
    found = docs.groupBy(project).agg(F.count_if(is_summary).alias("summaries"), F.coalesce(F.sum(F.when(is_summary, prompt_tokens(F.col(text)))), F.lit(0)).cast("long").alias("tokens"))
    state = F.when(F.col("summaries") >= SUMMARY_DOCUMENTS, "error").when(F.col("tokens") >= SUMMARY_WARNING, "warn").otherwise("ok")
    return found.withColumn("state", state)


def new_documents(candidates: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    return candidates.join(known.select(path).distinct(), path, "left_anti")


def known_documents(candidates: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    return candidates.join(known.select(path).distinct(), path, "left_semi")


def unique_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.select(path).distinct().orderBy(path)


def document_block(name: Column, description: Column, text: Column) -> Column:
    label = F.when(F.coalesce(description, F.lit("")) != "", F.concat(name, F.lit(" ("), description, F.lit(")"))).otherwise(name)
    return F.concat(F.lit("--- Document: "), label, F.lit(" ---\n"), text, F.lit("\n"))


def prompt_documents(docs: DataFrame, project: str = "project", id_: str = "id", name: str = "name", description: str = "description", text: str = "text", quota: int = PROJECT_TOKENS) -> DataFrame:
    """(project, prompt_docs): the blocks of a project's documents in the order of their ids; null for a project of
    more than ``quota`` tokens.

    Tokens are added up by project first, in the tasks and then by key. Only documents of projects within
    the quota are brought together, so what one row and one task hold is bounded, however many documents one
    project has; ``prompt_blocks`` has those of any project."""
    totals = docs.groupBy(project).agg(F.sum(prompt_tokens(F.col(text))).alias("tokens")).select(F.col(project).alias("__project"), (F.coalesce("tokens", F.lit(0)) <= quota).alias("__fits"))
    known = docs.select(project, id_, name, description, text).join(totals, F.col(project).eqNullSafe(F.col("__project")))
    entry = F.struct(F.col(id_).alias("id"), document_block(F.col(name), F.col(description), F.col(text)).alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["block"])
    within = known.where("__fits").groupBy(project).agg(F.array_join(blocks, "\n").alias("prompt_docs"))
    over = totals.where("not __fits").select(F.col("__project").alias(project), F.lit(None).cast("string").alias("prompt_docs"))
    return within.unionByName(over)


def prompt_blocks(docs: DataFrame, project: str = "project", id_: str = "id", name: str = "name", description: str = "description", text: str = "text") -> DataFrame:
    """(project, place, block): the blocks of each project's documents, numbered in the order of their ids, a row a
    document; a project of any size is many tasks."""
    rows = docs.select(project, id_, document_block(F.col(name), F.col(description), F.col(text)).alias("block"), F.lit(1).alias("__one"))
    return running_sums(rows, project, [id_], {"__one": "place"}).select(project, "place", "block")


def within_tokens(docs: DataFrame, most: int, project: str = "project", id_: str = "id", text: str = "text") -> DataFrame:
    """The first documents of each project, in the order of their ids, that ``most`` tokens hold together, with their
    place and the tokens up to them. A project with very many documents is many tasks."""
    counted = docs.withColumns({"__one": F.lit(1), "__tokens": prompt_tokens(F.col(text))})
    placed = running_sums(counted, project, [id_], {"__one": "place", "__tokens": "tokens_so_far"})
    return placed.where(F.col("tokens_so_far") <= most).drop("__one", "__tokens")


def build_prompt(instructions: str, blocks: str, task: str | None = None) -> str:
    """A project's prompt. No documents at all is an error."""
    if not blocks:
        raise ValueError("the project has no documents")
    return f"[INSTRUCTIONS]\n{instructions}\n\n[DOCUMENT RELATIONSHIPS]\n(none)\n\n[REFERENCE DOCUMENTS]\n{blocks}\n[TASK]\n{task or instructions}\n"


def with_context(prompt: str, chunks: list[tuple[str, int, str]]) -> str:
    """The prompt with retrieved chunks (document, chunk, text), numbered, in front of the documents."""
    if not chunks:
        return prompt
    section = "[RETRIEVED CONTEXT]\n" + "".join(f"-- {n}) {name} (chunk {i}) --\n{text}\n\n" for n, (name, i, text) in enumerate(chunks, 1))
    head, mark, rest = prompt.partition("[REFERENCE DOCUMENTS]")
    return head + section + mark + rest if mark else section + prompt


def retrieval_settings(k: int = 0, min_score: float = 0.0, config_k: int = 0, config_min_score: float = 0.0) -> tuple[int, float]:
    """(k, least score): the option, else the configured value, else 6 and 0."""
    return k or config_k or 6, max(0.0, min_score if min_score > 0 else config_min_score)


def evidence_documents(docs: DataFrame, project: str = "project", id_: str = "id", path: str = "path") -> DataFrame:
    """Documents with their place in the report and whether they are derived (have no path). A project with very
    many documents is many tasks."""
    placed = running_sums(docs.withColumn("__one", F.lit(1)), project, [id_], {"__one": "place"}).drop("__one")
    return placed.withColumn("place", F.col("place").cast("int")).withColumn("is_derived", F.coalesce(F.col(path), F.lit("")) == "")


def evidence_items(found: DataFrame, text: str = "text") -> DataFrame:
    """Retrieved records (few: the search's k) with rank and preview."""
    place = F.row_number().over(W.orderBy(F.desc("score"), "doc_name", "chunk_id"))
    return found.withColumn("rank", place).withColumn("preview", preview(F.col(text)))
