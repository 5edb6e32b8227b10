"""Projects on disk, and the decisions before a prompt is sent."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import prompt_tokens
from tessera.operators import prompts, versions
from tessera.operators.catalog import builtin

# What holds where neither an option nor the project says otherwise.
MOST_OUTPUT, TEMPERATURE = 1024, 0.7
LARGE_PROMPT, LARGE_REQUEST = 100_000, 120_000


@dataclass(frozen=True)
class Project:
    """A project's settings; its documents are a table (id, path, name, description, text, tokens, added_at)."""

    name: str
    description: str = ""
    instructions: str = ""
    model: str = ""
    max_tokens: int = 0
    temperature: float = 0.0
    version: str = ""


def save(docs: DataFrame, project: Project, path: str) -> Project:
    """Write documents and settings as the version after ``project.version`` (none: the first). If the project in
    ``path`` is at another version by now, that is a ``versions.Conflict``, and nothing is replaced."""
    spark, name = docs.sparkSession, f"documents-{uuid.uuid4().hex}"
    docs.write.parquet(f"{path}/{name}")
    n = int(project.version or 0)
    saved = replace(project, version=str(n + 1))
    if versions.latest(spark, path)[0] != n or not versions.put(spark, path, n + 1, {"project": asdict(saved), "folders": [name]}):
        raise versions.Conflict(f"the project in {path} has changed since version {n}")
    return saved


def _documents(spark: SparkSession, path: str, record: dict) -> DataFrame:
    return spark.read.parquet(*(f"{path}/{name}" for name in record["folders"]))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Project]:
    """The newest version; settings that it does not have are the defaults."""
    n, record = versions.latest(spark, path)
    if record is None:
        raise FileNotFoundError(f"no project in {path}")
    known = {k: v for k, v in record["project"].items() if v is not None and k in Project.__dataclass_fields__}
    return _documents(spark, path, record), Project(**known | {"version": str(n)})


def add_documents(docs: DataFrame, new: DataFrame) -> DataFrame:
    """The documents and new ones (path, name, description, text). A path that is known already, or too
    many tokens for a project, is an error."""
    return docs.unionByName(_checked(docs, new))


def _checked(docs: DataFrame, new: DataFrame) -> DataFrame:
    """New documents as the project keeps them, if it may have them."""
    known = prompts.known_documents(new.where("path <> ''"), docs).select("path").limit(1).collect()
    known = known or new.where("path <> ''").groupBy("path").count().where("count > 1").select("path").limit(1).collect()
    if known:
        raise ValueError(f"the project has {known[0]['path']} already")
    fresh = new.select(F.expr("uuid()").alias("id"), "path", "name", "description", "text", prompt_tokens(F.col("text")).alias("tokens"), F.current_timestamp().alias("added_at"))
    total = docs.select("tokens").unionByName(new.select(prompt_tokens(F.col("text")).alias("tokens"))).agg(F.sum("tokens")).first()[0] or 0
    if total > prompts.PROJECT_TOKENS:
        raise ValueError(f"{total} tokens exceed a project's {prompts.PROJECT_TOKENS}")
    return fresh


def append(new: DataFrame, path: str) -> Project:
    """Add documents to the project in ``path``: only they are written. If another writer is first, its documents are
    checked against too and both stay; the checks are those of ``add_documents``."""
    spark, name = new.sparkSession, f"documents-{uuid.uuid4().hex}"

    def change(n: int, record: dict | None) -> dict:
        if record is None:
            raise FileNotFoundError(f"no project in {path}")
        fresh = _checked(_documents(spark, path, record), new)
        if not written:  # the checks are made again, the files stay
            fresh.write.parquet(f"{path}/{name}")
            written.append(name)
        return {"project": record["project"] | {"version": str(n + 1)}, "folders": [*record["folders"], name]}

    written: list[str] = []
    _, record = versions.commit(spark, path, change)
    return Project(**record["project"])


@dataclass(frozen=True)
class Request:
    """What would be sent: prompt, model, tokens, most tokens of the answer, temperature, cost, warnings."""

    prompt: str
    model: str
    tokens: int
    max_tokens: int
    temperature: float
    cost: float
    warnings: tuple[str, ...]


def request(spark: SparkSession, prompt: str, project: Project, *, model: str = "", default_model: str = "openai/gpt-4o-mini", prompt_limit: int = 0, max_tokens: int = 0, temperature: float = 0.0, context_cap: int = 0, budget: float = 0.0, local: bool = False, dry_run: bool = False, catalog: DataFrame | None = None) -> Request:
    """Check a prompt against limits in their order: it is cut to ``prompt_limit``; prompt and answer must fit
    the context (a warning, an error for local models); the cost must fit the budget, in a dry run too.
    Models that the catalog doesn't have are not checked."""
    if prompt_limit > 0:
        prompt = prompt[: int(prompt_limit / 1.2 * 4)]
    tokens = max(bool(prompt), len(prompt) * 3 // 10)
    chosen, most = model or project.model or default_model, max_tokens or project.max_tokens or MOST_OUTPUT
    warnings = [w for w, over in (("large prompt", tokens > LARGE_PROMPT), ("large request", tokens + most > LARGE_REQUEST)) if over]
    entry = (builtin(spark) if catalog is None else catalog).where(F.col("name") == chosen).first()
    cost = 0.0
    if entry:
        limit = min(entry["context_tokens"], context_cap) if context_cap > 0 else entry["context_tokens"]
        if not dry_run and limit > 0 and tokens + most > limit:
            message = f"{tokens} + {most} tokens exceed the context of {limit}"
            if local:
                raise ValueError(message)
            warnings.append(message)
        cost = tokens / 1000 * entry["input_per_k"] + most / 1000 * entry["output_per_k"]
        if budget > 0 and cost > budget:
            raise ValueError(f"estimated cost {cost:.4f} exceeds the budget {budget:.4f}")
    return Request(prompt, chosen, tokens, most, temperature or project.temperature or TEMPERATURE, cost, tuple(warnings))


def written(answer: str, asked: Request, form: str = "text") -> str:
    """An answer as text, Markdown or JSON."""
    if form == "json":
        return json.dumps({"model": asked.model, "prompt_tokens": asked.tokens, "output": answer}, ensure_ascii=False, indent=2)
    return f"# {asked.model}\n\n{answer}\n" if form == "markdown" else answer
