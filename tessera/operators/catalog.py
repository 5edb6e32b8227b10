"""Catalogs of models: context sizes and prices."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "name string, context_tokens int, input_per_k double, output_per_k double"
# Name, tokens of context, dollars for 1000 tokens of input and of output.
MODELS = [
    ("deepseek/deepseek-r1:free", 128000, 0.0, 0.0),
    ("openai/gpt-4o-mini", 128000, 0.0006, 0.0024),
    ("openai/gpt-4o", 128000, 0.005, 0.015),
    ("openai/gpt-4.1-mini", 128000, 0.0005, 0.0015),
    ("anthropic/claude-3.5-sonnet", 200000, 0.003, 0.015),
    ("anthropic/claude-3-haiku", 200000, 0.00025, 0.00125),
    ("google/gemini-1.5-flash", 1000000, 0.0002, 0.0008),
    ("google/gemini-1.5-pro", 1000000, 0.00125, 0.005),
    ("meta-llama/llama-3.1-8b-instruct", 131072, 0.0, 0.0),
    ("meta-llama/llama-3.1-70b-instruct", 131072, 0.0, 0.0),
    ("llama3:latest", 8192, 0.0, 0.0),
    ("llama3.1:8b-instruct", 8192, 0.0, 0.0),
    ("llama3.1:70b-instruct", 8192, 0.0, 0.0),
    ("mistral-nemo:latest", 8192, 0.0, 0.0),
    ("mistral:7b-instruct", 8192, 0.0, 0.0),
    ("phi3:mini-4k-instruct", 4096, 0.0, 0.0),
    ("phi3:mini-128k-instruct", 128000, 0.0, 0.0),
]
# The models of each provider's preset, and the model of each tier.
_OPENROUTER = ["anthropic/claude-3.5-sonnet", "openai/gpt-4o-mini", "openai/gpt-4o", "openai/gpt-4.1-mini", "deepseek/deepseek-r1:free"]
_GOOGLE = ["google/gemini-1.5-flash", "google/gemini-1.5-pro"]
_META = ["meta-llama/llama-3.1-8b-instruct", "meta-llama/llama-3.1-70b-instruct"]
_LOCAL = [name for name, *_ in MODELS[10:]]
PRESETS = {"openrouter": _OPENROUTER, "openai": ["openai/gpt-4o", "openai/gpt-4o-mini"], "anthropic": ["anthropic/claude-3.5-sonnet"], "google": _GOOGLE, "gemini": _GOOGLE, "meta": _META, "llama": _META, "ollama": _LOCAL, "local": _LOCAL}
TIERS = {
    "cheap": {"openrouter": "deepseek/deepseek-r1:free", "openai": "openai/gpt-4o-mini", "anthropic": "anthropic/claude-3-haiku", "google": "google/gemini-1.5-flash", "meta": "meta-llama/llama-3.1-8b-instruct"},
    "balanced": {"openrouter": "openai/gpt-4o", "openai": "openai/gpt-4o", "anthropic": "anthropic/claude-3.5-sonnet", "google": "google/gemini-1.5-pro", "meta": "meta-llama/llama-3.1-70b-instruct"},
    "high-context": {"openrouter": "anthropic/claude-3.5-sonnet", "openai": "openai/gpt-4o", "anthropic": "anthropic/claude-3.5-sonnet", "google": "google/gemini-1.5-pro", "meta": "meta-llama/llama-3.1-70b-instruct"},
}
ALIASES = {"gemini": "google", "llama": "meta", "": "openrouter"}


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, SCHEMA)


def preset(spark: SparkSession, provider: str) -> DataFrame | None:
    """The models of a provider's preset; None for an unknown provider."""
    names = PRESETS.get(provider)
    return None if names is None else builtin(spark).where(F.col("name").isin(names))


def recommended(provider: str, tier: str) -> str | None:
    return TIERS.get(tier, {}).get(ALIASES.get(provider, provider))


def recommendations(requests: DataFrame, provider: str = "provider", tier: str = "tier") -> DataFrame:
    """Requests with the model that their provider and tier recommend, null where there is none. The table of
    recommendations has a row for each provider of each tier."""
    known = [(t, p, m) for t, models in TIERS.items() for p, m in models.items()]
    table = requests.sparkSession.createDataFrame(known + [(t, a, m) for t, p, m in known for a, b in ALIASES.items() if b == p], "tier string, provider string, model string")
    named = table.select(F.col("tier").alias("__tier"), F.col("provider").alias("__provider"), "model")
    return requests.join(F.broadcast(named), (F.col(tier) == F.col("__tier")) & (F.col(provider) == F.col("__provider")), "left").drop("__tier", "__provider")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file: an object of models by name."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    rows = [(v.get("Name") or k, int(v.get("ContextTokens", 0)), float(v.get("InputPerK", 0)), float(v.get("OutputPerK", 0))) for k, v in json.loads(text).items()]
    return spark.createDataFrame(rows, SCHEMA)


def listed(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("name")


def merge(base: DataFrame, update: DataFrame) -> DataFrame:
    """Both catalogs; of a name in both, the entry of ``update``."""
    both = base.withColumn("priority", F.lit(0)).unionByName(update.withColumn("priority", F.lit(1)))
    place = F.row_number().over(W.partitionBy("name").orderBy(F.desc("priority")))
    return both.withColumn("place", place).where("place = 1").drop("priority", "place")


def cost(prompt: Column, completion: Column) -> Column:
    """Dollars for tokens of prompt and completion, at the prices of a joined catalog row; 0 if unknown."""
    return F.coalesce(prompt / F.lit(1000.0) * F.col("input_per_k") + completion / F.lit(1000.0) * F.col("output_per_k"), F.lit(0.0))


def with_prices(requests: DataFrame, catalog: DataFrame, model_col: str = "model") -> DataFrame:
    """Requests with their model's catalog row, nulls for unknown models. A catalog is small by nature;
    Spark broadcasts it if its size says so."""
    return requests.join(catalog, F.col(model_col) == F.col("name"), "left").drop("name")


def chosen_model(flag: Column, project: Column, config: Column, default: str) -> Column:
    """The first that is not empty."""
    named = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(named(flag), named(project), named(config), F.lit(default))


def budget_exceeded(cost_: Column, budget: Column) -> Column:
    return (budget > 0) & (cost_ > 0) & (cost_ > budget)


def context_state(prompt: Column, most: Column, limit: Column, is_local: Column) -> Column:
    """``ok``; ``warn`` or, for local models, ``error`` where prompt and answer exceed the context; unknown limits pass."""
    over = F.coalesce((limit > 0) & (prompt + most > limit), F.lit(False))
    return F.when(~over, "ok").when(is_local, "error").otherwise("warn")
