"""The training-corpus pipeline: five of the numbered operators, one after another, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, minhash, mixing, quality, suffixes
from tessera.session import materialize


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good_documents(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.one_of_each(docs)


#: A passage of fifty words takes about 300 bytes in the languages at hand, so strings of 256 are looked for.
PASSAGE_BYTES = 256


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE_BYTES`` that an earlier document has, or this one further up, are cut out of
    the texts; the first copy of what repeats stays in the corpus."""
    return suffixes.trimmed_documents(docs, window=PASSAGE_BYTES, keep_first=True)


def _contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items cover to a twentieth go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    mixed = mixing.mix(docs)
    return mixed.withColumnRenamed("id", "doc_id").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", _quality), ("near_copies", _near_copies), ("repeats", _repeats), ("decontaminate", _contaminated), ("mix", _mixed)]

#: A fitted model, sketches and transforms have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
