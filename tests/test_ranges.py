"""Running sums in ranges, and prompts of projects with very many documents."""

import random

from pyspark.sql import functions as F

from tessera.operators import prompts
from tessera.operators.ranges import running_sums


def test_running_sums_of_a_hot_group(spark):
    r = random.Random(1)
    rows = [(1 if r.random() < 0.6 else r.choice([None, *range(2, 30)]), i, r.choice([None, *range(9)])) for i in range(4000)]
    found = running_sums(spark.createDataFrame(rows, "k long, i long, v long").withColumn("one", F.lit(1)), "k", ["i"], {"v": "s", "one": "place"})
    assert found.columns == ["k", "i", "v", "one", "s", "place"]
    got, sums, places = {(x["k"], x["i"]): (x["s"], x["place"]) for x in found.collect()}, {}, {}
    for k, i, v in rows:
        sums[k], places[k] = sums.get(k, 0) + (v or 0), places.get(k, 0) + 1
        assert got[k, i] == (sums[k], places[k])
    assert running_sums(found.select("k", "i", "v").limit(0), "k", ["i"], {"v": "s"}).count() == 0


def test_places_of_a_large_project(spark):
    """Places and budgets of a project with nearly all documents go on from range to range."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, "small").otherwise("hot").alias("project"), "id", F.lit("").alias("path"), F.lit("x" * 40).alias("text"))
    found = prompts.evidence_documents(docs)
    assert found.where("project = 'hot' and place = 19800").count() == 1 and found.agg(F.max("place")).first()[0] == 19_800
    kept = prompts.within_tokens(docs, 1200)
    assert {r["project"]: r["n"] for r in kept.groupBy("project").agg(F.count("*").alias("n")).collect()} == {"hot": 100, "small": 100}
    assert kept.agg(F.max("tokens_so_far")).first()[0] == 1200


def test_quotas_come_before_texts(spark):
    rows = [("big", i, "n", "", "x" * 400) for i in range(100)] + [("fits", 2, "b", "", "B"), ("fits", 1, "a", "first", "A"), (None, 1, "z", None, None)]
    docs = spark.createDataFrame(rows, "project string, id int, name string, description string, text string")
    found = {r["project"]: r["prompt_docs"] for r in prompts.prompt_documents(docs, quota=1000).collect()}
    assert set(found) == {"big", "fits", None} and found["big"] is None
    assert found["fits"] == "--- Document: a (first) ---\nA\n\n--- Document: b ---\nB\n"
    assert prompts.prompt_documents(docs).where("project = 'big'").first()["prompt_docs"].count("---") == 200
