"""Exact medians by sketches, and sums of pairs by matrix products, against brute force."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import groups, profile
from tessera.session import run_dir


@pytest.fixture(scope="module")
def numbers(spark):
    r = random.Random(1)
    draws = [lambda: r.gauss(0, 1), lambda: float(r.randint(0, 3)), lambda: r.lognormvariate(0, 3), lambda: 5.0, lambda: r.choice([1.0, 1e9, math.inf, -math.inf])]
    rows = [(g, draws[g % 5]()) for g in range(40) for _ in range(r.choice([1, 2, 3, 7, 8, 50, 1000]) if g else 60_000)]
    nan = math.nan
    rows += [(100, nan)] * 3 + [(101, 1.0), (101, nan), (101, 2.0), (102, None), (None, 1.0)] + [(103, nan)] * 30 + [(103, float(i)) for i in range(31)]
    return rows, spark.createDataFrame(rows, "k long, x double").repartition(6).cache()


def middle(rows):
    by = {}
    for k, x in rows:
        if k is not None and x is not None:
            by.setdefault(k, []).append(x)
    by = {k: sorted(v, key=lambda x: (math.isnan(x), x)) for k, v in by.items()}
    return {k: (len(v), str(0.5 * v[(len(v) - 1) // 2] + 0.5 * v[len(v) // 2])) for k, v in by.items()}


@pytest.mark.parametrize("most", [profile.MOST_ORDERED, 5])
def test_medians(numbers, monkeypatch, most):
    """A small bound makes one more round of sketches, of the values inside the brackets."""
    monkeypatch.setattr(profile, "MOST_ORDERED", most)
    rows, table = numbers
    assert {r["k"]: (r["n"], str(r["median"])) for r in profile.medians(table, ["k"], "x").collect()} == middle(rows)


def test_medians_of_other_types(spark, numbers):
    rows, table = numbers
    whole = table.where("k % 5 < 4 AND k < 100").select("k", F.floor("x").cast("int").alias("x"), F.lit("a").alias("h"))
    expected = middle([(k, float(math.floor(x))) for k, x in rows if k is not None and k < 100 and k % 5 < 4])
    assert {r["k"]: (r["n"], str(r["median"])) for r in profile.medians(whole, ["k", "h"], "x").collect()} == expected
    assert profile.medians(table.limit(0), ["k"], "x").count() == 0


def test_medians_shuffle_what_is_between(numbers):
    """Of 60,000 numbers only some hundred reach the step that orders them, and no file is written."""
    plan = profile.medians(numbers[1].where("k = 0"), ["k"], "x")
    folder = run_dir(plan.sparkSession).removeprefix("file://")
    before = sorted(os.listdir(folder)) if os.path.exists(folder) else []
    plan.collect()
    assert (sorted(os.listdir(folder)) if os.path.exists(folder) else []) == before
    shuffled = []

    def walk(node):
        if node.nodeName() == "Exchange":
            shuffled.append(node.metrics().get("shuffleRecordsWritten").get().value())
        for child in [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)
        if "QueryStage" in node.nodeName():
            walk(node.plan())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())

    walk(plan._jdf.queryExecution().executedPlan())
    assert shuffled and max(shuffled) < 1000


def test_median_mad_and_outliers(spark, numbers):
    rows, table = numbers
    some = table.where("k < 100 AND k % 5 < 4")
    by = {}
    for k, x in rows:
        if k is not None and k < 100 and k % 5 < 4:
            by.setdefault(k, []).append(x)
    found = {r["k"]: r for r in profile.robust_outliers(some, ["k"], "x").collect()}
    assert set(found) == {k for k, v in by.items() if len(v) >= 8}
    for k, r in found.items():
        v = np.array(by[k])
        mad = np.median(np.abs(v - np.median(v)))
        z = np.abs(0.6745 * (v - np.median(v)) / mad) if mad else np.zeros(len(v))
        assert (r["n"], r["n_outliers"]) == (len(v), int((z > 3.5).sum())) and r["max_abs_z"] == pytest.approx(z.max())


COLUMNS = ["a", "b", "c d", "e", "f"]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(1)
    value = [lambda: r.gauss(0, 1)] * 3 + [lambda: float(r.randint(0, 1)), lambda: 7.0]
    rows = [(r.choice(["x", "y", None]), r.randint(0, 700), *[None if r.random() < 0.2 else v() for v in value]) for _ in range(9000)]
    rows += [("nan", 1, math.nan, 1.0, 2.0, 3.0, 1.0), ("nan", 1, 1.0, 2.0, 2.0, 5.0, 1.0), ("nan", 1, 3.0, math.inf, 5.0, 5.0, 1.0)]
    return rows, spark.createDataFrame(rows, "g string, h int, a double, b double, `c d` double, e double, f double").repartition(3)


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_pair_sums(table, by):
    rows, df = table
    expected = {}
    for row in rows:
        for i in range(5):
            for j in range(i + 1, 5):
                if row[2 + i] is not None and row[2 + j] is not None:
                    expected.setdefault((*row[: len(by)], COLUMNS[i], COLUMNS[j]), []).append((row[2 + i], row[2 + j]))
    found = {tuple(r[c] for c in [*by, "a", "b"]): r for r in groups.pair_sums(df, COLUMNS, by).collect()}
    assert set(found) == set(expected)
    for key, pairs in expected.items():
        x, y = np.array(pairs).T
        r, sums = found[key], [x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()]
        assert r["n"] == len(pairs)
        if np.isfinite(sums).all():
            assert np.allclose([r[c] for c in ("sx", "sy", "sxx", "syy", "sxy")], sums)
            assert (r["x0"], r["x1"], r["y0"], r["y1"]) == (x.min(), x.max(), y.min(), y.max())
        else:
            assert math.isnan(r["sxy"])


def test_pairs_without_rows(table):
    assert groups.pair_sums(table[1].limit(0), COLUMNS).count() == groups.pair_sums(table[1], ["a"]).count() == 0
    odd = {(r["a"], r["b"]): r["r"] for r in groups.correlation_pairs(table[1].where("g = 'nan'"), COLUMNS).collect()}
    assert odd["a", "b"] == odd["a", "e"] == odd["e", "f"] == 0 and odd["c d", "e"] == pytest.approx(0.5)
