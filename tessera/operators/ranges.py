"""Running sums and places within groups of any size: groups lie in ranges over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize


def running_sums(rows: DataFrame, by: str, order: list[Column | str], values: dict[str, str]) -> DataFrame:
    """``rows`` plus, for each ``values`` entry (a column: the new name), the sum of the column over the rows of the same
    ``by`` up to this one, in the order ``order``. Null values count nothing; null is a ``by`` like others.

    Rows lie in ranges of (by, order) over all tasks, so a ``by`` with very many rows is many ranges and no
    task sees it whole. What is carried into a range belongs to the one ``by`` that goes on from the
    range before, so the table of these sums has a row a range at most, and is broadcast."""
    dealt = materialize(rows.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(by, "__range").agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(f"__{n}") for v, n in values.items()), F.lit(True).alias("__some"))
    before = W.partitionBy(by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(F.col(by).alias("__by"), F.col("__range").alias("__of"), F.max("__some").over(before).alias("__later"), *(F.sum(f"__{n}").over(before).alias(f"__{n}") for n in values.values())).where("__later").drop("__later")
    inside = W.partitionBy(by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, n in values.items()})
    joined = placed.join(F.broadcast(carried), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__of")), "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in values.values()}).select(*rows.columns, *values.values())
