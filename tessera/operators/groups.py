"""Group-by summaries and correlations over long-form cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tessera.functions.text import safe_value, trim_all
from tessera.functions.values import split_unit


def group_key(table: DataFrame, names: list[str]) -> Column | None:
    """``Name=value | Name=value`` of the named columns (unit and case don't count, the last of equal
    headers does); unknown names are passed over, and None means that no name is known."""
    known = {split_unit(c)[0].lower(): c for c in table.columns}
    asked = [known[n.strip().lower()] for n in names if n.strip().lower() in known]
    parts = [F.concat(F.lit(f"{split_unit(c)[0]}="), safe_value(trim_all(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))))) for c in asked]
    return F.concat_ws(" | ", *parts) if parts else None


def group_sizes(keyed: DataFrame, key: str = "group_key") -> DataFrame:
    return keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def top_groups(keyed: DataFrame, key: str = "group_key", most: int = 20) -> DataFrame:
    """The largest groups, ties by key."""
    return group_sizes(keyed, key).orderBy(F.desc("n"), key).limit(most)


def group_numeric(long: DataFrame, key: str = "group_key", columns: DataFrame | None = None) -> DataFrame:
    """(key, name, n, min, max, mean) of the numbers of each group; of the columns in ``columns`` (pos), if given."""
    some = long if columns is None else long.join(columns.select("pos"), "pos", "left_semi")
    number = F.col("number")
    return some.where(number.isNotNull()).groupBy(key, "name").agg(F.count(number).alias("n"), F.min(number).alias("min"), F.max(number).alias("max"), (F.sum(number) / F.count(number)).alias("mean"))


def group_metrics_top(metrics: DataFrame, key: str = "group_key", most: int = 6) -> DataFrame:
    """The first metrics of each group by column name."""
    return metrics.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("name"))).where(F.col("place") <= most)


def _gram(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """(10, k, k): for every two columns a, b, over the rows where both are there: how many, the sums of a, b,
    a * a, b * b and a * b, and least and greatest a and b. Five matrix products; the sums of a
    pair with a number that is not finite are NaN."""
    odd = there & ~np.isfinite(x)
    with_number, plain = there.astype(np.float64), np.where(there & ~odd, x, 0.0)
    n, first, squares = with_number.T @ with_number, plain.T @ with_number, (plain * plain).T @ with_number
    out = np.stack([n, first, first.T, squares, squares.T, plain.T @ plain, *np.empty((4, *n.shape))])
    if odd.any():
        out[1:6, (met := odd.T.astype(np.float64) @ with_number > 0) | met.T] = np.nan
    low, high = np.where(there, x, np.inf), np.where(there, x, -np.inf)
    out[6], out[7] = low.min(axis=0)[:, None], high.max(axis=0)[:, None]
    for b in np.flatnonzero(~there.all(axis=0)):  # least and greatest depend on the other column only if that one has gaps
        out[6, :, b] = low[there[:, b]].min(axis=0, initial=np.inf)
        out[7, :, b] = high[there[:, b]].max(axis=0, initial=-np.inf)
    out[8], out[9] = out[6].T, out[7].T
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([a[:6] + b[:6], np.minimum(a[6:7], b[6:7]), np.maximum(a[7:8], b[7:8]), np.minimum(a[8:9], b[8:9]), np.maximum(a[9:], b[9:])])


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "x0", "x1", "y0", "y1")
#: Rows whose products are taken at once, and groups whose sums a task holds.
GRAM_ROWS, GRAM_GROUPS = 4096, 512


def pair_sums(table: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by, a, b, n and sums): moments of each pair of numeric columns over rows that have both.

    A task takes matrix products of some thousand rows at a time, split by group, and adds them up, so its rows are never
    expanded into pairs and only sums leave it."""
    by, k = list(by), len(columns)
    upper = np.triu_indices(k, 1)
    names = [np.array(columns, dtype=object)[i] for i in upper]
    kinds = [(c, table.schema[c].dataType) for c in by]

    def rows(sums: dict) -> Iterator[pa.RecordBatch]:
        for key, held in sums.items():
            pairs = held[:, *upper]
            some = pairs[0] > 0
            fixed = [pa.array([v.as_py()] * int(some.sum()), v.type) for v in key]
            values = [pa.array(pairs[0, some].astype(np.int64)), *(pa.array(v) for v in pairs[1:, some])]
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(n[some], pa.string()) for n in names), *values], [*by, "a", "b", *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, GRAM_ROWS):
                batch = whole.slice(at, GRAM_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(by) :]])
                there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[len(by) :]])
                keys, groups = [()], [slice(None)]
                if by:
                    codes = np.zeros(batch.num_rows, np.int64)
                    for of in (batch.column(i).dictionary_encode("encode") for i in range(len(by))):
                        codes = codes * max(len(of.dictionary), 1) + of.indices.to_numpy()
                    order = np.argsort(codes, kind="stable")
                    edges = np.flatnonzero(np.diff(codes[order])) + 1
                    groups = np.split(order, edges)
                    keys = [tuple(batch.column(i)[int(g[0])] for i in range(len(by))) for g in groups]
                for key, group in zip(keys, groups, strict=True):
                    part = _gram(x[group], there[group])
                    sums[key] = _joined(sums[key], part) if key in sums else part
                if len(sums) > GRAM_GROUPS:
                    yield from rows(sums)
                    sums = {}
        yield from rows(sums)

    table.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(GRAM_ROWS))
    numbers = table.select(*by, *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    schema = StructType([*(StructField(c, t) for c, t in kinds), StructField("a", StringType()), StructField("b", StringType()), StructField("n", LongType()), *(StructField(c, DoubleType()) for c in SUMS[1:])])
    found = numbers.mapInArrow(run, schema).groupBy(*by, "a", "b")
    least, greatest = [F.min(c).alias(c) for c in ("x0", "y0")], [F.max(c).alias(c) for c in ("x1", "y1")]
    return found.agg(*(F.sum(c).alias(c) for c in SUMS[:6]), *least, *greatest)


def pearson(undefined: float | None) -> Column:
    """r from ``pair_sums``, within [-1, 1]; ``undefined`` where a column doesn't vary or n < 2."""
    n = F.col("n").cast("double")
    top = n * F.col("sxy") - F.col("sx") * F.col("sy")
    under = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    ratio = top / F.sqrt(F.when(under > 0, under))
    varies = (F.col("n") >= 2) & (F.col("x0") != F.col("x1")) & (F.col("y0") != F.col("y1")) & ~F.isnan(F.coalesce(ratio, F.lit(float("nan"))))
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))).otherwise(F.lit(undefined).cast("double"))


def correlation_pairs(table: DataFrame, columns: list[str]) -> DataFrame:
    return pair_sums(table, columns).select("a", "b", "n", pearson(0.0).alias("r"))


def correlation_matrix(table: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every two columns, both ways, with 1 for a column and itself."""
    pairs = correlation_pairs(table, columns).select("a", "b", "r")
    same = table.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(same)


def top_correlations(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The strongest pairs, ties by the names put together."""
    return pairs.orderBy(F.desc(F.abs("r")), F.concat("a", "b")).limit(most)


def correlations_per_group(table: DataFrame, columns: list[str], key: str = "group_key", most: int = 10) -> DataFrame:
    """The strongest pairs of each group; pairs without a correlation are left out."""
    pairs = pair_sums(table, columns, [key]).select(key, "a", "b", pearson(None).alias("r")).where("r is not null")
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("r")), F.concat("a", "b")))
    return pairs.withColumn("place", place).where(F.col("place") <= most)
