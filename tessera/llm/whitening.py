"""Whitening of embeddings: moments of partitions merged by Chan's formula, components from the driver."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors that are worked on at once.
ROWS = 1024
#: Scaled entries beyond this (vectors of a length of 10 ** 12) count as this.
MOST = 1 << 50
LONGEST = (1 << 63) - 1

Moments = tuple[int, np.ndarray, np.ndarray, list[int]]


def is_finite(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all numbers
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """The entries c of vectors of ``dim`` entries as floor(1024 * c) + 100000."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def batch_moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean, and the scatter of the rows around their mean."""
    mean = x.mean(axis=0)
    apart = x - mean
    return len(x), mean, apart.T @ apart


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise formula: the moments of two sets of rows together. Sums are exact integers."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    mean = a[1] + apart * (b[0] / n)
    return n, mean, a[2] + b[2] + np.outer(apart, apart) * (a[0] * (b[0] / n)), [p + q for p, q in zip(a[3], b[3], strict=True)]


def moments(vectors: DataFrame, read, dim: int) -> Moments | None:
    """The moments of all rows; ``read`` gives a batch's rows as numbers, exact ones if they are integers. Every partition makes
    one row of them, and these meet in a tree of merges, so the driver gets one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = read(batch.column(0).slice(at, ROWS))
                exact = [int(s) for s in x.sum(axis=0)] if x.dtype == np.int64 else [0] * dim
                part = (*batch_moments(x.astype(np.float64)), exact)
                total = part if total is None else merged(total, part)
        if total:
            n, mean, scatter, sums = total
            columns = [pa.array([n]), pa.array([mean.tobytes()], pa.binary()), pa.array([scatter.tobytes()], pa.binary()), pa.array([list(map(str, sums))], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "mean", "scatter", "sums"])

    def known(row: Row) -> Moments:
        return row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["scatter"]).reshape(dim, dim), [int(s) for s in row["sums"]]

    def either(a: Moments | None, b: Moments | None) -> Moments | None:
        return merged(a, b) if a and b else a or b

    parts = vectors.mapInArrow(run, "n long, mean binary, scatter binary, sums array<string>")
    return parts.rdd.map(known).treeAggregate(None, either, either)


def components(fit: Moments, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of the covariance, largest first. Those without
    variance, up to rounding, are left out: nothing can be divided by them."""
    covariance = fit[2] / fit[0]
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    some = values > max(values[0], 0) * len(covariance) * 2.0**-50
    return values[some], vectors[:, some], float(np.trace(covariance))


def squared_distances(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the sum of (n * x - S) ** 2, exact; null if it is no 64-bit number."""
    most = max(n * int(np.abs(x).max()), *map(abs, sums))
    if most < LONGEST // 4:
        apart = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(apart).max()) ** 2 <= LONGEST:
            return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v <= LONGEST else None for v in exact]


def whitened(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and each of the
    first ``most`` components of all vectors, as they lie when every entry c is floor(1024 * c) + 100000.

    One pass gives count, mean and centred scatter of each partition, merged in a tree; the driver takes the components
    of one covariance; the next pass projects every vector; a last pass over the projections, with the same merges,
    gives the largest entry of their covariance minus the identity.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and so are those whose length
    is not the most frequent one (of equally frequent, the largest). Components without variance are left out: fewer
    than ``most`` rows a vector, none if all vectors are equal. A deviation that is no 64-bit number is null.
    Scaled entries beyond 2 ** 50 count as that. Null and repeated ids: each row is a vector. No vectors: no rows."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(is_finite(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    rows = rows.where(F.size("vector") == dim)
    fit = moments(rows.select("vector"), partial(integers, dim=dim), dim)
    n, _, _, sums = fit
    mean = np.array([s / n for s in sums])
    values, directions, trace = components(fit, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    projection = directions / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = integers(batch.column(1), dim)
                out = (x - mean) @ projection
                lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squared_distances(x, n, sums), pa.int64()), lists], ["vec_id", "deviation", "values"])

    projected = materialize(rows.mapInArrow(project, "vec_id long, deviation long, values array<double>"), "whitened")
    width = len(values)
    check = moments(projected.select("values"), lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), width)
    error = float(np.abs(check[2] / n - np.eye(width)).max())
    shares = F.array(*(F.lit(float(v / trace)) for v in values))
    long = projected.select("vec_id", "deviation", F.posexplode("values").alias("place", "whitened"))
    return long.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))
