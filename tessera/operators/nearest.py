"""Exact nearest neighbours of many queries: matrix products of Arrow batches, pruned by bounds of their centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Rows and queries of one matrix product.
ROWS, QUERIES = 2048, 1024
#: What a product of unit vectors may be off by, and more.
MARGIN = 1e-9
#: Pairs whose similarity is worked out in one go.
PAIRS = 1 << 18


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, added up from the first entry to the last, as the JVM does: equal vectors have equal sums."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


@dataclass
class Vectors:
    """The vectors of one length: which rows of a column, their entries, lengths and directions."""

    at: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    unit: np.ndarray


def usable(column: pa.Array) -> dict[int, Vectors]:
    """By length: vectors that are neither null, empty nor zero and whose entries are all finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        with np.errstate(all="ignore"):
            norm = np.sqrt(_folded(x, x))
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            out[dim] = Vectors(at[good], x[good], norm[good], x[good] / norm[good, None])
    return out


def reachable(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each query a bound of its cosine with any of the rows: these lie around their centroid within an angle."""
    center = rows.sum(axis=0)
    length = np.sqrt(center @ center)
    if length < MARGIN:
        return np.ones(len(queries))
    center /= length
    radius = np.arccos(np.clip((rows @ center).min() - MARGIN, -1, 1))
    return np.cos(np.maximum(np.arccos(np.clip(queries @ center, -1, 1)) - radius, 0)) + MARGIN


#: Vectors that centroids are fitted on, at most, and rounds of moving them.
SAMPLE, MOVES = 20_000, 8


def centroids(units: np.ndarray, clusters: int, seed: int = 1) -> np.ndarray:
    """Unit vectors, each the mean direction of those of ``units`` that are nearest to it."""
    random = np.random.default_rng(seed)
    centers = units[random.choice(len(units), min(clusters, len(units)), replace=False)]
    for _ in range(MOVES):
        nearest = (units @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, units)
        length = np.sqrt((sums * sums).sum(axis=1))
        some = length > MARGIN
        centers[some] = sums[some] / length[some, None]
    return centers


def clustered(records: DataFrame, *, vector_col: str = "vector", clusters: int = 256, sample: int = SAMPLE) -> DataFrame:
    """``records`` laid out so that rows of like directions follow one another: written so, a search passes over most
    batches by their centroids. All rows stay, whatever they hold; what is found is the same.

    Centroids are fitted on at most ``sample`` rows by hash, of the most frequent length among them; each row goes
    with the nearest, rows without a direction or of another length go last."""
    spark = records.sparkSession
    found = usable(records.select(vector_col).orderBy(F.xxhash64(vector_col)).limit(sample).toArrow().column(vector_col))
    if not found:
        return records
    known = max(found.values(), key=lambda v: len(v.at))
    sent = spark.sparkContext.broadcast(centroids(known.unit, clusters))
    dim = known.x.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.full(batch.num_rows, len(sent.value), np.int32)
            mine = usable(batch.column(batch.schema.get_field_index(vector_col))).get(dim)
            if mine is not None:
                cluster[mine.at] = (mine.unit @ sent.value.T).argmax(axis=1)
            yield batch.append_column("__cluster", pa.array(cluster))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    dealt = records.mapInArrow(placed, StructType([*records.schema.fields, StructField("__cluster", IntegerType())]))
    return dealt.repartitionByRange("__cluster", F.xxhash64(vector_col)).sortWithinPartitions("__cluster").drop("__cluster")


class Best:
    """The best rows of a task so far, up to ``k`` a query, ties by the columns ``ties``."""

    def __init__(self, n: int, k: int, least: float, ties: tuple[str, ...]):
        self.k, self.ties = k, ties
        self.bound = np.full(n, least)  # what a row must reach
        self.query, self.row, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.rows: pa.Table | None = None

    def add(self, batch: pa.RecordBatch, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        reached = score >= self.bound[query]
        if not reached.any():
            return
        query, row, score = query[reached], row[reached], score[reached]
        used, row = np.unique(row, return_inverse=True)
        new = pa.Table.from_batches([batch.take(pa.array(used))])
        table = new if self.rows is None else pa.concat_tables([self.rows, new])
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        row = np.concatenate([self.row, row + (0 if self.rows is None else self.rows.num_rows)])
        place = np.empty(table.num_rows, np.int64)
        place[pc.sort_indices(table, sort_keys=[(c, "ascending") for c in self.ties], null_placement="at_start").to_numpy() if self.ties else np.arange(table.num_rows)] = np.arange(table.num_rows)
        order = np.lexsort((place[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.bound[query[last]] = score[last]
        kept = rank < self.k
        self.query, self.score = query[kept], score[kept]
        used, self.row = np.unique(row[kept], return_inverse=True)
        self.rows = table.take(pa.array(used)).combine_chunks()


def search_block(records: DataFrame, queries: DataFrame, *, k: int, least: float, vector_col: str, query_col: str, ties: tuple[str, ...]) -> DataFrame:
    """The columns of ``records`` and ``queries`` and ``score``: the best ``k`` rows of each task for each query.

    ``queries`` is a block of bounded size, sent to the tasks once. A batch that, by its centroid, can't reach a query's k-th best so far is
    passed over for it; for the others one product of unit vectors finds candidates, whose exact score is then worked out.
    Vectors that are null, empty, zero, of another length or not finite have the score 0."""
    spark = records.sparkSession
    sent = spark.sparkContext.broadcast(queries.toArrow())
    schema = StructType([*records.schema.fields, *queries.schema.fields, StructField("score", DoubleType())])

    def candidates(rows: Vectors, known: Vectors, best: Best) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for lo in range(0, len(known.at), QUERIES):
            mine = np.arange(lo, min(lo + QUERIES, len(known.at)))
            bound = best.bound[known.at[mine]] - MARGIN
            near = reachable(rows.unit, known.unit[mine]) >= bound
            mine, bound = mine[near], bound[near]
            if not len(mine):
                continue
            about = known.unit[mine] @ rows.unit.T
            close = about >= bound[:, None]
            if len(rows.at) > k and close.sum() > 4 * k * len(mine):
                close &= about >= np.partition(about, -k, axis=1)[:, -k, None] - MARGIN
            i, j = np.nonzero(close)
            for at in range(0, len(i), PAIRS):
                q, r = mine[i[at : at + PAIRS]], j[at : at + PAIRS]
                yield known.at[q], rows.at[r], _folded(rows.x[r], known.x[q]) / (rows.norm[r] * known.norm[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        known, n = usable(asked.column(query_col)), asked.num_rows
        best = Best(n, k, least, ties)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = usable(batch.column(batch.schema.get_field_index(vector_col)))
                for dim in rows.keys() & known.keys():
                    for found in candidates(rows[dim], known[dim], best):
                        best.add(batch, *found)
                if least <= 0 and (best.bound <= 0).any():
                    met = np.zeros((n, batch.num_rows), bool)
                    for dim in rows.keys() & known.keys():
                        met[np.ix_(known[dim].at, rows[dim].at)] = True
                    met[best.bound > 0] = True
                    i, j = np.nonzero(~met)
                    best.add(batch, i, j, np.zeros(len(i)))
        if best.rows is not None:
            for at in range(0, len(best.query), ROWS):
                part = slice(at, at + ROWS)
                rows, of = best.rows.take(pa.array(best.row[part])), asked.take(pa.array(best.query[part]))
                columns = [c.combine_chunks() for c in (*rows.columns, *of.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best.score[part])], schema=pa.schema([*rows.schema, *of.schema, pa.field("score", pa.float64())]))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return records.mapInArrow(run, schema)


def best_of(found: DataFrame, query_id: str, ties: tuple[str, ...], k: int) -> DataFrame:
    """The best ``k`` rows of each query among those of all tasks, with their place."""
    place = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), *ties))
    return found.withColumn("place", place).where(F.col("place") <= k)
