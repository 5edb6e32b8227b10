"""Helpers that the Arrow functions of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, release

#: Rows a batch that goes to Python: texts may be long, and a task holds one batch at a time.
BATCH_ROWS = 256


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``function`` over Arrow batches of at most ``rows`` rows; Spark partitions as before. What the
    session says about batches when the job starts doesn't matter: larger ones are cut here."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                out = function(whole.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
                del out
                pa.default_memory_pool().release_unused()  # a worker lives on; what one long text took should not
            del whole

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, by: tuple[str, ...], function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, tasks: int) -> DataFrame:
    """``function`` over the rows in groups of ``by``, one group after another, in ``tasks`` tasks or as many
    as the session's shuffles have: work that grows faster than bytes isn't left to the merging of
    small partitions."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    return df.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(function, schema)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def lists(of: np.ndarray, n: int, **columns: np.ndarray) -> pa.Array:
    """A list of structs for each of n texts; ``of`` (sorted) is each struct's text."""
    structs = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), structs)


#: Hashes of 8 bytes that are sent to every task at most: 8 MB.
MOST_SENT = 1 << 20


def sorted_out(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` whose ``key`` may be among those of ``known``, and the rows whose key is not, for joins that
    concern few of many long rows: hashes of the keys are sent to the tasks, so the others are never
    shuffled. If there are more than ``MOST_SENT`` all rows may be, and None stands for no others."""
    few = materialize(known.select(F.xxhash64(key).alias("hash")).distinct(), "hashes")
    if few.count() > MOST_SENT:
        release(few)
        return rows, None
    is_one = F.xxhash64(rows[key]) == F.col("hash")
    return rows.join(F.broadcast(few), is_one, "left_semi"), rows.join(F.broadcast(few), is_one, "left_anti")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 when divided by 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def row_uid(id_: Column, text: Column) -> Column:
    """16 bytes that stand for a row's id and text: too many for two rows of any corpus to meet by chance."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers stirred so that every bit of the input touches all bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
