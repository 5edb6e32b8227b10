"""Profiles of tables: what each column holds, in one pass over long-form cells.

A column's cells are classified and counted with partial aggregation, so what is shuffled is one row a
column and task, whatever the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, IntegerType, LongType, ShortType

from tessera.functions.text import sample_cell, trim_all
from tessera.functions.values import UNIT_TARGETS, convert_unit, is_datetime, plain_number, split_unit, to_number

#: Texts of more bytes are not counted as categories.
CATEGORY_BYTES = 64
#: Ranks in a quantile sketch are off by a share of 1 / ACCURACY at most.
ACCURACY, STEPS = 10_000, 64
#: Where a sketch is asked: close around the middle, and in steps over all.
POINTS = tuple(sorted({i / STEPS for i in range(STEPS + 1)} | {0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY}))
#: Values between two points of a sketch that a task may put in order.
MOST_ORDERED = 1_000_000


@dataclass(frozen=True)
class ProfileOptions:
    """Defaults as documented for reports; 0 rows or columns means all."""

    max_rows: int = 1000
    max_columns: int = 50
    sample_rows: int = 5
    group_by: tuple[str, ...] = ()
    correlations: bool = False
    correlations_per_group: bool = False
    outliers: bool = False
    outlier_threshold: float = 3.5
    decimal: str | None = None
    thousands: str | None = None
    unit_targets: dict[str, str] = field(default_factory=lambda: dict(UNIT_TARGETS))


def capped_columns(table: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """The first ``most`` columns, and a warning if that drops any."""
    dropped = len(table.columns) - most
    if most <= 0 or dropped <= 0:
        return table, []
    return table.select(table.columns[:most]), [f"dropped {dropped} column(s) due to MaxColumns limit"]


def first_rows(table: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows in the order of ``order``: a top-n, not a sort of the table. 0: all rows."""
    return table.orderBy(*order).limit(most) if most > 0 else table


def row_counts(table: DataFrame, most: int) -> DataFrame:
    """(rows, processed): all rows are counted, the first ``most`` are processed."""
    processed = F.least(F.count(F.lit(1)), F.lit(most).cast("long")) if most > 0 else F.count(F.lit(1))
    return table.agg(F.count(F.lit(1)).alias("rows"), processed.alias("processed"))


def head_sample(table: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """Sample rows as they are, long cells cut. A negative number means five."""
    cells = [sample_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in table.columns]
    return table.orderBy(*order).limit(5 if rows < 0 else rows).select(cells)


def strings(table: DataFrame) -> DataFrame:
    return table.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in table.columns])


def typed_number(table: DataFrame, header: str) -> Column:
    """A column's finite numbers where its type says that it has numbers, which need no parsing and are in no locale; else null."""
    number, kind = F.col(f"`{header}`"), table.schema[header].dataType
    if isinstance(kind, DoubleType):
        return F.when(F.abs(number) < float("inf"), number)
    return number.cast("double") if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)) else F.lit(None).cast("double")


def cells(table: DataFrame, options: ProfileOptions = ProfileOptions(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(pos, name, unit, value, number, kind) of every cell, and the columns ``keep``; number is in the
    target unit, kind is missing, numeric, datetime or text. Only cells that ``typed_number`` doesn't know are parsed."""
    entries, converted = [], F.col("plain_number")
    for pos, header in enumerate(c for c in table.columns if c not in keep):
        name, unit = split_unit(header)
        _, shown = convert_unit(F.col("plain_number"), unit, options.unit_targets)
        if shown != unit:
            converted = F.when(F.col("pos") == pos, convert_unit(F.col("plain_number"), unit, options.unit_targets)[0]).otherwise(converted)
        entries.append(F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), F.lit(shown).alias("unit"), F.coalesce(F.col(f"`{header}`").cast("string"), F.lit("")).alias("raw"), typed_number(table, header).alias("typed")))
    # step by step, so that each step's expression is evaluated once a cell
    long = table.select(*(F.col(f"`{c}`") for c in keep), F.inline(F.array(*entries))).withColumn("value", F.when(F.col("typed").isNotNull(), F.col("raw")).otherwise(trim_all(F.col("raw")))).drop("raw")
    untyped = F.col("typed").isNull()
    long = long.withColumn("plain", F.when(untyped, plain_number(F.col("value"), options.decimal, options.thousands)))
    long = long.withColumn("plain_number", F.when(untyped, to_number(F.col("plain"))).otherwise(F.col("typed")))
    kind = F.when(F.col("value") == "", "missing").when(F.col("plain_number").isNotNull(), "numeric").when(is_datetime(F.col("value")), "datetime").otherwise("text")
    return long.withColumn("kind", kind).withColumn("number", converted).drop("typed", "plain", "plain_number")


def is_category(value: Column, kind: Column) -> Column:
    return (kind == "text") & (F.octet_length(value) <= CATEGORY_BYTES)


def of_kind(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def column_summary(long: DataFrame) -> DataFrame:
    """A row a column: counts, votes, kind, unit, and the moments of its numbers.

    The kind is the majority's; ties go to numbers, then dates. A column with any short text that is
    neither is categorical. Minimum and maximum pass over NaN; the deviation of one number is 0."""
    number = F.col("number")
    finite = F.when(~F.isnan(number), number)
    votes = long.groupBy("pos", "name").agg(
        F.max("unit").alias("unit"), F.count_if(F.col("kind") != "missing").alias("non_null"), of_kind("missing").alias("missing"),
        of_kind("numeric").alias("n_numeric"), of_kind("datetime").alias("n_datetime"), of_kind("text").alias("n_text"),
        F.count_if(is_category(F.col("value"), F.col("kind"))).alias("n_category"), F.max(F.contains("value", F.lit("%"))).alias("percent"),
        F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(number).alias("mean"), F.coalesce(F.stddev_samp(number), F.when(F.count(number) > 0, 0.0)).alias("std"),
    )
    a, b, c = (F.col(f"n_{x}") for x in ("numeric", "datetime", "text"))
    kind = F.when((a > 0) & (a >= b) & (a >= c), "numeric").when((b > 0) & (b >= c), "datetime").when(F.col("n_category") > 0, "categorical").when(c > 0, "text").otherwise("unknown")
    return votes.withColumn("kind", kind).withColumn("unit", F.when((F.col("unit") == "") & F.col("percent"), "%").otherwise(F.col("unit"))).drop("percent")


def category_counts(long: DataFrame) -> DataFrame:
    """(pos, name, value, n) of the short texts of each column."""
    return long.where(is_category(F.col("value"), F.col("kind"))).groupBy("pos", "name", "value").agg(F.count(F.lit(1)).alias("n"))


def category_unique(long: DataFrame) -> DataFrame:
    return category_counts(long).groupBy("pos", "name").agg(F.count(F.lit(1)).alias("n_unique"))


def top_values(long: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent categories of each column, ties by value."""
    place = F.row_number().over(W.partitionBy("pos").orderBy(F.desc("n"), "value"))
    return category_counts(long).withColumn("place", place).where(F.col("place") <= most)


def text_examples(table: DataFrame, column: str, order: list[str], most: int = 3) -> DataFrame:
    """The first non-empty texts of a column in row order, repeats included."""
    value = trim_all(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))
    return table.select(*order, value.alias("value")).where("value <> ''").orderBy(*order).limit(most)


def examples_by_column(table: DataFrame, columns: dict[int, str], order: list[str], most: int = 3) -> DataFrame:
    """(pos, place, value): ``text_examples`` of several columns, in one pass; each task keeps ``most`` a column."""
    entries = [F.struct(F.lit(pos).alias("pos"), trim_all(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("value")) for pos, c in columns.items()]
    named = [F.col(c).alias(f"__order{i}") for i, c in enumerate(order)]
    long = table.select(*named, F.inline(F.array(*entries))).where("value <> ''")
    place = F.row_number().over(W.partitionBy("pos").orderBy(*(f"__order{i}" for i in range(len(order)))))
    return long.withColumn("place", place).where(F.col("place") <= most).select("pos", "place", "value")


def bracket(sketch: Column, n: Column, below: Column, inside: Column) -> tuple[Column, Column]:
    """The two points of a sketch of ``inside`` values between which the middle ones of ``n`` lie, if ``below``
    values are smaller than all of them; null where the sketch has no such point."""
    points = F.array(*map(F.lit, POINTS))
    apart = F.lit(1.5 / ACCURACY)  # more than a rank's error
    first, last = (n + 1 - (n + 1) % 2) / 2, (n - n % 2) / 2 + 1
    under = F.size(F.filter(points, lambda p: p <= (first - below) / inside - apart))
    upto = F.size(F.filter(points, lambda p: p < (last - below) / inside + apart)) + 1
    some = inside > 0
    return F.when(some & (under > 0), F.try_element_at(sketch, under)), F.when(some, F.try_element_at(sketch, upto))


def medians(numbers: DataFrame, by: list[str], value: str, largest: int | None = None) -> DataFrame:
    """(by, n, median): exact medians of the numbers of each ``by`` that is not null; null
    numbers are passed over, NaN is above all.

    A quantile sketch of each group, added up from sketches of tasks, gives two values that have the middle
    between them, a few ten-thousandths of the group apart. The next pass counts what is below and each value
    between, so only these are shuffled. Groups of more than about 10 ** 9 numbers are narrowed again,
    as often as ``largest`` (the largest group's size, counted if it isn't given) asks for, so that what one task
    orders is bounded. The counts are exact: should a sketch ever be worse than its bound, that is
    an error, never another median. Nothing is written."""
    v = F.col("v")
    rows = numbers.select(*by, F.col(value).alias("v")).where(F.col(value).isNotNull() & reduce(and_, [F.col(c).isNotNull() for c in by], F.lit(True)))
    if largest is None:
        largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    number = lambda x: F.when(~F.isnan(x), x)
    sketch = lambda x: (F.count(number(x)).alias("inside"), F.percentile_approx(number(x), list(POINTS), ACCURACY).alias("sketch"))
    found = rows.groupBy(*by).agg(F.count(v).alias("n"), *sketch(v)).withColumn("below", F.lit(0).cast("long"))
    above, under = F.col("lo").isNull() | (v >= F.col("lo")), F.col("hi").isNull() | (v <= F.col("hi"))
    left = largest * 7 / ACCURACY
    while True:
        lo, hi = bracket(F.col("sketch"), F.col("n"), F.col("below"), F.col("inside"))
        placed = rows.join(found.select(*by, "n", lo.alias("lo"), hi.alias("hi")), by)
        if left <= MOST_ORDERED:
            break
        found = placed.groupBy(*by).agg(F.first("n").alias("n"), F.count_if(~above).alias("below"), *sketch(F.when(above & under, v)))
        left *= 3 / STEPS
    counted = placed.where(under).groupBy(*by, "n", F.when(above, v).alias("v")).agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(W.partitionBy(*by).orderBy(v.asc_nulls_first()))
    rank = lambda r: F.min(F.when((F.col("upto") >= r) & v.isNotNull(), v.cast("double")))
    first, last = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    ordered = counted.withColumn("upto", upto).groupBy(*by).agg(F.first("n").alias("n"), F.coalesce(F.max(F.when(v.isNull(), F.col("times"))), F.lit(0)).alias("below"), F.max("upto").alias("reached"), (0.5 * rank(first) + 0.5 * rank(last)).alias("median"))
    sure = (F.col("below") < first) & (F.col("reached") >= last)
    return ordered.select(*by, "n", F.when(sure, F.col("median")).otherwise(F.raise_error(F.lit("a sketch missed its middle")).cast("double")).alias("median"))


def median_mad(numbers: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median and median absolute deviation of ``value`` for each ``by`` that is not null."""
    numbers = numbers.where(F.col(value).isNotNull())
    largest = numbers.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    median = medians(numbers, by, value, largest)
    around = numbers.join(median.select(*by, "median"), by)
    mad = medians(around.select(*by, F.abs(F.col(value) - F.col("median")).alias("apart")), by, "apart", largest)
    return median.join(mad.select(*by, F.col("median").alias("mad")), by).select(*by, "n", "median", "mad")


def robust_outliers(numbers: DataFrame, by: list[str], value: str, threshold: float = 3.5) -> DataFrame:
    """(by, n, n_outliers, max_abs_z, threshold): robust z scores above the threshold, where there are
    eight numbers or more; none where the deviation is 0."""
    threshold = threshold if threshold > 0 else 3.5
    known = median_mad(numbers, by, value).where("n >= 8")
    score = F.when(F.col("mad") > 0, F.abs(0.6745 * (F.col(value) - F.col("median")) / F.col("mad"))).otherwise(F.lit(0.0))
    scored = numbers.where(F.col(value).isNotNull()).join(known, by).withColumn("z", score)
    return scored.groupBy(*by).agg(F.first("n").alias("n"), F.count_if(F.col("z") > threshold).alias("n_outliers"), F.max("z").alias("max_abs_z"), F.lit(float(threshold)).alias("threshold"))
