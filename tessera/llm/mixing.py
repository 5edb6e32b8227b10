"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize

#: What a word is: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that count against a text: neither letters, digits, white space, full stops nor commas.
ODD = r"[^\p{L}\p{N}\s.,]"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def text_quality(text: Column, size: Column) -> Column:
    """A document's sampling weight in (0, 1]: words / (words + odd characters); 1 without words."""
    return F.when(size > 0, size / (size + F.regexp_count(F.coalesce(text, F.lit("")), F.lit(ODD)))).otherwise(F.lit(1.0))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1] that depends on ``key`` and ``seed`` alone: 48 bits of an MD5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + F.lit(1)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, n_docs, source_size) plus target: each source's words in the mix.

    Sources in code point order (null last) weigh ``weights`` in turn and share the sum of all
    sizes; a target above ``most`` times its source's size stops there and the excess is shared
    again by weight. Taken in the order of size to weight, a source is capped if its share of what
    the sources before it leave is more than its cap, so one ordered pass finds all of them. This
    works on one row a source.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    every = W.partitionBy()
    before = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    capped = ranked.withColumn("capped", left.cast("double") / open_weight * F.col("weight") > F.col("cap"))
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    share = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest.cast("double") / share * F.col("weight"))
    return capped.withColumn("target", target).select("source", "n_docs", "source_size", "target")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, quality: Column | None = None, seed: str = "mix") -> DataFrame:
    """(id, source, size, source_size, target, taken): how many words of each document the mix takes.

    A source is taken whole as often as its target holds it; what remains is filled with documents
    in the order of their Efraimidis-Spirakis keys, ``-ln(u) / weight``, until the running sum of
    sizes reaches it. The document at the border is taken if that brings the sum nearer. ``quality``
    is the weight (positive; null or not positive counts as 1e-9), by default ``text_quality``.

    The running sum needs no task that sees a whole source: keys fall into about sqrt(n) ranges a
    source, the ranges' sums are added up first and rows are ordered within their range only.

    Null text: size 0. Null source: a source of its own, last in order. Null or repeated ids: each
    row is its own document; equal keys go by id, then size. Sizes of 0 take 0. No rows: no rows.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *([] if quality is None else [quality.cast("double").alias("quality")]))
    weight = F.col("quality") if quality is not None else text_quality(F.col("text"), F.col("size"))
    weight = F.when(weight > 0, weight).otherwise(F.lit(1e-9))
    keyed = materialize(sized.select("id", "source", "size", (-F.ln(uniform(F.col("id"), seed)) / weight).alias("key")), "mix-keys")
    totals = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, most).withColumnRenamed("source", "of")
    spread = F.ceil(F.sqrt(F.col("n_docs").cast("double")))
    placed = keyed.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * spread), spread - 1).cast("long"))
    ranges = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("of"), F.col("range").alias("of_range"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    remaining = F.col("target") - epochs * F.col("source_size")
    reached = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        placed.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
        .withColumn("reached", reached)
        .select("id", "source", "size", "source_size", "target", (F.col("size") * (epochs + F.when((F.col("size") > 0) & (F.col("reached") + F.col("size") / 2 <= remaining), 1).otherwise(0))).cast("long").alias("taken"))
    )
