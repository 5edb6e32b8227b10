"""Turns of conversations in order, and conversations that share their first turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import running_sums
from tessera.session import materialize


def turn_key(role: Column, text: Column) -> Column:
    """32 bytes that stand for a turn's role and text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def placed_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, key, bytes) of every turn: its place from 1, what stands for role and text, and the
    UTF-8 bytes of the text. Turns go by number (null first), ties by role, then by key. Null
    roles and texts are empty; rows without a conversation are left out."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).alias("one"))
    placed = running_sums(rows.where("conv_id is not null"), "conv_id", [F.col("turn").asc_nulls_first(), "role", "key"], {"one": "depth"})
    return placed.select("conv_id", "depth", "key", "bytes")


def with_shared_heads(placed: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv_id, depth, key, bytes), and all their ids: conversation c
    begins with the first h turns of c - c % group and goes on with its own after its first h, where h
    is crc32 of the decimal id, modulo most + 1. Another conversation gives ``most`` turns to fewer than
    2 * group, so the rows grow by a factor at most."""
    placed = materialize(placed, "placed-turns")
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most + 1))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), heads.alias("own_from"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), "size"), "base", "left")
    convs = materialize(convs.withColumn("shared", F.least("own_from", F.coalesce("size", F.lit(0)))).drop("size"), "rebuilt")
    tails = placed.join(convs, "conv_id").where("depth > own_from").withColumn("depth", F.col("depth") - F.col("own_from") + F.col("shared"))
    shared = placed.where(F.col("depth") <= most).withColumnRenamed("conv_id", "base").join(convs, "base").where("depth <= shared")
    columns = ["conv_id", "depth", "key", "bytes"]
    return tails.select(columns).unionByName(shared.select(columns)), convs.select("conv_id")
