"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node reached.

    A round moves every node to the smallest of its neighbours and itself, and on to where that one
    moves; links then join what their ends have moved to, and those within one node go. So links
    become fewer from round to round, and the rounds grow with the logarithm of the longest path. All
    grouping is a minimum, which is taken before the shuffle, and a node with very many links is
    split by the skew join. Each round is written, so a lost executor costs tasks of one round. Null
    ends are passed over.
    """
    links = materialize(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("a").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        moves = materialize(ends.groupBy("node").agg(F.min("to").alias("to")), "moves")
        further = moves.select(F.col("node").alias("to"), F.col("to").alias("further"))
        near, moves = moves, materialize(moves.join(further, "to").select("node", F.col("further").alias("to")), "moves")
        release(near)
        before = links, moves, labels
        if labels is None:
            labels = materialize(moves.withColumnRenamed("to", "component"), "labels")
        else:
            after = labels.join(moves.select(F.col("node").alias("component"), "to"), "component", "left")
            labels = materialize(after.select("node", F.coalesce("to", "component").alias("component")), "labels")
        moved = lambda end: moves.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
        joined = links.where("a < b").join(moved("a"), "a").join(moved("b"), "b").where("a_to <> b_to")
        links = materialize(joined.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
        release(*(x for x in before if x is not None))
        if links.isEmpty():
            release(links)
            return labels


def numbered(things: DataFrame, key: str) -> DataFrame:
    """``things`` (one row a ``key``, with its smallest id as ``rep``) with that id as ``least`` too, and
    a ``rep`` of its own for each: the id if no two have the same, else the places in the order of
    (id, key), so that the smallest of several still has the smallest id. A null ``rep`` stays."""
    known = things.withColumn("least", F.col("rep"))
    if known.where("rep is not null").groupBy("rep").count().where("count > 1").isEmpty():
        return known
    order = known.repartitionByRange("least", key).sortWithinPartitions("least", key).withColumn("place", F.monotonically_increasing_id())
    return materialize(order.withColumn("rep", F.when(F.col("rep").isNotNull(), F.col("place"))).drop("place"), "numbered")
