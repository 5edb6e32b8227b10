"""The prefix trie of conversations, built level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import running_sums
from tessera.session import materialize, release

#: Ids that go into one piece of text before digests are taken.
PIECE = 8192
SEQUENCE = ("len", "a", "b")


def id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (len, a, b, conv_id) in order as (len, a, b, conv_id, n, ids): neighbours of one sequence as
    one text of their ids, of ``PIECE`` ids at most; conv_id is the first."""
    for whole in batches:
        for at in range(0, whole.num_rows, PIECE):
            columns = [c.to_pylist() for c in whole.slice(at, PIECE).columns]
            keys, ids = list(zip(*columns[:3], strict=True)), columns[3]
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            out = [(*keys[i], ids[i], j - i, ",".join(map(str, ids[i:j]))) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*SEQUENCE, "conv_id", "n", "ids"])


def id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, len, n, ends_sha256) from pieces in order: a sequence's smallest id, how many have it, and the
    digest of all ids. The digest takes piece after piece; none is held."""
    key = digest = first = None
    n = 0
    for batch in batches:
        done = []
        for *at, conv, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at == key:
                digest.update(b"," + ids.encode())
                n += count
                continue
            if key:
                done.append((first, key[0], n, digest.hexdigest()))
            key, first, n, digest = at, conv, count, hashlib.sha256(ids.encode())
        if done:
            yield sequence_batch(done)
    if key:
        yield sequence_batch([(first, key[0], n, digest.hexdigest())])


def sequence_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "len", "n", "ends_sha256"])


def distinct_sequences(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, len, n, ends_sha256): each different sequence of turns once, with the smallest conversation
    that has it, their number, and the digest of their ids in order.

    A sequence is told by its length and 128 bits that are added up over its turns before the shuffle,
    so neither a long conversation nor a group of copies comes together in a task: the ids
    of copies lie in ranges, each range gives texts of ids, and only these meet."""
    a, b = F.xxhash64("depth", "key"), F.xxhash64("key", F.lit("second"), "depth")
    known = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"))
    members = conversations.join(known, "conv_id", "left").select(*(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SEQUENCE), "conv_id")
    pieces = members.repartitionByRange(*SEQUENCE, "conv_id").sortWithinPartitions(*SEQUENCE, "conv_id").mapInArrow(id_pieces, "len long, a long, b long, conv_id long, n long, ids string")
    return pieces.repartition(*SEQUENCE).sortWithinPartitions(*SEQUENCE, "conv_id").mapInArrow(id_digests, "conv_id long, len long, n long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a
    node of the trie of ``conversations`` (conv_id, each once), whose ``turns`` are (conv_id, depth from 1,
    key, bytes), one a depth without gaps.

    A node is told by its depth and its smallest conversation. Conversations with all turns alike are one with a
    number first. Then the levels: those that share their node with others are grouped by it and their
    next key, the smallest id names the new node, and the grouping is joined back. Who is alone in a
    node leaves the rounds: what follows is a chain, whose nodes are known from its turns. So there
    are as many rounds as the longest prefix that different conversations share. Back from the
    deepest level, leaves and savings are added up by parent and joined to the level above. Every level
    is written. Groups are minima and sums, taken before the shuffle, so a first turn that a third
    of all have is no burden; the join back splits it.

    Conversations without turns end at the root. No conversations: no rows, not even a root."""
    sequences = materialize(distinct_sequences(turns, conversations), "sequences")
    rows = materialize(turns.join(sequences.select("conv_id", "len", "n"), "conv_id"), "sequence-turns")
    root = sequences.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("members"), F.min(F.when(F.col("len") == 0, F.col("conv_id"))).alias("ender"))
    root = root.where("members > 0").select(F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("key"), "conv_id", "n_convs", "members", F.lit(0).cast("long").alias("bytes"), "ender", F.lit(0).cast("long").alias("depth"))
    levels = [materialize(root, "level")]
    live = sequences.select("conv_id").crossJoin(F.broadcast(levels[0].where("members > 1").select(F.col("conv_id").alias("node"))))  # one row at most
    step = None
    while not levels[-1].where("members > 1").isEmpty():
        depth = len(levels)
        if step is not None:
            shared = levels[-1].where("members > 1").select("node", "key", F.col("conv_id").alias("child"))
            live = step.join(shared, ["node", "key"]).select("conv_id", F.col("child").alias("node"))
        before, step = step, materialize(rows.where(F.col("depth") == depth).join(live, "conv_id"), "step")
        level = step.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("members"), F.max("bytes").alias("bytes"), F.min(F.when(F.col("len") == depth, F.col("conv_id"))).alias("ender"))
        levels.append(materialize(level.withColumn("depth", F.lit(depth).cast("long")), "level"))
        release(*([before] if before is not None else []))
    release(*([step] if step is not None else []))

    alone = reduce(DataFrame.unionByName, [x.where("members = 1").select("conv_id", F.col("depth").alias("left_at")) for x in levels])
    chain = rows.join(alone, "conv_id").where("depth > left_at").withColumn("own", (F.col("n") - 1) * F.col("bytes"))
    chain = materialize(chain.select("conv_id", "depth", "len", "n", "own"), "chains")
    copied = chain.where("n > 1")
    summed = running_sums(copied, "conv_id", [F.col("depth").desc()], {"own": "saved"}).unionByName(chain.where("n = 1").withColumn("saved", F.lit(0).cast("long")))
    nodes = [summed.select("depth", "conv_id", F.col("conv_id").alias("parent"), F.col("n").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved", F.when(F.col("depth") == F.col("len"), F.col("conv_id")).alias("ender"))]
    below_alone = materialize(copied.groupBy("conv_id").agg(F.sum("own").alias("chain_saved")), "chain-sums")

    for level in reversed(levels):
        level = level.withColumnRenamed("node", "parent").withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")).join(below_alone, "conv_id", "left")
        if len(nodes) > 1:
            below = nodes[-1].groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
            level = level.join(below, "conv_id", "left")
        else:
            level = level.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "n_leaves", "saved")})
        goes_on = ((F.col("members") == 1) & F.col("ender").isNull()).cast("long")
        none = F.lit(0).cast("long")
        saved = F.col("own") + F.coalesce("saved", none) + F.when(F.col("members") == 1, F.coalesce("chain_saved", none)).otherwise(none)
        summed = level.select("depth", "conv_id", "parent", "n_convs", F.coalesce("n_children", goes_on).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), saved.alias("saved"), "ender")
        nodes.append(materialize(summed, "summed"))
    ended = sequences.select(F.col("conv_id").alias("ender"), "ends_sha256")
    found = reduce(DataFrame.unionByName, nodes).join(ended, "ender", "left")
    return found.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
