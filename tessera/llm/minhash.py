"""Near-duplicate documents: Order MinHash, with candidates verified by banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import map_batches, mixed, sorted_out
from tessera.llm.components import components, numbered
from tessera.llm.tokens import BASES, Words, prefix_sums, run_hashes, words
from tessera.session import materialize, release, settled

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches a text, shingles a sketch, and the part of the text over which they must reach for the sketch
#: to count: a passage that many unlike texts share gives them no sketch. A little under half of all
#: sketches count. Texts with a share J of their shingles in common share one with probability
#: 1 - (1 - 0.47 * J ** 2) ** 112: 0.88 at 0.2, 0.99 at 0.3, 0.9998 at 0.4.
SKETCHES = 112
LENGTH = 2
REACH = 1 / 3
#: Documents of a bucket that one task compares with one another or with as many others.
BLOCK = 96
#: Of so many texts around another one goes with two blocks.
ONWARD = 12
_PLACE = np.uint64((1 << 20) - 1)
_HASH = np.uint64((1 << 44) - 1)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(labels, first): each text's shingles of k words in order, made distinct within the text by
    the number of the occurrence; ``first`` is where each text's begin. A text of fewer than k
    words, but not none, has one shingle of all its words."""
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    of = np.repeat(np.arange(len(n)), count)
    start = w.first[:-1][of] + np.arange(first[-1]) - first[:-1][of]
    plain = run_hashes(prefix_sums(w.hashes, BASES[1]), start, np.minimum(start + k, w.first[1:][of]), BASES[1])
    order = np.argsort(mixed(plain + of.astype(np.uint64) * BASES[0]), kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (plain[order][1:] == plain[order][:-1]) & (of[order][1:] == of[order][:-1])
    at = np.arange(len(order))
    run = at - np.maximum.accumulate(np.where(same, 0, at))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = run.astype(np.uint64)
    return np.where(occurrence > 0, mixed(plain + occurrence * BASES[1]), plain), first


def sketch_keys(labels: np.ndarray, first: np.ndarray, sketches: int = SKETCHES, length: int = LENGTH) -> np.ndarray:
    """(texts, sketches) of keys; 0 for a sketch that doesn't count. A sketch is the ``length`` smallest
    shingles under one of the hash orders, in the order in which the text has them. Texts must have a
    shingle; one of fewer than ``length`` has them all in its sketches. Places have 20 bits: in a longer text
    as many neighbours as it takes are at one place, and go by their hashes there."""
    of, n = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.diff(first)
    coarse = np.maximum(np.ceil(np.log2(np.maximum(n, 1) / (int(_PLACE) + 1))), 0).astype(np.int64)
    place = ((np.arange(len(labels)) - first[:-1][of]) >> coarse[of]).astype(np.uint64)
    needed = (((n - 1) >> coarse) * REACH).astype(np.uint64)
    keys = np.empty((len(first) - 1, sketches), np.uint64)
    chosen = np.empty((length, len(keys)), np.uint64)
    factors = mixed(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    for t in range(sketches):
        value = ((labels * factors[t]) & ~_PLACE) | place
        for n in range(length):
            least = np.minimum.reduceat(value, first[:-1])
            chosen[n] = (least & _PLACE) << np.uint64(44) | least >> np.uint64(20)
            if n + 1 < length:
                value[value == least[of]] = _LAST
        key = np.full(len(keys), t + 1, np.uint64)
        ordered = np.sort(chosen, axis=0)
        for shingle in ordered:
            key = mixed(key * BASES[0] + (shingle & _HASH))
        reach = (ordered[-1] >> np.uint64(44)) - (ordered[0] >> np.uint64(44))  # huge with fewer than ``length``
        keys[:, t] = np.where(reach >= needed, key | np.uint64(1), 0)
    return keys


def matches(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether an alignment of two rows of words matches ``need`` of them, in order. So many matches leave
    a band of places around the diagonal, outside of which nothing is looked at; a row of the band is
    one integer, a bit for each word of ``a``."""
    n = min(len(a), len(b))
    if need > n:
        return False
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return True
    head = int(differ[0])
    differ = np.flatnonzero(a[head:][::-1][: n - head] != b[head:][::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    a, b, need = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist(), need - head - tail
    if need <= 0:
        return True
    if need > min(len(a), len(b)):
        return False
    wanted, places = set(b), {}
    for i, word in enumerate(a):
        if word in wanted:
            places[word] = places.get(word, 0) | 1 << i
    band, back = (1 << (len(a) + len(b) - 2 * need + 1)) - 1, len(b) - need
    everywhere = (1 << len(a)) - 1
    open_ = everywhere  # a bit is off where the longest match of the words so far grows
    for j, word in enumerate(b):
        met = open_ & places.get(word, 0) & (band << (j - back) if j >= back else band >> (back - j))
        if met:
            open_ = ((open_ + met) | (open_ - met)) & everywhere
    return len(a) - open_.bit_count() >= need


def shared(sets: list[np.ndarray], columns: int = 1 << 15) -> np.ndarray:
    """How many labels each two sets have in common, from products of blocks of the 0/1 matrix."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, column = rows[often[column] > 1], column[often[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        part = slice(*np.searchsorted(column, (lo, lo + columns)))
        matrix = np.zeros((len(sets), min(columns, int(column[-1]) + 1 - lo)), np.float32)
        matrix[rows[part], column[part] - lo] = 1
        total += matrix @ matrix.T
    return total


def linked(ids: np.ndarray, part: np.ndarray, block: np.ndarray, texts: list[np.ndarray], sets: list[np.ndarray], within: bool, similarity: float) -> list[tuple[int, int]]:
    """Links (smaller, larger id) that connect what is similar in one block, or between two; ``texts`` are
    rows of word hashes, ``sets`` the same with the number of each occurrence. Texts of one ``part``
    are connected already."""
    order = np.argsort(ids)
    ids, part, block, texts, sets = ids[order], part[order], block[order], [texts[i] for i in order], [sets[i] for i in order]
    size = np.array([len(t) for t in texts])
    need = np.ceil(similarity * np.maximum(size[:, None], size[None, :]) - 1e-9).astype(np.int64)
    close = shared(sets) >= need  # an alignment can't match more than the words in common
    _, first, inverse = np.unique(part, return_index=True, return_inverse=True)
    root = first[inverse].tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1))), strict=True):
        if within or block[i] != block[j]:
            a, b = find(i), find(j)
            if a != b and matches(texts[i], texts[j], int(need[i, j])):
                root[max(a, b)] = min(a, b)
                found.append((int(ids[i]), int(ids[j])))
    return found


def several_parts(members: DataFrame) -> DataFrame:
    """(bucket, top, of_top, n) of the buckets of ``members`` (bucket, rep, part) that hold several parts: the
    largest part, its texts there and all texts. Of buckets of the same texts one is given, told by
    their number and 95 bits summed over them; one row a bucket, so that a join by it makes no pairs."""
    one = F.xxhash64("rep")
    counted = members.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(one.bitwiseAND(F.lit((1 << 31) - 1))).alias("y"))
    held = counted.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")).where("kinds > 1")
    once = held.groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "top")).alias("m"))
    return once.select("m.bucket", F.col("m.top.part").alias("top"), F.col("m.top.n").alias("of_top"), "n")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, text_key, component_id, kept) of every row: classes of documents that are linked. Two texts are
    linked if they share a sketch of their shingles of k words, and an alignment matches
    ``similarity`` or more of the words of the longer one, in order.

    Equal texts are one text. Distinct ones are sketched where they lie; those with a sketch in common
    form a bucket. First each text is compared with that text which is the smallest of most of its
    buckets, together with some others of that text, which connects most copies into parts. Then a
    text that shares a bucket with a part of more than ``block`` texts is compared with that part,
    once. Then buckets that still hold several parts are looked at, by length (similar texts have
    similar lengths), equal ones once; the largest part of a bucket needs no comparison within
    itself. All that is dealt out as pairs of blocks, so a group of copies is not multiplied by its
    own size. Only verified links connect. A task sees at most two blocks; it counts the common words of all pairs by
    a matrix product, aligns those that can reach the similarity unless they are connected already,
    and gives the links it used. Links are joined into components in rounds.

    Words are told apart by 64-bit hashes. Null texts and texts without words link with nothing. Texts
    of fewer words than a shingle have one shingle of all words. component_id is the smallest id reached. Rows equal in id and text
    have equal results; different texts of one id are apart, and of such a class one is kept. Rows with a null id have no component and are not kept. No rows: no rows.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list = [None] * batch.num_rows
        size = np.zeros(batch.num_rows, np.int64)
        for w in words(batch.column("text")):
            labels, first = shingles(w, k)
            some = np.flatnonzero(np.diff(first))
            size[w.rows.start : w.rows.stop] = np.diff(w.first)
            if len(some):
                for i, key in zip(some.tolist(), sketch_keys(labels, np.append(first[some], first[-1])).view(np.int64), strict=True):
                    out[w.rows[i]] = key[key != 0]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(size), pa.array(out, pa.list_(pa.int64()))], ["id", "text_key", "size", "keys"])

    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    sketches = materialize(map_batches(rows.withColumn("text_key", key), sketched, "id long, text_key binary, size long, keys array<long>", rows=64), "sketches")
    distinct = sketches.where("keys is not null and id is not null").groupBy("text_key").agg(F.min(F.struct("id", "size", "keys")).alias("m"))
    distinct = numbered(materialize(distinct.select("text_key", F.col("m.id").alias("rep"), "m.size", "m.keys"), "texts"), "text_key")
    placed = distinct.select("rep", "size", F.explode("keys").alias("key"))
    buckets = placed.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").select("key", "b")
    bucketed = settled(lambda: placed.join(materialize(buckets, "shared-sketches"), "key"), "buckets")
    votes = bucketed.where("rep <> b").groupBy("rep", "b").agg(F.count(F.lit(1)).alias("n"))
    stars = materialize(votes.groupBy("rep").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m")).select("rep", (-F.col("m.b")).alias("b")), "stars")
    # texts that share a sketch, once for both comparisons
    candidates = bucketed.select("rep").distinct().join(distinct.select("rep", "least", "text_key"), "rep")
    texts = sorted_out(rows.where("id is not null"), candidates.select(F.col("least").alias("id")), "id")[0].withColumn("whole_key", key).join(candidates, (F.col("id") == F.col("least")) & (F.col("whole_key") == F.col("text_key")))
    texts = materialize(texts.select("rep", "text"), "candidates")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, at = np.unique(group.column("rep").to_numpy(), return_index=True)  # repeated rows once
        group = group.take(pa.array(at))
        found_words, sets = [], []
        for w in words(group.column("text").combine_chunks()):
            found_words += np.split(w.hashes, w.first[1:-1])
            labels, first = shingles(w, 1)
            sets += np.split(labels, first[1:-1])
        within = group.column("bi")[0] == group.column("bj")[0]
        found = linked(ids, group.column("part").to_numpy(), group.column("block").to_numpy(), found_words, sets, within, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    def compared(dealt: DataFrame) -> DataFrame:
        """Links (a, b) within blocks (bi = bj) and between two, from (rep, bucket, part, block, bi, bj)."""
        return materialize(dealt.join(texts, "rep").groupBy("bucket", "bi", "bj").applyInArrow(compare, "a long, b long"), "similar")

    blocks_of = lambda n: F.ceil((F.col(n) if isinstance(n, str) else n) / block).cast("int")
    place = lambda of, blocks: F.pmod(F.xxhash64(of), F.col(blocks)).cast("int")
    # each text once, with the smallest text of most of its buckets; that one goes with every block of its texts, and
    # some texts go with the next block too, so that blocks of similar texts hang together whatever that one is like
    members = stars.select("rep", F.col("b").alias("bucket"))
    sizes = members.groupBy("bucket").agg(blocks_of(F.count(F.lit(1))).alias("blocks"))
    onward = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("rep", "bucket"), F.lit(ONWARD)) == 0)
    next_too = F.when(onward, F.array("block", F.pmod(F.col("block") + 1, F.col("blocks")))).otherwise(F.array("block"))
    around = members.join(sizes, "bucket").withColumn("block", place("rep", "blocks")).select("rep", "bucket", F.explode(next_too).alias("block"))
    centers = sizes.select(F.col("bucket").alias("rep"), "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = around.unionByName(centers).select("rep", "bucket", F.col("rep").alias("part"), "block", F.col("block").alias("bi"), F.col("block").alias("bj"))
    links = compared(dealt)
    parts = components(links).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    # lengths in steps of the similarity: similar texts are in one step or in two that follow each other
    step = F.floor(F.log(F.col("size")) / -float(np.log(similarity))).cast("int")
    parted = bucketed.join(parts, "rep", "left").select("rep", F.coalesce("part", "rep").alias("part"), F.explode(F.array(step, step + 1)).alias("step"), "key")
    parted = materialize(parted.select("rep", "part", F.xxhash64("key", "step").alias("bucket")), "parts")
    release(bucketed, stars)
    large = parts.groupBy(F.col("part").alias("top")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    tops = several_parts(parted).join(large.select("top", blocks_of("n").alias("most")), "top", "left")
    # who is in a large part that is first in a bucket is not looked up there
    wanted = (parted["bucket"] == tops["bucket"]) & (tops["most"].isNull() | (parted["part"] != tops["top"]))
    opened = materialize(parted.join(tops, wanted).select(parted["bucket"], "rep", "part", "top", "most"), "opened")
    release(parted)
    # a text of a bucket in which a large part is first meets all blocks of that part, once for all buckets
    outside = opened.where("most is not null").select("top", "rep", "most").distinct()
    outside = materialize(outside, "outside")
    if not outside.isEmpty():
        counts = outside.groupBy("top", "most").agg(blocks_of(F.count(F.lit(1))).alias("rest"))
        left = outside.join(counts.select("top", "rest"), "top").withColumn("bi", place("rep", "rest")).withColumn("bj", F.explode(F.sequence(F.col("rest"), F.col("rest") + F.col("most") - 1))).select("rep", F.col("top").alias("bucket"), F.col("rep").alias("part"), F.col("bi").alias("block"), "bi", "bj")
        right = parts.join(counts, F.col("part") == F.col("top")).withColumn("bj", F.col("rest") + place("rep", "most")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("rest") - 1))).select("rep", F.col("top").alias("bucket"), "part", F.col("bj").alias("block"), "bi", "bj")
        links = links.unionByName(compared(left.unionByName(right)))
        parts = components(links).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    # what buckets hold beside such a part
    beside = materialize(opened.join(parts, "rep", "left").select("bucket", "rep", F.coalesce(parts["part"], "rep").alias("part")), "beside")
    release(opened, outside)
    largest = several_parts(beside).select("bucket", "top", blocks_of(F.col("n") - F.col("of_top")).alias("rest"), blocks_of("of_top").alias("most"))
    # blocks 0 .. rest - 1 are outside the largest part, the following ones of it
    in_top = F.col("part") == F.col("top")
    dealt = beside.join(largest, "bucket").withColumn("block", F.when(in_top, F.col("rest") + place("rep", "most")).otherwise(place("rep", "rest")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(in_top, 0).otherwise(F.col("most")))))
    dealt = dealt.select("rep", "bucket", "part", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    parts = components(links.unionByName(compared(dealt)))
    release(texts, beside)
    reps = distinct.select("text_key", "rep").join(parts, F.col("rep") == F.col("node"), "left").select(F.col("text_key").alias("of"), F.coalesce("component", "rep").alias("component"), F.coalesce(F.col("component") == F.col("rep"), F.lit(True)).alias("first"))
    reps = reps.join(distinct.select(F.col("rep").alias("component"), F.col("least").alias("component_id")), "component")
    joined = sketches.where("keys is not null").join(reps, F.col("text_key") == F.col("of"), "left").select("id", "text_key", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"), "first")
    alone = sketches.where("keys is null").select("id", "text_key", F.col("id").alias("component_id"), F.lit(True).alias("first"))
    return joined.unionByName(alone).select("id", F.lower(F.hex("text_key")).alias("text_key"), "component_id", F.coalesce((F.col("id") == F.col("component_id")) & F.col("first"), F.lit(False)).alias("kept"))


def row_key_of(id_: Column, text_key: Column) -> Column:
    """40 bytes that stand for a row's id and text; null without an id."""
    return F.unhex(F.concat(F.lpad(F.hex(id_), 16, "0"), text_key))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, all columns as they are: that with the
    smallest id, and of rows equal in id and text one. Rows with a null id stay."""

    def counts() -> DataFrame:
        found = near_duplicates(docs, id_col=id_col, text_col=text_col).where("id is not null")
        counted = found.groupBy("id", "text_key").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
        return counted.where("not kept or times > 1").select(row_key_of(F.col("id"), F.col("text_key")).alias("row_key"), "kept")

    counted = settled(counts, "dropped")
    row_key = row_key_of(docs[id_col].cast("long"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    packed = docs.select(row_key.alias("row_key"), F.struct("*").alias("row"))
    touched, others = sorted_out(packed.where("row_key is not null"), counted, "row_key")
    once = touched.join(counted, "row_key", "left_anti").select("row").unionByName(packed.where("row_key is null").select("row"))
    repeated = touched.join(counted.where("kept"), "row_key", "left_semi").dropDuplicates(["row_key"]).select("row")
    out = once.unionByName(repeated) if others is None else once.unionByName(repeated).unionByName(others.select("row"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))
