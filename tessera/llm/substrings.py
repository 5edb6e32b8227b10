"""Removing long repeated passages, found by recompression.

A text is a row of word symbols. A round first gives every maximal run of one symbol a name, then
splits all symbols in two sides by a hash and names every neighbouring pair of a left and a right
symbol. A name is a hash of what it stands for, so all tasks give equal runs and pairs the same name
without a dictionary, and equal passages get the same symbols but for a few at their ends. Symbols that two
texts share lead to the passages they may share, which are then compared exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import lists, map_batches, mixed, row_uid
from tessera.llm.tokens import BASES, Words, prefix_sums, run_hashes, words
from tessera.session import materialize

WINDOW = 50
#: After so many rounds a symbol stands for three words on average, and depends on about twenty: most
#: windows of fifty have several symbols that depend on nothing outside the window.
ANCHOR_ROUND = 4
#: Places in a text have fewer bits than this; symbols of the same upper bits are told apart by place, as in any equal window.
_INDEX = np.uint64((1 << 32) - 1)
_ROWS = 64


@dataclass
class Symbols:
    """Symbols in order: name, text, words [start, end), and the words [near, far) that made the name
    what it is: any text that has those words has the symbol there."""

    name: np.ndarray
    of: np.ndarray
    start: np.ndarray
    end: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def __len__(self) -> int:
        return len(self.name)


def of_words(w: Words) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """The words as symbols; with the places just outside each text."""
    at = np.arange(len(w.hashes))
    return Symbols(w.hashes, w.of, at, at + 1, at, at + 1), w.first[:-1] - 1, w.first[1:] + 1


def compress(s: Symbols, turn: int, before: np.ndarray, after: np.ndarray) -> Symbols:
    """One round. ``before`` and ``after`` are the places outside each text: a symbol that depends on
    what comes there depends on more than its text."""
    n, salt, side = len(s), np.uint64(2 * turn + 1), np.uint64((2 * turn + 1) * int(BASES[1]) % (1 << 64))
    same = np.zeros(n + 1, bool)
    same[1:-1] = (s.name[1:] == s.name[:-1]) & (s.of[1:] == s.of[:-1])
    head = np.flatnonzero(~same[:-1])
    last = np.append(head[1:], n) - 1
    times = (last - head + 1).astype(np.uint64)
    of = s.of[head]
    edge = np.ones(len(head) + 1, bool)
    edge[1:-1] = of[1:] != of[:-1]
    near = np.where(edge[:-1], before[of], s.near[head - 1])
    far = np.where(edge[1:], after[of], s.far[np.minimum(last + 1, n - 1)])
    runs = Symbols(np.where(times > 1, mixed(s.name[head] * BASES[0] + times * salt), s.name[head]), of, s.start[head], s.end[last], near, far)

    m = len(runs)
    right = (mixed(runs.name + side) & np.uint64(1)).astype(bool)
    pair = np.zeros(m + 1, bool)  # whether the symbol is the left one of a pair
    pair[:-2] = ~right[:-1] & right[1:] & ~edge[1:-1]
    keep = np.ones(m, bool)
    keep[1:] = ~pair[:-2]
    at = np.flatnonzero(keep)
    joined, following = pair[at], np.minimum(at + 1, m - 1)
    name = np.where(joined, mixed(runs.name[at] * BASES[0] + mixed(runs.name[following] * BASES[1] + salt)), runs.name[at])
    alone_left, alone_right = ~joined & ~right[at], ~joined & right[at]
    near = np.where(alone_right, np.where(edge[at], before[of[at]], runs.near[at - 1]), runs.near[at])
    far = np.where(joined, runs.far[following], np.where(alone_left, np.where(edge[at + 1], after[of[at]], runs.far[following]), runs.far[at]))
    return Symbols(name, of[at], runs.start[at], np.where(joined, runs.end[following], runs.end[at]), near, far)


def sums_of(w: Words) -> list[np.ndarray]:
    """Sums for two hashes of runs of words, which have no chance of being alike in common but that of the words."""
    return [prefix_sums(w.hashes, BASES[0]), prefix_sums(mixed(w.hashes + BASES[1]), BASES[1])]


def anchors(s: Symbols, w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, ctx, lo, hi): the windows lo..hi (by their first words) have ``key`` as their anchor; ``ctx``
    is the hash of all words from the first window to the last.

    The anchor of a window is the symbol of the smallest hash among those that depend on words of the
    window alone, so equal windows have equal anchors; its key stands for the symbol and all those
    words. A window without one is its own anchor."""
    total = len(w.hashes)
    n = np.diff(w.first)
    count = np.maximum(n - window + 1, 0)
    offset = np.concatenate([[0], np.cumsum(count)])
    p = np.arange(offset[-1]) + np.repeat(w.first[:-1] - offset[:-1], count)
    if not len(p):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), p, p
    sums = sums_of(w)
    below = np.cumsum(np.bincount(np.maximum(s.near + 1, 0), minlength=total + 3))  # symbols that depend on nothing from this place on back
    within = np.cumsum(np.bincount(s.far, minlength=total + 3))
    lo, hi = below[p], within[p + window] - 1
    has = lo <= hi
    best = np.full(len(p), -1)
    value = (mixed(s.name) & ~_INDEX) | np.arange(len(s), dtype=np.uint64)
    left, right, where = lo[has], hi[has], np.flatnonzero(has)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            value = np.minimum(value[: -(1 << (k - 1))], value[1 << (k - 1) :])
        at = level == k
        least = np.minimum(value[left[at]], value[right[at] - (1 << k) + 1])
        best[where[at]] = (least & _INDEX).astype(np.int64)
    of = np.repeat(np.arange(len(n)), count)
    new = np.ones(len(p), bool)
    new[1:] = (best[1:] != best[:-1]) | (best[1:] < 0) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    at, own = best[first], best[first] < 0
    key = mixed(s.name[at] + run_hashes(sums[1], np.maximum(s.near[at], 0), np.minimum(s.far[at], total), BASES[1]))
    key[own] = run_hashes(sums[1], p[first[own]], p[first[own]] + window, BASES[1]) ^ np.uint64(1)
    return key, run_hashes(sums[0], p[first], p[last] + window, BASES[0]), p[first], p[last]


PARSED = "uid binary, id long, n_words long, kept_sha256 string, anchors array<struct<key:long,ctx:long,lo:int,hi:int>>"


def parsed(batch: pa.RecordBatch, window: int, turns: int) -> pa.RecordBatch:
    """The anchors of all windows after some rounds, a row a text."""
    found, counts, digests = [], [], []
    for w in words(batch.column("text")):
        s, before, after = of_words(w)
        for turn in range(turns if len(s) else 0):
            s = compress(s, turn, before, after)
        key, ctx, lo, hi = anchors(s, w, window)
        of = w.of[lo]
        found.append(lists(of, len(w.rows), key=key.view(np.int64), ctx=ctx.view(np.int64), lo=(lo - w.first[of]).astype(np.int32), hi=(hi - w.first[of]).astype(np.int32)))
        counts += np.diff(w.first).tolist()
        digests += [hashlib.sha256(b" ".join(w.raw[lo:hi].tobytes().split())).hexdigest() for lo, hi in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests), pa.concat_arrays(found)], ["uid", "id", "n_words", "kept_sha256", "anchors"])


WINDOWS = "k1 long, k2 long, id long, key long, ctx long, off int, open boolean"


def hashed_windows(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """128-bit hashes of the windows in some contexts of each text; open: the context asks for an answer."""
    ranges, ids, out = batch.column("ranges").to_pylist(), batch.column("id").to_numpy(), []
    for w in words(batch.column("text")):
        sums = sums_of(w)
        for i, row in enumerate(w.rows):
            lo, hi, key, ctx, asks = (np.array([r[k] for r in ranges[row]]) for k in ("lo", "hi", "key", "ctx", "open"))
            count = hi - lo + 1
            off = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            at = np.repeat(lo, count) + off + w.first[i]
            k1, k2 = (run_hashes(x, at, at + window, b).view(np.int64) for x, b in zip(sums, BASES, strict=True))
            out.append((k1, k2, np.full(len(at), ids[row]), np.repeat(key, count), np.repeat(ctx, count), off.astype(np.int32), np.repeat(asks, count)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["k1", "k2", "id", "key", "ctx", "off", "open"])


def without(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts without the words of their spans (start, end)."""
    removed, digests, kept = [], [], []
    for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
        found = (text or "").encode("utf-8", "surrogatepass").split()
        change = np.zeros(len(found) + 1, np.int64)
        for span in spans:
            change[span["start"]] += 1
            change[span["end"]] -= 1
        stays = np.cumsum(change[:-1]) == 0
        rest = b" ".join([x for x, k in zip(found, stays.tolist(), strict=True) if k])
        removed.append(len(found) - int(stays.sum()))
        digests.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest.decode("utf-8", "surrogatepass"))
    return pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.string())], ["uid", "n_removed", "kept_sha256", "kept_text"])


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, turns: int = ANCHOR_ROUND) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has (uid, id, n_words, kept_sha256 of the whole text) of each row; spans has
    (uid, start, end) of the words that are covered by a window which also starts in a text with a
    smaller id.

    Windows around one anchor (a context) travel together. Anchors of one id only are left out. A
    context that a smaller id has too is removed whole. Of each context that is left, one is compared
    with the other contexts of its anchor: all their windows are looked up by 128-bit hashes. Every
    step groups by a hash with a minimum that is taken before the shuffle; no step pairs up the rows
    of a group.

    A null id counts as larger than all. Rows equal in id and text get equal results, and do not
    repeat each other. Null texts have no words. No rows: no rows. Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(text_col).alias("text")).withColumn("uid", row_uid(F.col("id"), F.col("text")))
    texts = materialize(map_batches(rows, lambda b: parsed(b, window, turns), PARSED, rows=_ROWS), "symbols")
    each = texts.select("uid", "id", F.inline("anchors"))
    shared = each.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), (F.min("ctx") != F.max("ctx")).alias("differ")).where("least < most").drop("most")
    live = materialize(each.join(materialize(shared, "shared"), "key"), "anchors")
    alike = live.where("not differ and least < id").select("uid", "lo", "hi")
    differ = live.where("differ")
    first = materialize(differ.groupBy("key", "ctx").agg(F.min(F.struct("id", "uid", "lo", "hi", "least")).alias("m")), "contexts")
    placed = differ.join(first.select("key", "ctx", F.col("m.id").alias("first_id")), ["key", "ctx"])
    copied = placed.where("first_id < id").select("uid", "lo", "hi")
    per_text = first.groupBy(F.col("m.uid").alias("uid")).agg(F.collect_set(F.struct("key", "ctx", "m.lo", "m.hi", (F.col("m.least") < F.col("m.id")).alias("open"))).alias("ranges"))
    looked = materialize(map_batches(rows.join(per_text, "uid"), lambda b: hashed_windows(b, window), WINDOWS, rows=_ROWS), "windows")
    earliest = looked.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    found = looked.where("open").join(earliest, ["k1", "k2"]).where("least < id").select("key", "ctx", "off")
    part = placed.where("first_id = id").join(found, ["key", "ctx"]).select("uid", (F.col("lo") + F.col("off")).alias("lo"), (F.col("lo") + F.col("off")).alias("hi"))
    spans = alike.unionByName(copied).unionByName(part).select("uid", F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
    return texts.drop("anchors"), spans


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) of every row; kept_text is null where all words stay.
    See ``removals``."""
    texts, spans = removals(docs, id_col=id_col, text_col=text_col, window=window)
    per_text = spans.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    big = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(row_uid(big, F.col(text_col)).alias("uid"), F.col(text_col).alias("text"))
    cut = map_batches(rows.join(per_text, "uid"), without, "uid binary, n_removed long, kept_sha256 string, kept_text string", rows=_ROWS)
    cut = cut.groupBy("uid").agg(F.first("n_removed").alias("n_removed"), F.first("kept_sha256").alias("cut_sha256"), F.first("kept_text").alias("kept_text"))
    done = texts.join(cut, "uid", "left")
    return done.select(F.when(F.col("id") < (1 << 63) - 1, F.col("id")).alias("id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"), "kept_text")
