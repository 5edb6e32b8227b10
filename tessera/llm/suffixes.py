"""Removing byte strings that occur twice, by interval expansion on Burrows-Wheeler transforms.

Every string of 400 bytes has an anchor: of the hashes of its 64-byte grams the smallest. Equal
strings have equal anchors at equal offsets, so only strings around the same anchor are compared,
and runs of strings with one anchor (a context) travel as one. Contexts that are equal throughout are
counted; those that differ somewhere are cut into narrower slots, whose common core must agree too.
What is left, in groups of bounded size, goes into Burrows-Wheeler transforms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import lists, map_batches, map_groups, mixed, row_uid, sorted_out
from tessera.llm.tokens import _BYTES, BASES, chunks, prefix_sums, run_hashes, utf8
from tessera.session import materialize, release, settled

WINDOW = 400
#: A power of two.
GRAM = 64
#: Of the room of a gram in a window, the parts that are the widths of the slots of successive rounds, in
#: strings by their first bytes. In a last round a slot is one string.
SLOTS = (4, 28)
#: Different segments of a slot that go into one transform; slots with more go to the next round.
GROUP = 256
#: Bytes of a transform (a group at least).
TRANSFORM = 1 << 20
#: Places in a text have fewer bits than this; grams of the same upper bits are told apart by place, as in any equal string.
_INDEX = np.uint64((1 << 32) - 1)
_PART = 1 << 18
_ROWS = 64


def anchored(part: np.ndarray, bd: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(of, key, ctx, at, lo, hi) of the contexts of some texts; ``bd`` is where each begins in ``part``, and so are the places."""
    n = np.diff(bd)
    count = np.maximum(n - window + 1, 0)
    offset = np.concatenate([[0], np.cumsum(count)])
    if not offset[-1]:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = prefix_sums(_BYTES[part], BASES[0])
    place = np.arange(len(part) - gram + 1)
    grams = run_hashes(sums, place, place + gram, BASES[0])
    least, width, total = (grams & ~_INDEX) | (place.astype(np.uint64) & _INDEX), 1, window - gram + 1
    while width * 2 <= total:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < total:
        least = np.minimum(least[: len(least) - (total - width)], least[total - width :])
    of = np.repeat(np.arange(len(n)), count)
    p = np.arange(offset[-1]) + (bd[:-1] - offset[:-1])[of]
    at = (least[p] & _INDEX).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    lo, hi, at, of = p[head], p[np.append(head[1:], len(p)) - 1], at[head], of[head]
    return of, grams[at], context_hash(sums, lo, hi, at, window), at, lo, hi


def context_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the bytes of contexts and of where their anchors lie in them."""
    return mixed(run_hashes(sums, lo, hi + window, BASES[0]) + (at - lo).astype(np.uint64))


def anchored_in_pieces(text: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """``anchored`` of one text, ``_PART`` windows at a time: the arrays follow the piece, not the text. A
    context that goes on in the next piece is put together again."""
    pieces: list[list[np.ndarray]] = []
    for a in range(0, len(text) - window + 1, _PART):
        part = text[a : a + _PART + window - 1]
        of, key, ctx, at, lo, hi = anchored(part, np.array([0, len(part)]), window, gram)
        at, lo, hi = at + a, lo + a, hi + a
        if pieces and pieces[-1][3][-1] == at[0]:
            lo[0] = pieces[-1][4][-1]
            whole = text[lo[0] : hi[0] + window]
            ctx[:1] = context_hash(prefix_sums(_BYTES[whole], BASES[0]), lo[:1] - lo[0], hi[:1] - lo[0], at[:1] - lo[0], window)
            pieces[-1] = [c[:-1] for c in pieces[-1]]
            if not len(pieces[-1][3]):
                pieces.pop()
        pieces.append([of, key, ctx, at, lo, hi])
    return tuple(np.concatenate(c) for c in zip(*pieces, strict=True))


def contexts(batch: pa.RecordBatch, window: int, gram: int) -> pa.RecordBatch:
    """Each text's contexts: windows lo..hi (by their first bytes) whose anchor is the gram at ``at``;
    ``key`` is the hash of the gram, ``ctx`` that of all bytes from the first window to the last."""
    raw, bounds = utf8(batch.column("text"))
    found = []
    for first, last in chunks(bounds, _PART):
        part, bd = raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        of, key, ctx, at, lo, hi = anchored_in_pieces(part, window, gram) if len(part) > _PART + window else anchored(part, bd, window, gram)
        found.append(lists(of, last - first, key=key.view(np.int64), ctx=ctx.view(np.int64), at=(at - bd[of]).astype(np.int32), lo=(lo - bd[of]).astype(np.int32), hi=(hi - bd[of]).astype(np.int32)))
    digests = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(digests), pa.concat_arrays(found)], ["uid", "id", "n_bytes", "kept_sha256", "contexts"])


CONTEXTS = "uid binary, id long, n_bytes long, kept_sha256 string, contexts array<struct<key:long,ctx:long,at:int,lo:int,hi:int>>"
#: A segment is the bytes of one context; ``first`` and ``lo`` say where its first copy stands.
SEGMENT = "key long, ctx long, copies long, first long, lo int, x int, segment binary"
_SEGMENT_IDS = ("key", "ctx", "copies", "first", "lo")


def with_bytes(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """The bytes of some contexts of each text; x is how far the anchor lies behind the first byte."""
    rows = []
    for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
        raw = (text or "").encode("utf-8", "surrogatepass")
        rows += [(c["key"], c["ctx"], c["copies"], c["first"], c["lo"], c["at"] - c["lo"], raw[c["lo"] : c["hi"] + window]) for c in found]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_SEGMENT_IDS, "x", "segment"])


def slots(batch: pa.RecordBatch, width: int, window: int) -> pa.RecordBatch:
    """Segments cut into slots of windows whose anchor is equally far off, but for ``width``: ``slot`` is
    the hash of the bytes that all windows of the slot share, ``part`` of the bytes of those at hand."""
    row, off, n, slot, part = [], [], [], [], []
    for i, (x, segment) in enumerate(zip(batch.column("x").to_pylist(), batch.column("segment").to_pylist(), strict=True)):
        sums = prefix_sums(_BYTES[np.frombuffer(segment, np.uint8)], BASES[0])
        windows = len(segment) - window + 1
        s = np.arange(x // width, (x - windows + 1) // width - 1, -1)
        start = np.maximum(x - s * width - width + 1, 0)  # of the first window of the slot
        stop = np.minimum(x - s * width, windows - 1)
        core = x - s * width
        slot.append(mixed(run_hashes(sums, core, core - width + 1 + window, BASES[0]) + mixed(s.astype(np.uint64) * BASES[1])))
        part.append(mixed(run_hashes(sums, start, stop + window, BASES[0]) + (core - start).astype(np.uint64)))
        row.append(np.full(len(s), i))
        off.append(start)
        n.append(stop - start + 1)
    take = pa.array(np.concatenate(row))
    columns = [np.concatenate(slot).view(np.int64), np.concatenate(part).view(np.int64), np.concatenate(off).astype(np.int32), np.concatenate(n).astype(np.int32)]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in _SEGMENT_IDS), *map(pa.array, columns)], [*_SEGMENT_IDS, "slot", "part", "off", "n"])


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, by prefix doubling, and the ranks by their first ``shallow`` bytes (a power
    of two). ``ends`` are the places of the separators, each of which is a letter of its own."""
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    width, early = 1, rank
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:] + 1
        pair = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(pair, kind="stable")
        step = np.ones(len(rank), np.int64)
        step[0], step[1:] = 0, pair[order][1:] != pair[order][:-1]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step)
        width *= 2
        if width == shallow:
            early = rank
        if width >= depth:
            return order, early


def repeated(segments: list[bytes], window: int, shallow: int, turn: np.ndarray | None = None) -> np.ndarray:
    """For each byte of the segments, each with a separator after it: whether the ``window`` bytes from
    there on also start elsewhere; with ``turn`` (a number a segment, none twice), whether they also
    start in a segment of a smaller turn or earlier in the same.

    Breadth first over the intervals of the transform, by increasing length: the intervals of strings
    of ``length`` letters are extended by each letter in front of them. Where an interval ends that no
    shorter string's did, the common prefix of the suffixes on both sides is known; its extensions
    are looked at next. Prefixes below ``shallow`` bytes are known from the sorting, and the search
    stops at ``window``: what has no known prefix by then shares that much."""
    joined = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.cumsum([len(s) + 1 for s in segments]) - 1
    order, early = suffix_order(joined, ends, max(map(len, segments)) + 1, shallow)
    separator = np.zeros(len(joined), bool)
    separator[ends] = True
    before = order - 1  # the letter in front of each suffix; the first text's is a separator
    letter, barrier = joined[before], separator[before]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    forward = place[before]  # where the suffix that is one longer stands
    known = np.ones(len(order) + 1, bool)
    sorted_early = early[order]
    known[1:-1] = sorted_early[1:] != sorted_early[:-1]
    lo = np.flatnonzero(known[:-1])
    hi = np.append(lo[1:], len(order))
    for _ in range(shallow + 1, window + 1):
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        of = np.repeat(np.arange(len(lo)), size)
        free = ~barrier[at]
        at, of = at[free], of[free]
        if not len(at):
            break
        longer = forward[at]
        by = np.argsort(longer)
        longer, of, first = longer[by], of[by], letter[at[by]]
        new = np.ones(len(longer), bool)
        new[1:] = (of[1:] != of[:-1]) | (first[1:] != first[:-1])
        head = np.flatnonzero(new)
        lo, hi = longer[head], longer[np.append(head[1:], len(longer)) - 1] + 1
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        known[hi] = True
    found = np.zeros(len(order), bool)
    if turn is None:
        found[order] = ~known[:-1] | ~known[1:]
        return found
    size = np.diff(np.concatenate([[0], ends + 1]))
    by = np.argsort(turn)
    begins = np.empty_like(size)
    begins[by] = np.cumsum(size[by]) - size[by]
    of = np.repeat(np.arange(len(size)), size)
    rank = (begins[of] + np.arange(len(of)) - (ends + 1 - size)[of])[order]
    first = np.minimum.reduceat(rank, np.flatnonzero(known[:-1]))
    found[order] = rank > first[np.cumsum(known[:-1]) - 1]
    return found


def transforms(batches: Iterator[pa.RecordBatch], window: int, gram: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """(key, ctx, lo, hi): runs of windows of the open segments that occur twice, or earlier. Rows come
    in groups by slot; some groups at a time make one transform."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> pa.RecordBatch:
        segments, turn = rows.column("segment").to_pylist(), None
        if keep_first:
            order = np.lexsort([rows.column(c).to_numpy() for c in ("off", "ctx", "key", "lo", "first")])
            turn = np.empty(len(order), np.int64)
            turn[order] = np.arange(len(order))
        found = repeated(segments, window, gram, turn)
        out, at = [], 0
        for key, ctx, off, asks, segment in zip(*(rows.column(c).to_pylist() for c in ("key", "ctx", "off", "open")), segments, strict=True):
            if asks:
                hit = np.flatnonzero(np.diff(np.concatenate([[0], found[at : at + len(segment) - window + 1].view(np.int8), [0]])))
                out += [(key, ctx, off + int(a), off + int(b) - 1) for a, b in zip(hit[::2], hit[1::2], strict=True)]
            at += len(segment) + 1
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], ["key", "ctx", "lo", "hi"])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("segment").nbytes
        del batch
        if size >= TRANSFORM:
            rows = pa.Table.from_batches(held).combine_chunks()
            slot = rows.column("slot").to_numpy()
            edge = np.flatnonzero(slot != slot[-1])
            done = int(edge[-1]) + 1 if len(edge) else 0  # the last group may go on in the next batch
            if done:
                yield flush(rows.slice(0, done))
                held = rows.slice(done).combine_chunks().to_batches()
                size = sum(b.column("segment").nbytes for b in held)
    if held:
        yield flush(pa.Table.from_batches(held))


def cut(segments: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """The bytes of chosen slots (key, ctx, first, lo, slot, off, n, open) out of their segments."""
    piece = F.expr(f"substring(segment, off + 1, n + {window} - 1)")
    return chosen.join(segments.select("key", "ctx", "segment"), ["key", "ctx"]).select("key", "ctx", "first", "lo", "slot", "off", "open", piece.alias("segment"))


def repeats(segments: DataFrame, window: int, gram: int, widths: tuple[int, ...], group: int, keep_first: bool) -> DataFrame:
    """(key, ctx, lo, hi): runs of windows, counted from the context's first, that occur in two places;
    of the contexts with one copy in ``segments``. With ``keep_first``: of all contexts, that occur in a
    context before, in the order of (first, lo, key, ctx).

    A round cuts segments into slots. A part that several contexts have is repeated. Parts that differ
    but share their slot's core are left for the transforms, if the slot has at most ``group`` of them,
    and for the next round's narrower slots if it has more. A slot of one window has equal parts only.
    """
    out = None
    rank = F.struct("first", "lo", "key", "ctx")
    for width in widths:
        parts = materialize(map_batches(segments, lambda b, width=width: slots(b, width, window), "key long, ctx long, copies long, first long, lo int, slot long, part long, off int, n int", rows=1024), "slots")
        tally = parts.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("times"), F.min(rank).alias("one"))
        many = tally.groupBy("slot").agg(F.count(F.lit(1)).alias("kinds"))
        live = materialize(parts.join(tally.join(many, "slot").where("kinds > 1 or times > 1"), ["slot", "part"]), "live-slots")
        release(parts)
        alike = live.where(rank != F.col("one") if keep_first else F.expr("times > 1 and copies = 1")).select("key", "ctx", F.col("off").alias("lo"), (F.col("off") + F.col("n") - 1).alias("hi"))
        # of equal parts one is enough to compare with; if both go, only a part without an equal asks
        others = live.where((F.col("kinds") > 1) & (rank == F.col("one"))).withColumn("open", F.lit(True) if keep_first else F.expr("times = 1 and copies = 1"))
        small = others.where(F.col("kinds") <= group)
        total = small.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
        met = map_groups(cut(segments, small, window), ("slot",), lambda it: transforms(it, window, gram, keep_first), "key long, ctx long, lo int, hi int", -(-total // TRANSFORM))
        found = materialize(alike.unionByName(met), "repeats")
        out = found if out is None else out.unionByName(found)
        large = others.where(F.col("kinds") > group).select("key", "ctx").distinct()
        more = width != widths[-1] and not large.isEmpty()
        rest = materialize(segments.join(large, ["key", "ctx"], "left_semi"), "segments") if more else None
        release(live, segments)
        if not more:
            return out
        segments = rest
    return out


def without(text: str | None, spans: list[dict]) -> tuple[bytes, int, int]:
    """A text's bytes without those of its spans (start, end), how many went, and in how many runs."""
    raw, kept, at, removed, runs = (text or "").encode("utf-8", "surrogatepass"), [], 0, 0, 0
    reach = -1
    for span in sorted((s["start"], s["end"]) for s in spans):
        if span[0] > reach:
            runs += 1
            kept.append(raw[max(at, 0) : span[0]])
        removed += max(0, span[1] - max(span[0], at))
        at = reach = max(at, span[1])
    return b"".join([*kept, raw[at:]]), removed, runs


def cut_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What ``without`` leaves of the texts of a batch."""
    rows = []
    for uid, text, spans in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
        rest, removed, runs = without(text, spans)
        rows.append((uid, removed, runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "n_removed", "n_spans", "cut_sha256", "kept_text"])


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, slot_parts: tuple[int, ...] = SLOTS, group: int = GROUP, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has (uid, id, n_bytes, kept_sha256 of the whole text) of each row; spans has
    (uid, spans: start and end of bytes) of each text that loses some. See ``deduplicated``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("uid", row_uid(F.col("id"), F.col("text")))
    texts = materialize(map_batches(rows, lambda b: contexts(b, window, gram), CONTEXTS, rows=_ROWS), "contexts")
    each = texts.select("uid", F.coalesce("id", F.lit((1 << 63) - 1)).alias("first"), F.inline("contexts"))
    place = F.struct("first", "uid", "lo", "at", "hi")  # of a context; its first copy has the smallest
    per_key = each.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("ctx").alias("one"), F.max("ctx").alias("other")).where("times > 1")
    shared = materialize(per_key.select("key", (F.col("one") != F.col("other")).alias("differ")), "shared")  # a plain join of files can be split where a key is frequent
    live = materialize(each.join(shared, "key"), "live-contexts")
    release(shared)
    alike = live.where("not differ")
    differ = live.where("differ")
    tally = materialize(differ.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("m")), "context-copies")
    per_text = tally.groupBy(F.col("m.uid").alias("uid")).agg(F.collect_set(F.struct("key", "ctx", "copies", "m.first", "m.at", "m.lo", "m.hi")).alias("found"))
    segments = map_batches(sorted_out(rows, tally.select(F.col("m.uid").alias("uid")), "uid")[0].join(per_text, "uid"), lambda b: with_bytes(b, window), SEGMENT, rows=_ROWS)
    segments = materialize(segments.dropDuplicates(["key", "ctx"]) if repeats_rows(texts) else segments, "segments")
    widths = (*(max(2, (window - gram) // n) for n in slot_parts), 1)
    found = repeats(segments, window, gram, widths, group, keep_first).select("key", "ctx", F.col("lo").alias("from"), F.col("hi").alias("to"))
    if keep_first:
        alike = alike.join(materialize(alike.groupBy("key").agg(F.min(place).alias("least")), "first-copies"), "key").where(place != F.col("least"))
        told = differ.join(tally.select("key", "ctx", "m"), ["key", "ctx"])
        copied, asking = told.where(place != F.col("m")), told.where(place == F.col("m"))
    else:
        copied, asking = differ.join(tally.where("copies > 1").select("key", "ctx"), ["key", "ctx"], "left_semi"), differ
    more = asking.join(found, ["key", "ctx"]).select("uid", (F.col("lo") + F.col("from")).alias("start"), (F.col("lo") + F.col("to") + window).alias("end"))
    spans = alike.select("uid", "lo", "hi").unionByName(copied.select("uid", "lo", "hi")).select("uid", F.col("lo").alias("start"), (F.col("hi") + window).alias("end")).unionByName(more)
    return texts.drop("contexts"), spans.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, uid, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row: without the bytes that
    are covered by ``window`` bytes which also start anywhere else, in this text or another. With
    ``keep_first``: which also start in a text of a smaller id or earlier in this one, so that one copy
    of what repeats stays (a null id counts as the largest; rows equal in id and text lose the same).

    kept_text is null where all stay; kept_sha256 is of the bytes that are left, kept_text leaves out
    what a cut has left of a character. Rows are documents of their own even if they are equal: both lose what they share.
    Strings are told apart by 64-bit hashes of their surroundings and, in transforms, by their bytes.
    Null texts are empty. Null ids are ids like others. No rows: no rows. Other columns are not read.
    """
    texts, per_text = removals(docs, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(row_uid(F.col(id_col).cast("long"), F.col(text_col)).alias("uid"), F.col(text_col).alias("text"))
    per_text = materialize(per_text, "spans")
    done = map_batches(sorted_out(rows, per_text, "uid")[0].join(per_text, "uid"), cut_texts, "uid binary, n_removed long, n_spans long, cut_sha256 string, kept_text string", rows=_ROWS)
    done = done.groupBy("uid").agg(*(F.first(c).alias(c) for c in ("n_removed", "n_spans", "cut_sha256", "kept_text")))
    zero = F.lit(0).cast("long")
    return texts.join(done, "uid", "left").select("id", "uid", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"), "kept_text")


def trimmed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs``, all rows and columns, with their texts less what ``deduplicated`` (with ``options``)
    removes; ``length_col`` (if there is one) is set to the new length where the text changes. Columns
    may have any names."""
    per_text = settled(lambda: removals(docs, id_col=id_col, text_col=text_col, **options)[1], "spans")
    names = [f"c{i}" for i in range(len(docs.columns))]
    packed = docs.select(row_uid(F.col(id_col).cast("long"), F.col(text_col)).alias("uid"), *(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)))
    touched, others = sorted_out(packed, per_text, "uid")
    joined = touched.join(per_text, "uid", "left")
    text, length = names[docs.columns.index(text_col)], names[docs.columns.index(length_col)] if length_col in docs.columns else None

    def trimmed(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = batch.column(text).to_pylist(), batch.column("spans").to_pylist()
        texts = [t if s is None else without(t, s)[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)]
        new = {text: pa.array(texts, batch.schema.field(text).type)}
        if length:
            sizes = zip(texts, spans, batch.column(length).to_pylist(), strict=True)
            new[length] = pa.array([n if s is None else len(t) for t, s, n in sizes], batch.schema.field(length).type)
        return pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    found = map_batches(joined, trimmed, packed.drop("uid").schema, rows=_ROWS)
    return (found if others is None else found.unionByName(others.drop("uid"))).toDF(*docs.columns)


def repeats_rows(texts: DataFrame) -> bool:
    """Whether rows are equal in id and text: then one text gives its bytes more than once."""
    return not texts.groupBy("uid").count().where("count > 1").isEmpty()
