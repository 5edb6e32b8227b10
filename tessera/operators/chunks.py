"""Cutting documents into chunks of a bounded number of tokens."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import chunk_tokens, paragraphs

MOST_TOKENS = 400
#: Texts that are cut at once.
BATCH_TEXTS = 256
#: What is trimmed off paragraphs: white space of any script.
SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def greedy_chunks(text: Column, most: int = MOST_TOKENS) -> Column:
    """Paragraphs packed in order into chunks of at most ``most`` tokens, without overlap, as one fold in
    the JVM. A paragraph of more tokens is a chunk of its own here; ``chunks`` splits it."""
    most = most if most > 0 else MOST_TOKENS
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("tokens"))

    def step(state: Column, part: Column) -> Column:
        size = chunk_tokens(part)
        full = (state["open"] != "") & (state["tokens"] + size > most)
        done = F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        held = F.when(full | (state["open"] == ""), part).otherwise(F.concat(state["open"], F.lit("\n\n"), part))
        return F.struct(done.alias("done"), held.alias("open"), F.when(full, size).otherwise(state["tokens"] + size).alias("tokens"))

    return F.aggregate(paragraphs(text), start, step, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def _tokens(text: str) -> int:
    return len(text) // 4


def _pieces(paragraph: str, most: int) -> list[str]:
    """A paragraph that is too long, by lines; a line that is too long by characters."""
    out: list[str] = []
    lines: list[str] = []
    for line in paragraph.split("\n"):
        if lines and (_tokens(line) > most or sum(map(_tokens, lines)) + _tokens(line) > most):
            out.append("\n".join(lines))
            lines = []
        if _tokens(line) > most:
            whole = line.strip()
            out += [whole[i : i + most * 4] for i in range(0, len(whole), most * 4)]
        else:
            lines.append(line)
    return out + (["\n".join(lines)] if lines else [])


def _cuts(upto: np.ndarray, lo: int, hi: int, long: list[int], most: int, overlap: int) -> Iterator[tuple[int, int] | None]:
    """The chunks of one text as ranges of its paragraphs lo..hi, whose sizes add up to ``upto``; None stands for a
    paragraph that is too long, each of which comes before the paragraph in ``long``."""

    def kept(a: int, e: int) -> int:
        return max(a, min(int(np.searchsorted(upto, upto[e] - overlap, side="left")), e - 1)) if overlap else e

    a = b = lo
    for stop in [*long, None]:
        end = hi if stop is None else stop
        while True:
            e = min(max(int(np.searchsorted(upto, upto[a] + most, side="right")) - 1, b), end)
            if e == end:
                break
            yield a, e
            a, b = kept(a, e), e + 1
        b = end
        if stop is not None:
            if a < b:
                yield a, b
                a = kept(a, b)
            yield None
    if a < b:
        yield a, b


def cut_texts(texts: pa.Array, most: int = MOST_TOKENS, overlap: int = 0) -> list[list[str]]:
    """Chunks of each text: paragraphs packed greedily; a chunk starts with the last paragraphs of the one
    before, as many as ``overlap`` tokens hold but one at least (so it may exceed ``most``). Null is empty.

    All texts are split at once; where a chunk ends is looked up in the running sums of its paragraphs' sizes,
    so the steps taken one by one are chunks, not paragraphs."""
    most, overlap = most if most > 0 else MOST_TOKENS, max(overlap, 0)
    split = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n\n")
    parts, of = pc.utf8_trim(split.flatten(), characters=SPACES), pc.list_parent_indices(split)
    some = pc.not_equal(parts, "")
    parts, of = parts.filter(some), of.filter(some).to_numpy()
    size = pc.utf8_length(parts).to_numpy(zero_copy_only=False) // 4
    fits = size <= most
    upto = np.concatenate([[0], np.cumsum(np.where(fits, size, 0))])
    # paragraphs that fit are numbered over all texts; the others know the number of the next that fits
    number = np.concatenate([[0], np.cumsum(fits)])
    upto = upto[np.concatenate([np.flatnonzero(fits), [len(fits)]])]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    strings = parts.to_pylist()
    ordinary = [strings[i] for i in np.flatnonzero(fits)]
    too_long = np.flatnonzero(~fits)
    edges = np.searchsorted(too_long, bounds)
    out = []
    for i in range(len(texts)):
        rest = iter(too_long[edges[i] : edges[i + 1]].tolist())
        before = number[too_long[edges[i] : edges[i + 1]]].tolist()
        made: list[str] = []
        for cut in _cuts(upto, int(number[bounds[i]]), int(number[bounds[i + 1]]), before, most, overlap):
            if cut is None:
                made += _pieces(strings[next(rest)], most)
            else:
                made.append("\n\n".join(ordinary[cut[0] : cut[1]]))
        out.append(made)
    return out


def split_text(text: str, most: int = MOST_TOKENS, overlap: int = 0) -> list[str]:
    """The chunks of one text."""
    return cut_texts(pa.array([text], pa.string()), most, overlap)[0]


def chunks(docs: DataFrame, *, id_col: str = "doc_id", name_col: str = "source", text_col: str = "text", most: int = MOST_TOKENS, overlap: int = 0, per_document: int = 0) -> DataFrame:
    """(doc_id, doc_name, chunk_id, text, chunk_hash): each document's chunks, the first ``per_document`` of
    them (0: all). Texts are cut where they lie, a batch at a time."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array(cut_texts(texts, most, overlap), pa.list_(pa.string()))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_TEXTS))
    parts = cut(F.col(text_col))
    parts = F.slice(parts, 1, per_document) if per_document > 0 else parts
    long = docs.select(F.col(id_col).alias("doc_id"), F.col(name_col).alias("doc_name"), F.posexplode(parts).alias("chunk_id", "text"))
    return long.withColumn("chunk_hash", F.sha1("text"))
