"""Language identification with error-correcting output codes over hashed n-grams.

Each language has a codeword. For each bit of the codewords a binary n-gram classifier (log-odds of
hashed byte trigrams) tells which half of the languages a text belongs to; the codeword with the
least loss, weighted by the bits' margins, names the language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import held_out, map_batches

BINS = 1 << 13
#: The most training documents, by hash of their id; their texts stay in the tasks, counts go on.
TRAINING_ROWS = 20_000
#: Bits of a codeword where the exhaustive code would be longer.
MOST_BITS = 31
UNKNOWN = "und"
#: Scores below this are flagged as ambiguous.
SURE = 0.5


def codewords(n: int, most: int = MOST_BITS) -> np.ndarray:
    """n rows of -1/+1: the exhaustive code where it has at most ``most`` bits, else fixed random bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 16 and (1 << (n - 1)) - 1 <= most:
        columns = range(1, 1 << (n - 1))
        return np.array([[1 if c >> k & 1 else -1 for c in columns] for k in range(n)], dtype=float)
    code = np.where(np.random.default_rng(7).random((n, most + n.bit_length() * 8)) < 0.5, -1.0, 1.0)
    return code[:, np.abs(code.sum(0)) < n]


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def histograms(column: pa.Array, bins: int = BINS) -> np.ndarray:
    """(texts, bins): counts of hashed trigrams of the lower-cased UTF-8 bytes of whole texts.

    ASCII other than letters counts as one blank; grams across two texts or with more than one
    blank do not count."""
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    start = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = low.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[start[0] : start[-1]] if data is not None else np.empty(0, np.uint8)
    out = np.empty((len(low), bins), np.float32)
    for i, (lo, hi) in enumerate(zip(start[:-1] - start[0], start[1:] - start[0], strict=True)):
        c = _FOLD[raw[lo:hi]]
        if len(c) < 3:
            out[i] = 0
            continue
        blank = (c == 32).astype(np.int8)
        ok = blank[:-2] + blank[1:-1] + blank[2:] < 2
        gram = ((c[:-2] * 65599 + c[1:-1]) * 65599 + c[2:])[ok]
        out[i] = np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - bins.bit_length() + 1), minlength=bins)
    return out


@dataclass
class Decoder:
    """The languages, their codewords, and for each bit the grams' log-odds."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each row. The margin of a bit is the mean log-odds
        a gram; the loss of a codeword is the logistic loss of its bits, weighted by the margins."""
        grams = np.maximum(counts.sum(1, keepdims=True), 1)
        margin = counts @ self.weights / np.sqrt(grams)
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) * (np.abs(margin) + 1e-3)[:, None, :]
        loss = loss.sum(2) / (np.abs(margin).sum(1, keepdims=True) + 1e-3)
        likely = np.exp(-(loss - loss.min(1, keepdims=True)) * 2)
        likely /= likely.sum(1, keepdims=True)
        best = loss.argmin(1)
        return best, likely[np.arange(len(best)), best]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS) -> Decoder:
    """Learn from documents that have a language and are not held out, at most ``rows`` of them.

    Only the grams' counts, one row of ``BINS`` numbers a language and batch, leave the tasks."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    edge = usable.select(F.xxhash64(id_col).alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    taken = usable.where(F.xxhash64(id_col) <= F.lit(edge if edge is not None else 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, langs = histograms(batch.column("text")), np.array(batch.column("lang").to_pylist())
        names, bins, numbers = [], [], []
        for lang in np.unique(langs):
            total = np.minimum(counts[langs == lang], 50).sum(0)
            used = np.flatnonzero(total)
            names += [str(lang)] * len(used)
            bins.append(used)
            numbers.append(total[used])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(bins), pa.int32()), pa.array(np.concatenate(numbers), pa.float64())], ["lang", "bin", "n"])

    grams = map_batches(taken, count, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = grams.collect()  # languages x BINS numbers at most
    languages = sorted({r["lang"] for r in found})
    counts = np.zeros((len(languages), BINS))
    for r in found:
        counts[languages.index(r["lang"]), r["bin"]] = r["n"]
    shares = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if languages else counts
    code = codewords(len(languages))
    weights = np.zeros((BINS, code.shape[1]))
    for bit in range(code.shape[1]):
        sides = [shares[code[:, bit] == side].mean(0) if (code[:, bit] == side).any() else None for side in (1, -1)]
        if sides[0] is not None and sides[1] is not None:
            weights[:, bit] = np.log(sides[0]) - np.log(sides[1])
    return Decoder(languages, code, weights)


def identified(docs: DataFrame, decoder: Decoder, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row, from its whole text.

    Null texts and texts without a letter: ``und`` with score 0. So is every text if nothing was learned."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = pc.fill_null(batch.column("text"), "")
        letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False) & bool(decoder.languages)
        names, score = np.full(len(column), UNKNOWN, dtype=object), np.zeros(len(column))
        if letters.any():
            best, sure = decoder.predict(histograms(column.filter(pa.array(letters))))
            names[letters], score[letters] = np.array(decoder.languages, dtype=object)[best], sure
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(score < SURE)], ["id", "lang_pred", "score", "ambiguous"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, lang_pred string, score double, ambiguous boolean")
