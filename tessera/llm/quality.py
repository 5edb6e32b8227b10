"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Shallow trees on one feature at a time, boosted in turn, add up to
one lookup table a feature; shallow trees on the strongest pairs then fit what is left over. A score
is the sigmoid of the sum of the bins' entries, so scoring adds looked-up numbers only.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from itertools import combinations
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import held_out, map_batches, texts

FEATURES = ("chars", "words", "word_length", "distinct_words", "neighbours_equal", "upper", "lower", "digits", "marks", "pipes", "shouts", "lines", "distinct_lines", "ends")
THRESHOLD = 0.3
#: The most labelled rows that training takes, by hash of their id. Their features, not their texts, go to the driver.
TRAINING_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS = 250
RATE = 0.1

UPPER, LOWER, DIGITS = (x.encode() for x in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
MARKS = "".join(x for x in string.punctuation if x not in ".,|!").encode()


def features(text: str) -> list[float]:
    """Numbers that describe a text's shape; the empty text has zeros."""
    words, raw = text.split(), text.encode("utf-8", "surrogatepass")
    n, size, lines = max(len(words), 1), max(len(raw), 1), text.split("\n")
    share = lambda of: (len(raw) - len(raw.translate(None, of))) / size
    return [
        log1p(len(text)), log1p(len(words)), len(text) / n, len(set(words)) / n**0.75, sum(map(eq, words, words[1:])) / n,
        share(UPPER), share(LOWER), share(DIGITS), share(MARKS), text.count("|") / n, text.count("!") / n,
        log1p(len(lines)), len(set(lines)) / len(lines), (text.count(". ") + text.count(".\n")) / n,
    ]


@dataclass
class Additive:
    """Bin edges, the table of each feature, and (feature, feature, table) of each pair."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def cut(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges at quantiles of the distinct values' places."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + 1.0)


def _leaves(g: np.ndarray, h: np.ndarray, lo: int, hi: int, depth: int, out: np.ndarray) -> None:
    """A tree of ``depth`` on the bins lo..hi-1 of one feature: its steps are written into ``out``."""
    gs, hs = g[lo:hi].cumsum(), h[lo:hi].cumsum()
    if depth and hi - lo > 1:
        gains = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1])
        at = int(gains.argmax())
        if gains[at] > _gain(gs[-1], hs[-1]) + 1e-9:
            _leaves(g, h, lo, lo + at + 1, depth - 1, out)
            _leaves(g, h, lo + at + 1, hi, depth - 1, out)
            return
    out[lo:hi] = gs[-1] / (hs[-1] + 1.0)


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best single cut on both axes at once: (gain, table of steps) of its four leaves."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    blocks = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gains = sum(_gain(a, b) for a, b in zip(blocks(gc), blocks(hc), strict=True))
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    steps = [float(np.broadcast_to(a, gains.shape)[i, j] / (np.broadcast_to(b, gains.shape)[i, j] + 1.0)) for a, b in zip(blocks(gc), blocks(hc), strict=True)]
    table = np.empty_like(g)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = steps
    return float(gains[i, j] - _gain(gc[-1, -1], hc[-1, -1])), table


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = ROUNDS, rate: float = RATE, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS) -> Additive:
    """The model of rows ``x`` and 0/1 labels ``y``. No rows: a model that says 0.5 everywhere."""
    width = x.shape[1]
    if not len(x):
        return Additive([np.empty(0)] * width, [np.empty(0)] * width, 0.0, [np.zeros(1)] * width, [])
    rate_of_ones = min(max(y.mean(), 1e-3), 1 - 1e-3)
    edges, pair_edges = [cut(x[:, j], bins) for j in range(width)], [cut(x[:, j], pair_bins) for j in range(width)]
    model = Additive(edges, pair_edges, float(np.log(rate_of_ones / (1 - rate_of_ones))), [np.zeros(len(e) + 1) for e in edges], [])
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    total = np.full(len(x), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            n, step = len(model.tables[j]), np.zeros(len(model.tables[j]))
            _leaves(np.bincount(at[j], g, n), np.bincount(at[j], h, n), 0, n, 2, step)
            model.tables[j] += rate * step
            total += rate * step[at[j]]

    g, h = slopes()
    places = [np.searchsorted(pair_edges[j], x[:, j], side="right") for j in range(width)]

    def grid(a, b, weights):
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        return np.bincount(places[a] * shape[1] + places[b], weights, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(width), 2), key=lambda ab: (-_quarters(grid(*ab, g), grid(*ab, h))[0], ab))[:pairs]
    tables = {ab: np.zeros_like(grid(*ab, g)) for ab in ranked}
    for _ in range(rounds // 5):
        for a, b in ranked:
            g, h = slopes()
            step = _quarters(grid(a, b, g), grid(a, b, h))[1] * rate
            tables[a, b] += step
            total += step[places[a], places[b]]
    model.pairs = [(a, b, table) for (a, b), table in tables.items()]
    return model


def _table(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in texts(batch.column("text"))]).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Additive:
    """Fit on labelled rows that are not held out, at most ``rows`` of them by hash of their id.

    Null ids or labels are passed over; of repeated ids in ``labels`` the larger label counts.
    """
    label = F.col(label_col).cast("int")
    usable = labels.where(label.isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    some = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label).alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    # ``some`` has at most ``rows`` rows of two numbers
    met = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("__doc") == F.col("__id"))

    def numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(batch.column("__doc").cast(pa.string())), batch.column("__label"), pa.array(_table(batch).tolist(), pa.list_(pa.float64()))], ["id", "label", "x"])

    found = map_batches(met, numbers, "id string, label int, x array<double>").orderBy(F.xxhash64("id"), "id", "x").limit(rows).collect()
    return fit(np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([min(r["label"], 1) for r in found], dtype=float))


def scored(docs: DataFrame, model: Additive, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from its whole text. Null and empty texts are scored as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(_table(batch)))], ["id", "score"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, score double")


def good_documents(docs: DataFrame, model: Additive, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in texts(batch.column(names.index(text_col)))]).reshape(-1, len(FEATURES))
        return batch.filter(pa.array(model.score(x) >= threshold))

    return map_batches(docs, run, docs.schema)
