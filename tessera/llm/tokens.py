"""Words of whole Arrow columns as 64-bit hashes, and hashes of runs of words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.arrow import mixed

#: Bytes of text that are worked on at once (one text at least).
CHUNK = 1 << 20
#: White space: blank, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(int(base), np.empty(0, np.uint64))
    if len(known) < n:
        known = np.full(max(n, 2 * len(known), 4096), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= CHUNK * 2:
            _powers[int(base)] = known
    return known[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def prefix_sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Sums of values[i] * base ** i up to each place: one more entry than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """The hash of values[start:end] whatever its place: equal runs have equal hashes. Different ones of
    under 1024 entries differ but for a chance of about 2 ** -58; longer ones can be built that don't."""
    return mixed((sums[end] - sums[start]) * powers(inverse(base), len(sums))[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """The words of some texts: ``of`` is each word's text, ``first`` where each text's words begin
    (one more entry than texts), ``start`` and ``end`` their bytes in ``raw``."""

    rows: range
    raw: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def chunks(bounds: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def words(column: pa.Array) -> Iterator[Words]:
    """The words of a column of texts, some texts at a time. A word is a run of anything but ASCII
    white space, unchanged; no word reaches into the next text. The hash of a word is a sum of 64-bit
    numbers that are as good as random, one for each byte and its place in the word; so no pattern of
    bytes makes words alike, and two of n different words are alike with probability n * n / 2 ** 65."""
    raw, bounds = utf8(column)
    for lo, hi in chunks(bounds):
        part, ends = raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        solid = ~_SPACE[part]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        inner = ends[1:-1]
        inner = inner[(inner > 0) & (inner < len(part))]
        begins[inner] = solid[inner]
        stops[inner - 1] = solid[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        size = end - start
        until = np.cumsum(size)
        place = np.arange(until[-1] if len(until) else 0) - np.repeat(until - size, size)
        sums = np.zeros(len(place) + 1, np.uint64)
        np.cumsum(mixed(place.astype(np.uint64) << np.uint64(8) | part[solid]), out=sums[1:])
        yield Words(range(lo, hi), part, ends, start, end, np.searchsorted(start, ends), mixed(sums[until] - sums[until - size] + size.astype(np.uint64)))
