"""Near-duplicate embeddings: p-stable Euclidean hashing with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import map_batches, mixed
from tessera.llm.components import components, numbered
from tessera.session import materialize

COSINE = 0.95
#: Projections a table and tables. Two unit vectors at cosine 0.95 meet in one of them with
#: probability 0.994, at 0.96 with 0.999; two unrelated ones meet in a given table with 5e-6.
PROJECTIONS = 16
TABLES = 48
#: Cell width in units of the distance of two unit vectors at the threshold.
WIDTH = 6.0
#: Vectors of a bucket that one task compares with one another; larger buckets are split into blocks.
BLOCK = 512


def is_usable(vector: Column) -> Column:
    """Neither null nor zero, and all components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: list | np.ndarray) -> np.ndarray:
    """The rows as unit vectors; each is scaled by its largest component first, so no square overflows."""
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keys(x: np.ndarray, cosine: float, projections: int, tables: int, seed: int = 1) -> np.ndarray:
    """(rows, tables) of 32-bit bucket keys: quantised random projections, several a table."""
    random = np.random.default_rng([seed, x.shape[1]])
    width = WIDTH * np.sqrt(2 - 2 * cosine)
    cells = np.floor((x @ random.standard_normal((x.shape[1], projections * tables)) + random.random(projections * tables) * width) / width)
    factors = mixed(np.arange(1, projections + 1, dtype=np.uint64)) | np.uint64(1)
    hashed = mixed((cells.astype(np.int64).astype(np.uint64).reshape(len(x), tables, projections) * factors).sum(axis=2, dtype=np.uint64))
    return (hashed >> np.uint64(32)).astype(np.uint32).view(np.int32)


GROUP = ("dim", "tab", "k", "bi", "bj")
#: Buckets of at most so many vectors are compared many at a time, larger ones each by a matrix product.
SMALL = 32
#: Pairs that are compared at once.
PAIRS = 1 << 16


def pairs_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of the groups first..last (exclusive)."""
    rows = np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first) + np.arange((last - first).sum())
    after = np.repeat(last, last - first) - rows - 1
    i = np.repeat(rows, after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def compared(rows: pa.Table, cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """The links of some buckets, or pairs of blocks of them, whose rows follow one another: for each
    vector its number of links that no earlier table shows, and links enough to connect what is linked."""
    dim, n = rows.column("dim")[0].as_py(), rows.num_rows
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    x, seen = unit(flat("vec")).reshape(n, dim), flat("ks")
    ids, copies, block, table = (rows.column(c).to_numpy() for c in ("rep", "copies", "block", "tab"))
    crossing = rows.column("bi").to_numpy() != rows.column("bj").to_numpy()
    group = np.stack([rows.column(c).to_numpy() for c in GROUP])
    first = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
    last = np.append(first[1:], n)
    total = np.zeros(n, np.int64)
    root = np.arange(n)
    links: list[tuple[int, int]] = []

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    def connect(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(ids[a]), int(ids[b])))

    small = last - first <= SMALL
    i, j = pairs_of(first[small], last[small])
    for lo in range(0, len(i), PAIRS):
        a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
        near = (np.einsum("pd,pd->p", x[a], x[b]) >= cosine) & ~(crossing[a] & (block[a] == block[b]))
        a, b = a[near], b[near]
        new = ~((seen[a] == seen[b]) & (np.arange(seen.shape[1]) < table[a][:, None])).any(axis=1)
        np.add.at(total, a[new], copies[b[new]])
        np.add.at(total, b[new], copies[a[new]])
        connect(a, b)
    for lo, hi in zip(first[~small], last[~small], strict=True):
        near = x[lo:hi] @ x[lo:hi].T >= cosine
        if crossing[lo]:
            near &= block[lo:hi][:, None] != block[lo:hi][None, :]
        np.fill_diagonal(near, False)
        new = near.copy()
        for t in range(table[lo]):
            new &= seen[lo:hi, t][:, None] != seen[lo:hi, t][None, :]
        total[lo:hi] += (new * copies[lo:hi][None, :]).sum(axis=1)
        label = np.arange(hi - lo)
        while True:
            least = np.minimum(label, np.where(near, label[None, :], hi - lo).min(axis=1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        links += [(int(ids[lo + v]), int(ids[lo + label[v]])) for v in np.flatnonzero(label != np.arange(hi - lo))]
    counts: dict[int, int] = {}
    for v in np.flatnonzero(total):
        counts[int(ids[v])] = counts.get(int(ids[v]), 0) + int(total[v])
    return counts, links


def compared_groups(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of rows that come in groups: b null, or n 0. A group may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = rows.column("dim").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            counts, links = compared(rows.slice(lo, hi - lo), cosine)
            columns = [*counts, *(a for a, _ in links)], [*([None] * len(counts)), *(b for _, b in links)], [*counts.values(), *([0] * len(links))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        same = np.ones(rows.num_rows, bool)
        for c in GROUP:
            of = rows.column(c).to_numpy()
            same &= of == of[-1]
        done = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if done:
            yield from flush(rows.slice(0, done))
            held = rows.slice(done).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield from flush(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, projections: int = PROJECTIONS, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: vectors linked at cosine >= ``cosine``.

    Equal vectors are one vector with a number of copies. Distinct ones are normalised and hashed
    into ``tables`` buckets each; those that share a bucket are compared exactly, in double
    precision. A bucket that lies within one bucket of the table before is not compared again. A large
    bucket is dealt out as pairs of blocks, each compared in its own task, which gives counts and a
    few connecting links, never all pairs. A pair counts in the first table that shows it.

    Vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors
    of different lengths do not link. Repeated rows are vectors of their own. A row with a null id
    counts as a link of others, but has no component and is not kept. No rows: no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    usable = rows.where(is_usable(F.col("vec")))
    distinct = usable.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, out = batch.column("vec").to_pylist(), [None] * batch.num_rows
        for size in {len(v) for v in lists}:
            at = [i for i, v in enumerate(lists) if len(v) == size]
            for i, k in zip(at, keys(unit([lists[i] for i in at]), cosine, projections, tables), strict=True):
                out[i] = k
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "ks"])

    kind = rows.schema["vec"].dataType.simpleString()
    known = numbered(materialize(map_batches(distinct, hashed, f"vec {kind}, rep long, copies long, ks array<int>", rows=2048), "vector-keys"), "vec")
    placed = known.where("rep is not null").select("rep", F.size("vec").alias("dim"), F.posexplode("ks").alias("tab", "k"), F.when(F.col("tab") > 0, F.expr("ks[tab - 1]")).alias("before"))
    buckets = placed.groupBy("dim", "tab", "k").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("lo"), F.max("before").alias("hi"))
    buckets = buckets.where((F.col("n") > 1) & (F.col("lo").isNull() | (F.col("lo") != F.col("hi")))).select("dim", "tab", "k", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    chosen = materialize(placed.join(buckets, ["dim", "tab", "k"]).select("rep", "dim", "tab", "k", "blocks"), "vector-buckets")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("rep", "tab"), F.col("blocks")).cast("int")).withColumn("other", other)
    dealt = dealt.select("rep", "dim", "tab", "k", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    full = dealt.join(known.select("rep", "vec", "ks", "copies"), "rep")
    met = full.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = materialize(met.mapInArrow(lambda batches: compared_groups(batches, cosine), "a long, b long, n long"), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    parts = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    classes = known.select("vec", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
    classes = classes.withColumn("component", F.coalesce("component", "rep")).join(known.select(F.col("rep").alias("component"), "least"), "component", "left")
    classes = classes.select(F.col("vec").alias("of"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id"))
    linked = usable.join(classes, F.col("vec") == F.col("of")).select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = rows.where(~is_usable(F.col("vec"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
