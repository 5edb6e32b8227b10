"""Search of many queries against the similarity of every pair."""

import math
import random
from functools import reduce
from operator import add

import pyarrow as pa
import pytest

from tessera.operators import index, nearest


def cosine(a, b):
    if not a or not b or len(a) != len(b) or not all(x is not None and math.isfinite(x) for x in [*a, *b]) or not any(a) or not any(b):
        return 0.0
    dot = lambda x, y: reduce(add, (p * q for p, q in zip(x, y)), 0.0)  # noqa: E731  sum() compensates its errors
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


@pytest.mark.parametrize(("least", "k", "partitions"), [(-1.0, 7, 1), (0.0, 3, 5), (0.4, 4, 3), (-1.0, 2000, 2)])
def test_search_many(spark, least, k, partitions):
    r = random.Random(7)
    rows = [[r.gauss(0, 1) for _ in range(8)] for _ in range(1500)]
    rows += [rows[0]] * 40 + [[3 * x for x in rows[0]], [0.0] * 8, None, [], [math.nan] * 8, [math.inf] + [1.0] * 7, [None] * 8, [1.0, 2.0], [-x for x in rows[0]]]
    records = [(r.choice("ab"), i, v) for i, v in enumerate(rows)]
    queries = [(i, rows[i]) for i in range(0, 60, 3)] + [(100, [1.0, 2.0]), (101, [0.0] * 8), (102, None), (None, rows[1])]
    found = index.search_many(spark.createDataFrame(records, "doc_name string, chunk_id long, vector array<double>").repartition(partitions), spark.createDataFrame(queries, "query_id long, query array<double>"), k=k, min_score=least)
    got = {}
    for x in found.collect():
        got.setdefault(x["query_id"], {})[x["place"]] = (x["doc_name"], x["chunk_id"], x["score"])
    for i, q in queries:
        scores = sorted(((-s, name, at) for name, at, v in records if (s := cosine(v, q)) >= least))[:k]
        mine = got.get(i, {})
        assert [mine[p + 1][:2] for p in range(len(mine))] == [(name, at) for _, name, at in scores]
        assert all(abs(mine[p + 1][2] + s) < 1e-12 for p, (s, _, _) in enumerate(scores))


def test_bounds_of_centroids(spark):
    """Rows that lie together are passed over for queries elsewhere; the bound is never below the best row."""
    import numpy as np

    r = np.random.default_rng(1)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    queries = unit(r.normal(size=(50, 16)))
    for spread in (0.01, 0.3, 5.0):
        rows = unit(np.eye(16)[0] + spread * r.normal(size=(300, 16)))
        bound = nearest.reachable(rows, queries)
        assert (bound >= (queries @ rows.T).max(axis=1)).all()
        if spread == 0.01:
            assert (bound < 0.9).any()


def test_clustered_records(spark):
    """Laid out by clusters, records give the same rows, and batches lie closer together than before."""
    import numpy as np

    r = np.random.default_rng(2)
    centers = r.normal(size=(12, 8))
    rows = [(i, (centers[i % 12] + 0.05 * r.normal(size=8)).tolist()) for i in range(1200)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0]), (2003, [])]
    records = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    laid = nearest.clustered(records, clusters=12)
    assert sorted(map(str, laid.collect())) == sorted(map(str, records.collect())) and laid.columns == records.columns
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 100, 9)], "query_id long, query array<double>")
    search = lambda of: sorted(map(tuple, index.search_many(of, queries, k=5, ties=("vec_id",)).select("query_id", "place", "vec_id").collect()))
    assert search(laid) == search(records)
    spread = lambda df: np.mean([(u := nearest.usable(pa.array([list(x) for x in v]))[8].unit) @ u.mean(axis=0) for v in np.array_split([x["vector"] for x in df.collect() if x["vector"] and len(x["vector"]) == 8 and any(x["vector"])], 24)])
    assert spread(laid) > spread(records) + 0.3
    assert nearest.clustered(records.limit(0)).count() == 0


def test_nothing_to_search(spark):
    records = spark.createDataFrame([("a", 1, [1.0])], "doc_name string, chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, query array<float>")
    assert index.search_many(records.limit(0), queries).count() == index.search_many(records, queries.limit(0)).count() == 0
    assert index.search_many(records, queries).first()["score"] == 1.0
