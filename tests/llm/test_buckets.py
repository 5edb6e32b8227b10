"""Rows that near-duplicate search makes of its buckets."""

import random
from collections import defaultdict

import pytest

from tessera.llm import minhash


def words(r, n):
    return ["".join(r.choice("aeiourstlnm") for _ in range(6)) for _ in range(n)]


def table(spark, copies, others):
    """Near copies of a text, and unlike texts that have half of it."""
    r = random.Random(3)
    text = words(r, 80)
    rows = []
    for i in range(copies):
        one = list(text)
        one[i % 80] = words(r, 1)[0]
        rows.append((i, " ".join(one)))
    rows += [(1000 + i, " ".join(text[20:60] + words(r, 40))) for i in range(others)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture
def opened(spark, monkeypatch):
    """Rows of the buckets that are compared after the first round, and the classes found."""
    real = minhash.materialize

    def run(docs, **options):
        seen = []

        def kept(df, name):
            out = real(df, name)
            if name == "opened":
                seen.extend(out.collect())
            return out

        with monkeypatch.context() as m:
            m.setattr(minhash, "materialize", kept)
            found = {x["id"]: x["component_id"] for x in minhash.near_duplicates(docs, **options).collect()}
        return seen, found

    return run


def test_members_of_a_large_part_are_not_looked_up_in_its_buckets(spark, opened):
    rows, found = opened(table(spark, 40, 12), block=4)
    assert {r["rep"] for r in rows if r["most"] is not None} >= set(range(1000, 1012))
    assert all(r["part"] != r["top"] for r in rows if r["most"] is not None)
    assert found == {i: 0 if i < 1000 else i for i in found} and len(found) == 52


def test_buckets_of_the_same_texts_are_opened_once(spark, opened):
    rows, found = opened(table(spark, 3, 12))
    buckets = defaultdict(list)
    for r in rows:
        buckets[r["bucket"]].append(r["rep"])
    held = [tuple(sorted(x)) for x in buckets.values()]
    assert held and len(set(held)) == len(held) and all(len(set(x)) == len(x) > 1 for x in held)
    assert found == {i: 0 if i < 1000 else i for i in found}


def test_rows_grow_with_the_group_not_with_its_square(spark, opened):
    few, many = (len(opened(table(spark, n, 12), block=4)[0]) for n in (40, 80))
    assert 0 < many <= 2 * few + 12
