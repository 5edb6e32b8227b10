"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in sorted(os.listdir(SF))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    return float(f"{value:.6g}") if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    rows = found.collect()
    if name in registry.ORACLE_SQL:
        expected = duck.sql(registry.ORACLE_SQL[name])
        names = sorted(found.columns)
        assert sorted(expected.columns) == names
        order = [expected.columns.index(n) for n in names]
        assert sorted(str([plain(r[n]) for n in names]) for r in rows) == sorted(str([plain(r[i]) for i in order]) for r in expected.fetchall())
    else:
        assert rows


def test_plans_push_down(spark):
    plan = registry.QUERIES["numeric_profile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "l_quantity" in plan
