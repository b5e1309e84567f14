"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from palimpsest.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    want = duck.sql(registry.SQL[name])
    columns = sorted(want.columns)
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    place = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in place) for r in want.fetchall()), key=repr)


def test_queries_without_sql_run(spark):
    for name in set(registry.QUERIES) - set(registry.SQL):
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_plans_stay_in_the_engine(spark):
    """No row-at-a-time Python and no cross product of tables; filters and columns reach the scan."""
    for name in ("asof_event_per_day", "search_bm25", "citation_parse", "version_runs_events"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    plan = registry.QUERIES["throttle_sliding_15m"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "props" not in plan.split("ReadSchema")[1][:200]
