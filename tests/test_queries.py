import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cur = duck.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_bloom_has_no_false_negatives(spark):
    rows = catalogue.queries()["bloom_probe"](spark, SF).collect()
    assert all(r.may_contain for r in rows if r.present)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_predicates_reach_the_scan(spark):
    plan = catalogue.queries()["scan_prefix"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.index("Window") < plan.index("StartsWith")
