"""Every registered query against its DuckDB SQL (the driver's correctness gate),
on the smallest fixture so the suite stays quick; tools/oracle_check.py runs the
same comparison at sf0.01."""

import duckdb
import pytest

import __spark_entry__ as E
from ragtab.plans import catalog
from tools.oracle_check import TABLES, rows_of

from conftest import SF_SMALL

NAMES = sorted(catalog.QUERIES)   # the queries of ragtab.llm have their own tests
SQL = catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_oracle_or_is_listed():
    rows_only = {"approx_topk_recall"}
    assert set(NAMES) - set(SQL) == rows_only
    assert set(SQL) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan   # no pair explosion
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert len(s_rows) > 0
        return
    rel = duck.execute(SQL[name])
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "context"]
    assert df.count() > 0
