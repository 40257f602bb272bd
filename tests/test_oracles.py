"""Every registered query against its DuckDB oracle, at sf0.001."""

import duckdb
import pytest

from rivulet.plans import all_oracles, all_queries
from rivulet.session import TABLES
from scripts.compare import digest

ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_a_reason():
    rows_only = set(all_queries()) - set(ORACLES)
    assert rows_only == set(), rows_only


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = all_queries()[name](spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLES[name])
    d_cols, d_rows = list(rel.columns), rel.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows)[0] == digest(d_cols, d_rows)[0]
    # no pair-forming joins and no row-at-a-time Python in any registered plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"
