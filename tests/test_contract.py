"""Registered queries against their SQL at the smallest scale (all with CITELOOM_ALL=1)."""

import os
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
SAMPLE = ["v3_cosine_search", "g7_ranked_nodes", "u7_context", "a4_usage_counts", "k5_edge_merge", "k15_delete_cascade_nodes",
          "f13_f14_chunks", "f7_sections", "x1_search_nodes", "p23_without_conflicts", "a8_eval_summary", "r5_recent_requests"]


def names():
    from __spark_entry__ import oracle_sql

    return sorted(oracle_sql()) if os.environ.get("CITELOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("test tables are not there")
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    from tools.oracle_check import rows

    df = queries()[name](spark, SF)
    got, columns = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracle_sql()[name])
    want, wanted = rows([c[0] for c in cur.description], cur.fetchall())
    assert columns == wanted and got == want


def test_entry_has_rows_and_every_statement_a_query(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
