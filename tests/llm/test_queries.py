"""The registered queries on the smallest tables: against SQL where there is any, and the pipeline against its stages' rules."""

import re
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not there")


def names():
    from citeloom.llm.queries import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    from citeloom.llm.queries import ORACLES, QUERIES
    from tools.oracle_check import rows

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


def test_registered_with_the_library():
    from __spark_entry__ import oracle_sql, queries

    found = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 14)) and "pipeline" in queries()
    assert set(names()) <= set(oracle_sql())


def test_languages_are_right_on_held_out_rows(spark):
    from citeloom.llm.queries import QUERIES, table

    got = QUERIES["op1_language"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from citeloom.llm.queries import table

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    steps = [before]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= steps[-1]
        steps.append(set(ids))
        if name != "sharding":
            assert out.columns == columns
            docs = out
    assert len(steps[1]) == len(steps[0]) and len(steps[2]) < len(steps[1]) and steps[-1] == steps[-2]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == steps[-1]
