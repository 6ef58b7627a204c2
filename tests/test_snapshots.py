"""Tables that change together."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from citeloom.operators.merge import merge_edges
from citeloom.sources.snapshots import Conflict, Snapshots, Table

NODES = StructType().add("node_id", StringType()).add("name", StringType())
EDGES = StructType().add("src", StringType()).add("dst", StringType()).add("rel_type", StringType()).add("evidence_text", StringType()).add("occurrence_count", LongType())
TABLES = {"nodes": Table(NODES, ("node_id",)), "edges": Table(EDGES, ("src", "dst", "rel_type"))}


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "graph"), TABLES, buckets=8)


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODES)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables_change_together_or_not_at_all(spark, store, tmp_path):
    assert store.version() == 0 and found(store.read("nodes")) == []
    first = store.begin().upsert("nodes", nodes(spark, ("a", "A"), ("b", "B")))
    assert found(store.read("nodes")) == [] and found(first.read("nodes")) == [("a", "A"), ("b", "B")]
    first.merge("edges", spark.createDataFrame([("a", "b", "X", "e", 1)], "src string, dst string, rel_type string, evidence_text string, seq int"),
                lambda old, new: merge_edges(old, new, ["evidence_text"]))
    assert first.commit() == store.version() == 1
    half = store.begin().upsert("nodes", nodes(spark, ("a", "gone"), ("c", "C")))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        half.merge("edges", spark.range(3).selectExpr("cast(1 / (id - 1) as string) AS src", "'x' AS dst", "'x' AS rel_type", "'' AS evidence_text", "1 AS seq"),
                   lambda old, new: merge_edges(old, new, ["evidence_text"]))
    half.abort()
    assert found(store.read("nodes")) == [("a", "A"), ("b", "B")] and store.read("edges").count() == 1 and store.version() == 1
    kept = {f for table in store.layout().values() for f in table.values()}
    assert {f"data/{t}/{c}" for t in ("nodes", "edges") for c in store.names(f"data/{t}")} == {f.rpartition("/")[0] for f in kept}


def test_only_touched_buckets_are_rewritten(spark, store):
    many = spark.range(400).select(F.concat(F.lit("n"), "id").alias("node_id"), F.lit("old").alias("name"))
    store.begin().upsert("nodes", many).commit()
    before = store.layout()["nodes"]
    assert len(before) == 8
    store.begin().upsert("nodes", nodes(spark, ("n7", "new"))).commit()
    after = store.layout()["nodes"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.read("nodes").where("name = 'new'").count() == 1 and store.read("nodes").count() == 400
    assert store.read("nodes", 1).where("name = 'new'").count() == 0  # earlier versions stay readable


def test_the_second_of_two_changes_to_a_version_is_refused(spark, store):
    one, two = store.begin(), store.begin()
    one.insert("nodes", nodes(spark, ("a", "one"))).commit()
    two.insert("nodes", nodes(spark, ("a", "two"), ("b", "two")))
    with pytest.raises(Conflict):
        two.commit()
    assert found(store.read("nodes")) == [("a", "one")]
    assert store.change(lambda c: c.insert("nodes", nodes(spark, ("a", "two"), ("b", "two")))) == 2
    assert found(store.read("nodes")) == [("a", "one"), ("b", "two")]


def test_a_change_made_again_after_another_sees_its_rows(spark, store):
    raced = []

    def step(change):
        if not raced:
            raced.append(store.begin().insert("nodes", nodes(spark, ("a", "first"))).commit())
        change.insert("nodes", nodes(spark, ("a", "second"), ("b", "second")))

    assert store.change(step) == 2 and raced == [1]
    assert found(store.read("nodes")) == [("a", "first"), ("b", "second")]


def test_deletes_and_empty_changes(spark, store):
    store.begin().upsert("nodes", nodes(spark, ("a", "A"), ("b", None))).commit()
    store.begin().delete("nodes", nodes(spark, ("a", None), ("zz", None))).upsert("edges", spark.createDataFrame([], EDGES)).commit()
    assert found(store.read("nodes")) == [("b", None)] and store.version() == 2
    store.begin().delete("nodes", nodes(spark, ("b", None))).commit()
    assert found(store.read("nodes")) == [] and store.read("nodes").columns == ["node_id", "name"]
