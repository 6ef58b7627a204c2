"""The research-graph view of the given star tables.

Orders are papers (collection = priority), parts are methods, suppliers are
datasets, customers are authors, returned lines are claims. The same rules are
stated as SQL in ``domain_sql`` for the oracle side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import claim_key
from citeloom.functions.vectors import centroids
from citeloom.operators.merge import first_write
from citeloom.runtime import written

DIMENSION = 64
COLLECTIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _node(label: str, node_id, **columns) -> list:
    fields = {"name": "string", "title": "string", "text": "string", "paper_id": "string",
              "source_paper_id": "string", "collection_id": "string", "year": "int", "venue": "string"}
    return [node_id.alias("node_id"), F.lit(label).alias("label")] + [
        columns[f].cast(t).alias(f) if f in columns else F.lit(None).cast(t).alias(f) for f, t in fields.items()
    ]


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def order_papers(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(*_node(
        "Paper", _id("o", "o_orderkey"), title=F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
        paper_id=F.col("o_orderkey"), collection_id=F.col("o_orderpriority"), year=F.year("o_orderdate"),
        venue=F.col("o_orderstatus"),
    ))


def part_methods(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(*_node(
        "Method", _id("p", "p_partkey"), name=F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    ))


def line_confidence():
    return F.round(1 - 5 * F.col("l_discount"), 2)


def line_order():
    """Total write order of the lines of one order."""
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


LINE_COLUMNS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]


def returned_claims(spark, sf) -> DataFrame:
    """(paper_id, claim_id, text, confidence) of returned lines, one row per content key."""
    lines = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    text = F.concat(
        F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" was returned in quantity "),
        F.col("l_quantity").cast("long").cast("string"),
    )
    # a claim belongs to one paper: its lines are dealt by paper as they are read, before texts and keys are made
    dealt = lines.withColumn("paper_id", F.col("l_orderkey").cast("string")).select("paper_id", *LINE_COLUMNS).repartition("paper_id")
    keyed = dealt.select(
        "paper_id", text.alias("text"), line_confidence().alias("confidence"), line_order().alias("seq"),
    ).withColumn("claim_id", claim_key(F.col("paper_id"), F.col("text")))
    return keyed.groupBy("paper_id", "claim_id").agg(
        F.min_by(F.struct("text", "confidence"), "seq").alias("first"), F.count("*").alias("n")
    ).select("claim_id", "paper_id", "first.*", "n")


def nodes(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select(*_node("Dataset", _id("s", "s_suppkey"), name=F.col("s_name")))
    c = table(spark, sf, "customer").select(*_node("Author", _id("c", "c_custkey"), name=F.col("c_name")))
    k = returned_claims(spark, sf).select(*_node(
        "Claim", _id("k", "claim_id"), text=F.col("text"), source_paper_id=F.col("paper_id")
    ))
    return (
        order_papers(spark, sf).unionByName(part_methods(spark, sf)).unionByName(s).unionByName(c).unionByName(k)
    )


def raw_relations(spark, sf) -> DataFrame:
    """One row per write: (src, dst, rel_type, seq, confidence, evidence_text, metric, value), dealt by src.

    The lines are dealt as they are read; a line becomes its two writes behind that.
    """
    li = table(spark, sf, "lineitem").select(_id("o", "l_orderkey").alias("src"), *LINE_COLUMNS).repartition("src")
    evidence = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))
    none = F.lit(None).cast("string")

    def write(dst, rel_type: str, metric, value):
        return F.struct(
            dst.alias("dst"), F.lit(rel_type).alias("rel_type"), line_order().alias("seq"), line_confidence().alias("confidence"),
            evidence.alias("evidence_text"), metric.alias("metric"), value.alias("value"))

    uses = write(_id("p", "l_partkey"), "USES_METHOD", none, none)
    evaluates = write(_id("s", "l_suppkey"), "EVALUATES_ON", F.lit("quantity"), F.col("l_quantity").cast("long").cast("string"))
    return li.select("src", F.inline(F.array(uses, evaluates)))


def edges(spark, sf) -> DataFrame:
    written = first_write(raw_relations(spark, sf), ["confidence", "evidence_text", "metric", "value"], dealt=True)
    none = F.lit(None).cast("string")
    one = F.lit(1).cast("long")
    authored = table(spark, sf, "orders").select(
        _id("o", "o_orderkey").alias("src"), _id("c", "o_custkey").alias("dst"), F.lit("AUTHORED_BY").alias("rel_type"),
        F.lit(None).cast("double").alias("confidence"), none.alias("evidence_text"), none.alias("metric"),
        none.alias("value"), one.alias("occurrence_count"),
    )
    introduces = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("o")).select(
        _id("o", "o").alias("src"), _id("p", "l_partkey").alias("dst"), F.lit("INTRODUCES").alias("rel_type"),
        F.lit(0.95).alias("confidence"), none.alias("evidence_text"), none.alias("metric"), none.alias("value"),
        one.alias("occurrence_count"),
    )
    reports = returned_claims(spark, sf).select(
        _id("o", "paper_id").alias("src"), _id("k", "claim_id").alias("dst"), F.lit("REPORTS_RESULT").alias("rel_type"),
        "confidence", F.col("text").alias("evidence_text"), none.alias("metric"), none.alias("value"),
        F.col("n").alias("occurrence_count"),
    )
    return (
        written.unionByName(authored).unionByName(introduces).unionByName(reports)
        .withColumn("dataset", none).withColumn("margin", none)
    )


def entity_vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(_id("p", "vec_id").alias("node_id"), F.col("embedding").alias("vector"))


def chunk_vectors(spark, sf) -> DataFrame:
    """Vectors as chunks: text from the document, paper and collection from the order of the same number."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("vec_id"), "o_orderpriority")
    return e.join(d, "vec_id").join(o, "vec_id").select(
        F.col("vec_id").alias("chunk_id"), "vector", F.col("vec_id").cast("string").alias("paper_id"),
        F.col("o_orderpriority").alias("collection_id"), F.col("lang").alias("section_name"), "text",
        F.lit(None).cast("int").alias("page_number"),
    )


def entity_papers(spark, sf) -> DataFrame:
    """Which papers mention a method, one row per pair."""
    # keys are told apart as numbers, ids are made of what is left
    return table(spark, sf, "lineitem").select("l_partkey", "l_orderkey").distinct().select(
        _id("p", "l_partkey").alias("node_id"), F.col("l_orderkey").cast("string").alias("paper_id")
    )


def questions(spark, sf, scoped: bool = False) -> DataFrame:
    """One question per vector label: the label's centroid; scoped ones name a collection."""
    rows = centroids(table(spark, sf, "embeddings"), "label", "embedding", "vector").select(
        F.col("label").cast("long").alias("query_id"), "vector"
    )
    names = F.array(*[F.lit(x) for x in COLLECTIONS])
    scope = F.get(names, F.pmod(F.col("query_id"), F.lit(5)).cast("int")) if scoped else F.lit(None).cast("string")
    return rows.withColumn("collection_id", scope)


class Stored:
    """The built graph and vector tables as a ``Corpus``, each stored when it is first read."""

    dimension, links = DIMENSION, None

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    @cached_property
    def nodes(self) -> DataFrame:
        return written(nodes(self.spark, self.sf), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return written(edges(self.spark, self.sf), "edges")

    @cached_property
    def entity_vectors(self) -> DataFrame:
        return entity_vectors(self.spark, self.sf)

    @cached_property
    def entity_papers(self) -> DataFrame:
        return written(entity_papers(self.spark, self.sf), "entity-papers")

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        return written(chunk_vectors(self.spark, self.sf), "chunks")

    @cached_property
    def papers(self) -> DataFrame:
        return order_papers(self.spark, self.sf).select("paper_id", "title")


_STORED: dict[tuple[str, str], Stored] = {}


def corpus(spark, sf) -> Stored:
    """The stored graph of a session and input folder."""
    return _STORED.setdefault((spark.sparkContext.applicationId, sf), Stored(spark, sf))
