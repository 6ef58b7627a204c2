"""One ingestion run: chunks, extraction, resolution and graph writes, with job states, a ledger of finished units and atomic commits.

Two failure domains, as papers and graph are of use by themselves: first the
chunks, then what the model reads. A paper whose first part fails keeps no chunks;
one whose second part fails keeps them, and its job can run again: sections
the ledger holds are not asked a second time. Graph, job states and the clearing of the
ledger are one commit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.generation import Provider
from citeloom.functions.vectors import embed
from citeloom.operators.build import EDGE_FIELDS, Extracted, extract_batch, graph_changes
from citeloom.operators.chunks import chunk_papers
from citeloom.operators.merge import EDGE_KEY, merge_edges
from citeloom.operators.search import searchable
from citeloom.operators.search_index import INDEX_TABLES, index_texts, unindex
from citeloom.runtime import written
from citeloom.schema import CHUNKS, EDGES, NODES
from citeloom.settings import DEFAULTS
from citeloom.sources.snapshots import BUCKETS, Change, Snapshots, Table

_STR, _INT = T.StringType(), T.IntegerType()
VECTOR = T.ArrayType(T.FloatType())
TABLES = {
    "nodes": Table(NODES, ("node_id",)),
    "edges": Table(EDGES, tuple(EDGE_KEY)),
    "entity_vectors": Table(T.StructType().add("node_id", _STR).add("vector", VECTOR), ("node_id",)),
    "entity_papers": Table(T.StructType().add("node_id", _STR).add("paper_id", _STR), ("node_id", "paper_id")),
    "aliases": Table(T.StructType().add("node_id", _STR).add("alias", _STR), ("node_id", "alias")),
    "chunks": Table(T.StructType([*CHUNKS.fields, T.StructField("vector", VECTOR)]), ("chunk_id",)),
    "jobs": Table(T.StructType().add("paper_id", _STR).add("status", _STR).add("entities_found", _INT).add("relations_found", _INT)
                  .add("error_message", _STR), ("paper_id",)),
    "units": Table(T.StructType().add("paper_id", _STR).add("ord", _INT).add("kind", _STR).add("data", _STR), ("paper_id", "ord", "kind")),
    **INDEX_TABLES,
}


def open_store(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> Snapshots:
    """The tables of a graph under a shared folder."""
    return Snapshots(spark, folder, TABLES, buckets)


@dataclass(frozen=True)
class Ledger:
    """Finished units of work, (paper_id, ord) of a kind, with their rows as text."""

    store: Snapshots

    def resumed(self, kind: str, units: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows (paper_id, ord, ...) of all units; only those not in the ledger are asked, and entered.

        A unit without rows is entered too. Rows that cannot be read back count as
        missing.
        """
        seen = self.store.read("units").filter((F.col("kind") == kind) & F.try_parse_json("data").isNotNull())
        known = written(seen.join(units.select("paper_id", "ord"), ["paper_id", "ord"], "left_semi"), f"known-{kind}")
        open_units = written(units.join(known.select("paper_id", "ord"), ["paper_id", "ord"], "left_anti"), f"open-{kind}")
        fresh = written(ask(open_units), kind)
        fields = [f for f in fresh.schema.fields if f.name not in ("paper_id", "ord")]
        # a unit's rows are those of its replies
        packed = fresh.groupBy("paper_id", "ord").agg(F.to_json(F.collect_list(F.struct(*[f.name for f in fields]))).alias("data"))
        entries = open_units.select("paper_id", "ord").join(packed, ["paper_id", "ord"], "left").select(
            "paper_id", "ord", F.lit(kind).alias("kind"), F.coalesce("data", F.lit("[]")).alias("data"))
        self.store.change(lambda change: change.upsert("units", entries))
        rows = T.ArrayType(T.StructType(fields))
        return fresh.unionByName(known.select("paper_id", "ord", F.inline(F.from_json("data", rows))))


def commit_graph(change: Change, papers: DataFrame, extracted: Extracted, confirm: Callable[[DataFrame], DataFrame] | None = None,
                 dimension: int = DEFAULTS.embedding_dimension) -> Change:
    """Stages a batch's nodes, edges, vectors, provenance, aliases and search index; rewrites only the buckets they fall into."""
    new = graph_changes(papers, extracted, change.read("nodes"), change.read("aliases"), confirm, dimension, change.read("entity_vectors"))
    nodes = written(new.nodes, "batch-nodes")
    return (
        index_texts(change.upsert("nodes", nodes), searchable(nodes))
        .merge("edges", new.writes, lambda old, writes: merge_edges(old, writes, EDGE_FIELDS))
        .upsert("entity_vectors", new.entity_vectors)
        .insert("entity_papers", new.entity_papers)
        .insert("aliases", new.aliases.select(F.col("node_key").alias("node_id"), "alias").distinct())
    )


def _states(papers: DataFrame, status: str, totals: DataFrame | None = None, error: str | None = None) -> DataFrame:
    rows = papers.select("paper_id").distinct()
    if totals is not None:
        rows = rows.join(totals, "paper_id", "left")
    count = [(F.coalesce(x, F.lit(0)) if totals is not None else F.lit(None)).cast("int").alias(x) for x in ("entities_found", "relations_found")]
    return rows.select("paper_id", F.lit(status).alias("status"), *count, F.lit(error).alias("error_message"))


def ingest_batch(
    store: Snapshots, papers: DataFrame, providers: Sequence[Provider], confirm: Callable[[DataFrame], DataFrame] | None = None,
    dimension: int = DEFAULTS.embedding_dimension, pause: float = 2.0, chunk: Callable[[DataFrame], DataFrame] = chunk_papers,
) -> int:
    """Takes papers (paper_id, title, authors, year, venue, abstract, collection_id, sections) into the store; its version then.

    Papers whose job is completed are passed over, so a batch can be given again.
    States are committed as they are reached. Where a part fails, the error is stored with
    the jobs and raised.
    """
    done = store.read("jobs").filter("status = 'completed'").select("paper_id")
    batch = written(papers.dropDuplicates(["paper_id"]).join(done, "paper_id", "left_anti"), "batch")
    if batch.isEmpty():
        return store.version()
    store.change(lambda c: c.upsert("jobs", _states(batch, "chunking")))
    try:
        chunks = chunk(batch).withColumn("vector", embed(F.col("text"), dimension))
        store.change(lambda c: c.upsert("chunks", chunks).upsert("jobs", _states(batch, "extracting_entities")))
    except Exception as error:
        _failed(store, batch, error, keep_chunks=False)
        raise
    try:
        extracted = extract_batch(batch, store.read("nodes"), providers, dimension, pause, Ledger(store))
        store.change(lambda c: c.upsert("jobs", _states(batch, "writing_graph")))

        def finish(change: Change) -> None:
            commit_graph(change, batch, extracted, confirm, dimension)
            change.upsert("jobs", _states(batch, "completed", extracted.totals))
            change.delete("units", change.read("units").join(batch.select("paper_id"), "paper_id", "left_semi"))

        return store.change(finish)
    except Exception as error:
        _failed(store, batch, error, keep_chunks=True)
        raise


def _failed(store: Snapshots, batch: DataFrame, error: Exception, keep_chunks: bool) -> None:
    def step(change: Change) -> None:
        change.upsert("jobs", _states(batch, "failed", error=str(error).strip().split("\n")[0][:500]))
        if not keep_chunks:
            change.delete("chunks", change.read("chunks").join(batch.select("paper_id"), "paper_id", "left_semi"))

    store.change(step)


def delete_papers(store: Snapshots, doomed: DataFrame) -> int:
    """Deletes papers and what only they held, from all tables in one commit: doomed(paper_id)."""
    from citeloom.operators import merge

    def step(change: Change) -> None:
        nodes, edges, chunks, vectors, pairs = (change.read(t) for t in ("nodes", "edges", "chunks", "entity_vectors", "entity_papers"))
        papers = nodes.filter("label = 'Paper'").select("paper_id")
        left = merge.delete_papers(papers, nodes, edges, chunks, vectors, pairs, doomed)
        gone = written(nodes.select("node_id").join(left["nodes"].select("node_id"), "node_id", "left_anti"), "gone")
        ends = edges.select(*EDGE_KEY)
        cut = ends.join(gone.select(F.col("node_id").alias("src")), "src", "left_semi").unionByName(
            ends.join(gone.select(F.col("node_id").alias("dst")), "dst", "left_semi")).distinct()
        (unindex(change, gone).delete("nodes", gone).delete("edges", cut)
         .delete("entity_vectors", gone).delete("aliases", change.read("aliases").join(gone, "node_id", "left_semi"))
         .delete("entity_papers", pairs.join(doomed, "paper_id", "left_semi"))
         .delete("chunks", chunks.join(doomed, "paper_id", "left_semi"))
         .delete("units", change.read("units").join(doomed, "paper_id", "left_semi")).delete("jobs", doomed))

    return store.change(step)
