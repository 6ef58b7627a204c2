"""Graph writes as merges of change rows into stored tables.

Tables are immutable: every operator returns the new table. ``seq`` orders the
changes; it must be total for the result to be deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import claim_key, strip
from citeloom.runtime import written

EDGE_KEY = ["src", "dst", "rel_type"]


def merge_nodes(changes: DataFrame, key: list[str], properties: list[str]) -> DataFrame:
    """Upsert by key, last write wins per property.

    changes(key..., seq, passed array<string>, properties...). A property
    outside ``passed`` keeps its old value; a passed null removes it.
    """
    latest = [
        F.max_by(
            F.struct(F.col(p).alias("v")),
            F.when(F.array_contains("passed", p), F.col("seq")),
        ).getField("v").alias(p)
        for p in properties
    ]
    return changes.groupBy(*key).agg(*latest)


def as_changes(stored: DataFrame, seq: Column, properties: list[str]) -> DataFrame:
    """Stored rows as the earliest changes, ready to be unioned with new ones."""
    return stored.withColumn("seq", seq).withColumn("passed", F.array(*[F.lit(p) for p in properties]))


def first_write(relations: DataFrame, properties: list[str], dealt: bool = False) -> DataFrame:
    """Edges unique on (src, dst, rel_type): first write's properties, number of writes.

    Few writes repeat an edge, so they are dealt before they are grouped: combining
    them in the input tasks would sort and spill all of them for little. ``dealt``
    says that the writes are already dealt by a part of the key.
    """
    gathered = relations if dealt else relations.repartition(*EDGE_KEY)
    return (
        gathered.groupBy(*EDGE_KEY)
        .agg(F.min_by(F.struct(*properties), "seq").alias("first"), F.count("*").alias("occurrence_count"))
        .select(*EDGE_KEY, "first.*", "occurrence_count")
    )


def merge_edges(stored: DataFrame, relations: DataFrame, properties: list[str]) -> DataFrame:
    """New relations into stored edges: stored properties stay, the count grows."""
    old = stored.select(*EDGE_KEY, F.struct(*properties).alias("p"), F.lit(0).alias("age"), "occurrence_count")
    new = first_write(relations, properties).select(
        *EDGE_KEY, F.struct(*properties).alias("p"), F.lit(1).alias("age"), "occurrence_count"
    )
    return (
        old.unionByName(new).groupBy(*EDGE_KEY)
        .agg(F.min_by("p", "age").alias("p"), F.sum("occurrence_count").alias("occurrence_count"))
        .select(*EDGE_KEY, "p.*", "occurrence_count")
    )


def collapse_duplicate_edges(edges: DataFrame, order: list[Column]) -> DataFrame:
    """One edge per (src, dst, rel_type): the highest count stays, plus 1 per removed copy.

    ``order`` breaks ties among equal counts.
    """
    count = F.coalesce("occurrence_count", F.lit(1))
    fields = [c for c in edges.columns if c not in EDGE_KEY]
    kept = edges.groupBy(*EDGE_KEY).agg(
        F.min_by(F.struct(*fields), F.struct((-count).alias("c"), *[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("best"),
        F.count("*").alias("n"),
    )
    grown = F.when(F.col("n") > 1, F.coalesce("best.occurrence_count", F.lit(1)) + F.col("n") - 1).otherwise(
        F.col("best.occurrence_count")
    )
    return kept.select(*EDGE_KEY, *[grown.alias(c) if c == "occurrence_count" else F.col(f"best.{c}") for c in fields])


def duplicate_edge_preview(edges: DataFrame) -> DataFrame:
    """Per relation type: groups with copies and surplus edges, most first."""
    groups = edges.groupBy(*EDGE_KEY).agg(F.count("*").alias("c")).filter(F.col("c") > 1)
    return (
        groups.groupBy("rel_type")
        .agg(F.count("*").alias("duplicate_groups"), F.sum(F.col("c") - 1).alias("extra_edges"))
        .orderBy(F.desc("extra_edges"), "rel_type")
    )


def paper_changes(papers: DataFrame, seq: Column) -> DataFrame:
    """Paper nodes as changes; every property is passed, nulls included."""
    properties = ["title", "authors", "year", "venue", "abstract", "collection_id"]
    return papers.select(
        "paper_id", *properties, F.coalesce(F.nullif("abstract", F.lit("")), "title").alias("embed_text"),
        seq.alias("seq"), F.array(*[F.lit(p) for p in properties]).alias("passed"),
    )


def author_edges(papers: DataFrame) -> DataFrame:
    """AUTHORED_BY writes: one per listed author, by exact trimmed name."""
    return papers.select("paper_id", F.posexplode("authors").alias("pos", "author")).select(
        "paper_id", strip(F.col("author")).alias("author"), F.col("pos").alias("seq")
    )


def claim_nodes(claims: DataFrame, order: Column) -> DataFrame:
    """Claim nodes by content key; text and type of the last write stay."""
    keyed = claims.withColumn("claim_id", claim_key(F.col("paper_id"), F.col("text")))
    last = F.max_by(F.struct("paper_id", "text", "claim_type", "confidence"), order)
    return keyed.groupBy("claim_id").agg(last.alias("last")).select("claim_id", "last.*")


def entity_vector_rows(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vector-store rows of entities and their (node_id, paper_id) provenance.

    mentions(node_id, entity_type, canonical_name, description, vector,
    paper_id, seq). The latest mention supplies the row; provenance is a set,
    kept as rows because a common entity may be named by any share of papers.
    """
    rows = mentions.groupBy("node_id").agg(
        F.max_by(F.struct("entity_type", "canonical_name", "description", "vector"), "seq").alias("last")
    ).select(
        "node_id", "last.entity_type", "last.canonical_name",
        F.when(F.coalesce("last.description", F.lit("")) != "", F.concat_ws(": ", "last.canonical_name", "last.description"))
        .otherwise(F.col("last.canonical_name")).alias("document"),
        "last.vector",
    )
    return rows, mentions.select("node_id", "paper_id").distinct()


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Add or replace whole rows by key; incoming rows win. Incoming keys are unique."""
    return stored.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def insert_new(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet (idempotent append)."""
    return incoming.join(stored.select(*key).distinct(), key, "left_anti")


def delete_by(stored: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return stored.join(keys.select(*key).distinct(), key, "left_anti")


def patch(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set the columns a change row lists in ``sent``; a sent null clears the value."""
    new = changes.select(key, "sent", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = stored.join(new, key, "left")
    for c in columns:
        joined = joined.withColumn(
            c, F.when(F.coalesce(F.array_contains("sent", c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c))
        )
    return joined.drop("sent", *[f"_{c}" for c in columns])


def patch_payload(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Shallow merge of a string-map payload; incoming keys win."""
    joined = stored.join(changes.select(key, F.col("payload").alias("_new")), key, "left")
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce("_new", empty)
    kept = F.map_filter(F.coalesce("payload", empty), lambda k, v: ~F.map_contains_key(new, k))
    return joined.withColumn("payload", F.map_concat(kept, new)).drop("_new")


def remap_graph(nodes: DataFrame, edges: DataFrame, id_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy a graph under new ids: id_map(old_id, new_id)."""
    moved = nodes.join(id_map.withColumnRenamed("old_id", "node_id"), "node_id").drop("node_id").withColumnRenamed(
        "new_id", "node_id"
    )
    pointed = edges
    for end in ("src", "dst"):
        renamed = id_map.select(F.col("old_id").alias(end), F.col("new_id").alias(f"_{end}"))
        pointed = pointed.join(renamed, end).drop(end).withColumnRenamed(f"_{end}", end)
    return moved, pointed


def relabel(stored: DataFrame, titles: DataFrame, collection: Column) -> DataFrame:
    """Set the collection where it is missing and the title is listed."""
    marked = stored.join(titles.select("title").distinct().withColumn("_hit", F.lit(True)), "title", "left")
    return marked.withColumn(
        "collection_id",
        F.when(F.col("collection_id").isNull() & F.col("_hit"), collection).otherwise(F.col("collection_id")),
    ).drop("_hit")


def count_mismatches(source: DataFrame, target: DataFrame, by: str) -> DataFrame:
    """Groups whose row counts differ between two copies."""
    a = source.groupBy(by).agg(F.count("*").alias("source_rows"))
    b = target.groupBy(by).agg(F.count("*").alias("target_rows"))
    return a.join(b, by, "full_outer").na.fill(0, ["source_rows", "target_rows"]).filter(
        F.col("source_rows") != F.col("target_rows")
    )


def row_mismatches(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows present on one side only, tagged with the side, as often as they are missing on the other.

    Both copies are counted with opposite signs in one aggregate.
    """
    signed = source.withColumn("_sign", F.lit(1)).unionByName(target.withColumn("_sign", F.lit(-1)))
    left = signed.groupBy(*source.columns).agg(F.sum("_sign").alias("_left")).filter(F.col("_left") != 0)
    side = F.when(F.col("_left") > 0, "source").otherwise("target").alias("side")
    return left.select(*source.columns, side, F.explode(F.sequence(F.lit(1), F.abs("_left").cast("int"))).alias("_copy")).drop("_copy")


def delete_papers(
    papers: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame,
    entity_vectors: DataFrame, entity_papers: DataFrame, doomed: DataFrame,
) -> dict[str, DataFrame]:
    """Delete papers and what only they held: doomed(paper_id).

    Neighbours that are no papers and keep no edge go as well; survivors lose
    the deleted papers from their provenance; chunks go with their paper.
    """
    gone_papers = written(nodes.filter(F.col("label") == "Paper").join(doomed, "paper_id", "left_semi").select("node_id"), "gone-papers")
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone_papers.select(F.col("node_id").alias(end)), end, "left_anti")
    orphans = orphaned(nodes, edges, gone_papers)
    gone = gone_papers.unionByName(orphans)
    return {
        "papers": papers.join(doomed, "paper_id", "left_anti"),
        "nodes": nodes.join(gone, "node_id", "left_anti"),
        "edges": left,
        "chunks": chunks.join(doomed, "paper_id", "left_anti"),
        "entity_vectors": entity_vectors.join(orphans, "node_id", "left_anti"),
        "entity_papers": entity_papers.join(orphans, "node_id", "left_anti").join(doomed, "paper_id", "left_anti"),
        "orphans": orphans,
    }


def orphaned(nodes: DataFrame, edges: DataFrame, gone_papers: DataFrame) -> DataFrame:
    """Nodes that are no papers and have edges, all of them to gone papers: (node_id).

    An edge is looked at once from each end, and only whether its far end goes is kept, so that what a
    node's edges say is combined before it is shuffled. Papers are hardly ever the second end of an edge:
    those that are come from the distinct ends, and where they are few no edge is shuffled for them.
    """
    pairs = edges.select("src", "dst")
    seconds = pairs.select(F.col("dst").alias("node_id")).distinct()
    met = written(gone_papers.join(seconds, "node_id", "left_semi"), "gone-seconds")

    def seen(near: str, far: str, gone: DataFrame) -> DataFrame:
        marks = gone.select(F.col("node_id").alias(far), F.lit(True).alias("_gone"))
        return pairs.join(marks, far, "left").select(F.col(near).alias("node_id"), F.col("_gone").isNotNull().alias("_gone"))

    lost = (
        seen("dst", "src", gone_papers).unionByName(seen("src", "dst", met))
        .groupBy("node_id").agg(F.bool_and("_gone").alias("_gone")).filter("_gone").select("node_id")
    )
    return written(lost.join(nodes.filter(F.col("label") != "Paper").select("node_id"), "node_id", "left_semi"), "orphans")


def drop_collection(collections: DataFrame, papers: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete collections; their papers stay, without a collection."""
    marks = doomed.select("collection_id").distinct().withColumn("_gone", F.lit(True))
    freed = papers.join(marks, "collection_id", "left").withColumn(
        "collection_id", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("collection_id"))
    ).drop("_gone")
    return collections.join(doomed, "collection_id", "left_anti"), freed


def first_arrivals(uploads: DataFrame, order: Column) -> DataFrame:
    """Adds content_hash and ``duplicate``: every upload but the first of its content.

    The first of each content comes from an aggregate that is combined before
    the shuffle, so a content with most of the copies is no hot group.
    """
    hashed = uploads.withColumn("content_hash", F.sha2(F.col("content"), 256)).withColumn("_order", order)
    first = hashed.groupBy("content_hash").agg(F.min("_order").alias("_first"))
    return hashed.join(first, "content_hash").withColumn("duplicate", F.col("_order") != F.col("_first")).drop("_order", "_first")
