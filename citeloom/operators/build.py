"""Graph building for a batch of papers: extract, clean, resolve, link, merge.

Papers enter as rows (paper_id, title, authors, year, venue, abstract,
collection_id, sections). Stages whose results are used more than once, and all
generation results, are written, so a repeated job pays for no second call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.generation import Provider
from citeloom.functions.text import claim_key, norm_name, strip
from citeloom.functions.vectors import embed
from citeloom.operators import extract as ex
from citeloom.operators.link import linked_relations, name_index
from citeloom.operators.merge import first_write, insert_new, merge_edges, upsert
from citeloom.operators.resolve import alias_rows, merged_entities, resolve
from citeloom.runtime import written
from citeloom.schema import NODES
from citeloom.settings import DEFAULTS

if TYPE_CHECKING:
    from citeloom.operators.ingest import Ledger

EDGE_FIELDS = ["confidence", "evidence_text", "metric", "value", "dataset", "margin"]


@dataclass(frozen=True)
class Extracted:
    sections: DataFrame
    entities: DataFrame   # methods, datasets, metrics and surviving claims
    relations: DataFrame
    totals: DataFrame     # paper_id, entities_found, relations_found


def paper_node(paper_id="paper_id"):
    return F.concat(F.lit("paper:"), F.col(paper_id))


def _entity_type():
    return F.when(F.col("kind") == "method", "Method").otherwise("Dataset")


def extract_batch(
    papers: DataFrame, stored_nodes: DataFrame, providers: Sequence[Provider],
    dimension: int = DEFAULTS.embedding_dimension, pause: float = 2.0, ledger: Ledger | None = None,
) -> Extracted:
    """Everything the model reads out of a batch; also the dry run, as nothing is merged.

    With a ledger, sections it holds are not asked again.
    """
    def asked(kind: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return written(ask(sections), kind) if ledger is None else ledger.resumed(kind, sections, ask)

    sections = written(ex.content_sections(papers), "sections")
    found = asked("entities", lambda part: ex.extract_entities(part, providers, pause))
    cleaned = ex.drop_title_and_trivial_claims(found, papers).withColumn("seq", F.struct("ord", "pos"))
    claims = cleaned.filter("kind = 'claim'")
    kept = ex.dedupe_claims(
        claims.select("paper_id", F.format_string("%08d:%08d", "ord", "pos").alias("seq"), F.col("name").alias("text"),
                      embed(F.col("name"), dimension).alias("vector"))
    )
    claims = claims.withColumn("k", F.format_string("%08d:%08d", "ord", "pos")).join(
        kept.select("paper_id", F.col("seq").alias("k")), ["paper_id", "k"], "left_semi").drop("k")
    entities = written(cleaned.filter("kind <> 'claim'").unionByName(claims).drop("seq"), "entities")

    own = entities.filter(F.col("kind").isin("method", "dataset"))
    names = own.groupBy("paper_id", "ord").agg(F.array_sort(F.collect_set("name")).alias("names"))
    existing = stored_nodes.filter(F.col("label").isin("Method", "Dataset")).select(
        "node_id", "name", F.col("label").alias("entity_type"))
    named = own.select("paper_id", "name").unionByName(papers.select("paper_id", F.lit(None).cast("string").alias("name")))
    offered = written(ex.foreign_candidates(existing, named), "offered")
    within = asked("within", lambda part: ex.extract_relations(part, names, providers, pause=pause))
    across = asked("across", lambda part: ex.extract_relations(part, names, providers, across=True, candidates=offered, pause=pause))
    relations = written(
        within.withColumn("pass", F.lit(0)).unionByName(ex.known_targets(across, offered).withColumn("pass", F.lit(1))), "relations"
    )
    return Extracted(sections, entities, relations, ex.entity_totals(entities, relations))


def _nodes(df: DataFrame, label: str, node_id, **columns) -> DataFrame:
    """Rows of the node table; columns not given are null."""
    given = {"node_id": node_id, "label": F.lit(label), **columns}
    return df.select(*[
        (given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES.fields
    ])


@dataclass(frozen=True)
class GraphChanges:
    """What a batch adds to a graph; every table but ``writes`` has unique keys."""

    nodes: DataFrame           # schema.NODES, with what stored nodes keep
    writes: DataFrame          # relations in order of ``seq``, repeats included
    entity_vectors: DataFrame  # node_id, vector
    entity_papers: DataFrame   # node_id, paper_id
    aliases: DataFrame         # node_key, alias


def graph_changes(
    papers: DataFrame, extracted: Extracted, stored_nodes: DataFrame, stored_aliases: DataFrame | None = None,
    confirm: Callable[[DataFrame], DataFrame] | None = None, dimension: int = DEFAULTS.embedding_dimension,
    stored_vectors: DataFrame | None = None,
) -> GraphChanges:
    """Resolves a batch against the stored entities and states what it writes.

    stored_nodes (schema.NODES), stored_aliases(node_id, alias), stored_vectors(node_id,
    vector): with them, descriptions count in entity resolution. Entity ids are stable:
    a shorter spelling renames the stored node instead of adding a second one. A longer
    description and the last category or domain given replace what is stored.
    """
    own = extracted.entities.filter(F.col("kind").isin("method", "dataset")).select(
        "paper_id", "name", "description", "category", "confidence", _entity_type().alias("entity_type"),
        F.format_string("%s|%08d|%d|%08d", "paper_id", "ord", F.when(F.col("kind") == "method", 0).otherwise(1), "pos").alias("seq"),
        norm_name(F.col("name")).alias("norm"),
    )
    known = stored_nodes.filter(F.col("label").isin("Method", "Dataset")).select(
        "node_id", F.col("label").alias("entity_type"), "name", F.lit(False).alias("is_alias"))
    if stored_aliases is not None:
        known = known.unionByName(stored_aliases.join(known.select("node_id", "entity_type"), "node_id").select(
            "node_id", "entity_type", F.col("alias").alias("name"), F.lit(True).alias("is_alias")))
    mention_vectors, primary = None, known.filter(~F.col("is_alias"))
    if stored_vectors is not None:
        known = known.join(stored_vectors.select("node_id", "vector"), "node_id", "left")
        told = own.filter(F.coalesce("description", F.lit("")) != "").groupBy("entity_type", "norm").agg(
            F.max_by("description", F.struct(F.length("description"), "seq")).alias("description"))
        mention_vectors = written(told.select("entity_type", "norm", embed(F.col("description"), dimension).alias("vector")), "mention-vectors")
    resolved = written(resolve(own.select("name", "entity_type", "seq"), known, confirm, mention_vectors, dimension), "resolved")
    canonical = written(merged_entities(resolved, primary), "canonical")
    placed = written(
        own.join(resolved.select("entity_type", "norm", F.col("node_key").alias("node_id")), ["entity_type", "norm"]), "placed"
    )

    c = F.col
    given = F.coalesce("category", F.lit("")) != ""
    described = placed.groupBy("node_id").agg(
        F.first("entity_type").alias("label"),
        F.max_by("description", F.struct(F.length("description"), "seq")).alias("description"),
        F.max_by("category", F.when(given, c("seq"))).alias("sort"), F.max("confidence").alias("confidence"),
    ).join(canonical.select(c("node_key").alias("node_id"), "name"), "node_id").join(
        stored_nodes.select("node_id", *[c(x).alias(f"old_{x}") for x in ("description", "category", "domain", "confidence")]), "node_id", "left")
    longer = F.length("description") > F.length(F.coalesce("old_description", F.lit("")))
    described = written(described.select(
        "node_id", "label", "name", F.nullif(F.when(longer, c("description")).otherwise(c("old_description")), F.lit("")).alias("description"),
        F.when(c("label") == "Method", F.coalesce("sort", "old_category")).alias("category"),
        F.when(c("label") == "Dataset", F.coalesce("sort", "old_domain")).alias("domain"),
        F.greatest("confidence", "old_confidence").alias("confidence")), "described")
    claims = extracted.entities.filter("kind = 'claim'").withColumn("claim_id", claim_key(c("paper_id"), c("name")))
    claims = claims.groupBy("claim_id").agg(
        F.max_by(F.struct("paper_id", "name", "claim_type", "confidence"), F.struct("ord", "pos")).alias("c")).select("claim_id", "c.*")
    authors = papers.select("paper_id", F.posexplode(F.coalesce("authors", F.array().cast("array<string>"))).alias("pos", "author")).select(
        "paper_id", "pos", strip(c("author")).alias("author"))
    claim_node = F.concat(F.lit("claim:"), "claim_id")
    new_nodes = (
        _nodes(papers, "Paper", paper_node(), title=c("title"), paper_id=c("paper_id"), collection_id=c("collection_id"),
               year=c("year"), venue=c("venue"), abstract=c("abstract"))
        .unionByName(_nodes(authors.select("author").distinct(), "Author", F.concat(F.lit("author:"), "author"), name=c("author")))
        .unionByName(_nodes(claims, "Claim", claim_node, text=c("name"), source_paper_id=c("paper_id"), claim_type=c("claim_type"), confidence=c("confidence")))
        .unionByName(described.select(*[
            (c(f.name) if f.name in described.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES.fields]))
    )

    stored_index = name_index(known.select("name", "node_id", c("entity_type").alias("label"), c("node_id").alias("seq")), [])
    spellings = placed.select("paper_id", "name", "node_id", c("entity_type").alias("label"), "seq").unionByName(
        placed.join(canonical.select(c("node_key").alias("node_id"), c("name").alias("short")), "node_id").select(
            "paper_id", c("short").alias("name"), "node_id", c("entity_type").alias("label"), "seq"))
    linked = linked_relations(extracted.relations, stored_index, name_index(spellings, ["paper_id"]), paper_node())

    def extra(key: str):
        return F.try_element_at("properties", F.lit(key)).alias(key)

    none = F.lit(None).cast("string")
    order = F.format_string("%s|%08d|%d|%08d", "paper_id", "ord", "pass", "pos").alias("seq")
    writes = (
        linked.select("src", "dst", c("relation_type").alias("rel_type"), order, "confidence", "evidence_text",
                      *[extra(k) for k in EDGE_FIELDS[2:]])
        .unionByName(claims.select(
            paper_node().alias("src"), claim_node.alias("dst"), F.lit("REPORTS_RESULT").alias("rel_type"),
            c("claim_id").alias("seq"), "confidence", c("name").alias("evidence_text"), *[none.alias(k) for k in EDGE_FIELDS[2:]]))
        .unionByName(authors.select(
            paper_node().alias("src"), F.concat(F.lit("author:"), "author").alias("dst"), F.lit("AUTHORED_BY").alias("rel_type"),
            F.format_string("%08d", "pos").alias("seq"), F.lit(None).cast("double").alias("confidence"), none.alias("evidence_text"),
            *[none.alias(k) for k in EDGE_FIELDS[2:]]))
    )
    # papers are found by their abstract, or their title where they have none
    told = F.coalesce(F.nullif("abstract", F.lit("")), c("title"))
    vectors = (
        described.select("node_id", embed(F.coalesce("description", "name"), dimension).alias("vector"))
        .unionByName(claims.select(claim_node.alias("node_id"), embed(c("name"), dimension).alias("vector")))
        .unionByName(papers.filter(told.isNotNull()).select(paper_node().alias("node_id"), embed(told, dimension).alias("vector")))
    )
    provenance = placed.select("node_id", "paper_id").unionByName(claims.select(claim_node.alias("node_id"), "paper_id")).distinct()
    return GraphChanges(new_nodes, writes, vectors, provenance, alias_rows(resolved, primary, canonical))


def build_graph(
    papers: DataFrame, extracted: Extracted, stored_nodes: DataFrame, stored_edges: DataFrame,
    stored_aliases: DataFrame | None = None, confirm: Callable[[DataFrame], DataFrame] | None = None,
    dimension: int = DEFAULTS.embedding_dimension, stored_vectors: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Whole nodes and edges after merging the batch, and the batch's entity_vectors, entity_papers, aliases and totals.

    stored_edges (src, dst, rel_type, EDGE_FIELDS, occurrence_count); the rest as in
    ``graph_changes``. For stored tables of any size see ``ingest.commit_graph``,
    which rewrites only what the batch touches.
    """
    new = graph_changes(papers, extracted, stored_nodes, stored_aliases, confirm, dimension, stored_vectors)
    return {
        "nodes": upsert(stored_nodes, new.nodes, ["node_id"]),
        "edges": merge_edges(stored_edges, new.writes, EDGE_FIELDS),
        "entity_vectors": new.entity_vectors,
        "entity_papers": new.entity_papers,
        "aliases": new.aliases,
        "relations_written": first_write(new.writes.filter("rel_type <> 'AUTHORED_BY'"), EDGE_FIELDS),
        "totals": extracted.totals,
    }


def add_chunks(stored: DataFrame, chunks: DataFrame, dimension: int = DEFAULTS.embedding_dimension) -> DataFrame:
    """Chunks with vectors of papers that have none stored yet."""
    fresh = insert_new(stored, chunks, ["paper_id"])
    return fresh.withColumn("vector", embed(F.col("text"), dimension))


def drop_chunks_of(chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """Remove the chunks of papers whose first stages failed: failed(paper_id)."""
    return chunks.join(failed.select("paper_id"), "paper_id", "left_anti")
