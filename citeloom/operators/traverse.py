"""Bounded neighbourhood retrieval for a batch of queries.

Edges are (src, dst, rel_type, confidence, ...), unique on the first three.
Seeds are (query_id, node_id). Every step is a join or a window on the whole
batch; nothing is looped per query.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import BROADCAST_ROWS, row_numbers, top_k_per_group, written
from citeloom.settings import RELATION_TYPES, effective_hops

EDGE_KEY = ["src", "dst", "rel_type"]
AHEAD = 8  # times a row limit: so many of the best edges are tried before all are met


def by_confidence() -> list:
    return [F.desc("conf"), F.col("src"), F.col("dst"), F.col("rel_type")]


def of_types(edges: DataFrame, rel_types: list[str] | None) -> DataFrame:
    """Keep the requested relation types that exist; none left means no edges."""
    if rel_types is None:
        return edges
    valid = sorted(set(rel_types) & set(RELATION_TYPES))
    return edges.filter(F.col("rel_type").isin(valid)) if valid else edges.filter(F.lit(False))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node_id, other) for both directions of every edge, from one scan."""
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other")),
                F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other")),
            )
        )
    )


def two_way(edges: DataFrame) -> DataFrame:
    """(node_id, other, outgoing, rel_type, conf): every edge under each of its ends, a loop once."""
    conf = F.coalesce("confidence", F.lit(0.0)).alias("conf")
    views = F.filter(
        F.array(
            F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other"), F.lit(True).alias("outgoing")),
            F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other"), F.lit(False).alias("outgoing")),
        ),
        lambda v: v["outgoing"] | (v["node_id"] != v["other"]),
    )
    return edges.select(F.inline(views), "rel_type", conf)


def store_two_way(edges: DataFrame, table: str, folder: str, buckets: int = 256) -> DataFrame:
    """Stores the edges under both ends as a table bucketed by node; ``traverse`` then shuffles no edge.

    The number of buckets is that of the tasks of a hop. An existing table is replaced.
    A bucket is written by as many tasks as the session has partitions for it, a file each.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = two_way(edges).repartition(buckets * max(1, parts // buckets), "node_id")
    rows.write.mode("overwrite").bucketBy(buckets, "node_id").sortBy("node_id").option("path", folder).saveAsTable(table)
    return edges.sparkSession.table(table)


def frontier(links: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """All (query_id, node_id) within ``steps`` undirected hops of a seed, over links(node_id, other).

    A hop joins only what the last one newly reached. Every part is written, so
    that the next join over the edges knows its size: small ones are broadcast
    and the edges are only scanned, large ones are shuffled with skewed keys
    split at run time.
    """
    reached = seeds.select("query_id", "node_id").distinct()
    if steps <= 0:
        return reached
    reached = fresh = written(reached, "frontier")
    for _ in range(steps):
        nearby = fresh.join(links.select("node_id", "other"), "node_id").select("query_id", F.col("other").alias("node_id")).distinct()
        fresh = written(nearby.join(reached, ["query_id", "node_id"], "left_anti"), "frontier")
        reached = reached.unionByName(fresh)
    return reached


def incident(links: DataFrame, reached: DataFrame) -> DataFrame:
    """(query_id, edge) for edges with an end in the reached set; twice if both ends are."""
    src, dst = F.when(F.col("outgoing"), F.col("node_id")).otherwise(F.col("other")), F.when(F.col("outgoing"), F.col("other")).otherwise(F.col("node_id"))
    return links.join(reached, "node_id").select("query_id", src.alias("src"), dst.alias("dst"), "rel_type", "conf")


def traverse(
    edges: DataFrame, seeds: DataFrame, hops: int | None = None,
    rel_types: list[str] | None = None, row_limit: int | None = None, salts: int = 16, links: DataFrame | None = None,
) -> DataFrame:
    """The edges on any trail of up to ``hops`` steps from a seed, best confidence first.

    An edge lies on such a trail exactly if one of its ends is within hops-1
    steps of a seed, so frontier joins suffice. Result: (query_id, src, dst,
    rel_type, conf, ord), all rows or, if the request names a ``row_limit``, at most
    that many per query; an edge is met at most twice, so twice the limit is kept
    until duplicates are gone. ``links`` are the edges as ``store_two_way`` keeps them.
    """
    allowed = of_types(two_way(edges) if links is None else links, rel_types)
    steps = effective_hops(hops) - 1
    if row_limit is None:
        reached = frontier(allowed, seeds, steps)
        return written(row_numbers(incident(allowed, reached).distinct(), ["query_id"], by_confidence(), "ord"), "traversed")
    found, left = best_first(allowed, seeds, steps, row_limit, salts)
    if left is None:
        return found
    rest = _first_rows(incident(allowed, frontier(allowed, left, steps)), row_limit, salts)
    return written(rest if found is None else found.unionByName(rest), "traversed")


def _first_rows(met: DataFrame, row_limit: int, salts: int) -> DataFrame:
    """The best ``row_limit`` edges of every query, numbered in ``ord``; an edge may be met twice."""
    cut = top_k_per_group(best_of_tasks(met, 2 * row_limit), ["query_id"], by_confidence(), 2 * row_limit, "_met", salts).drop("_met")
    return top_k_per_group(cut.distinct(), ["query_id"], by_confidence(), row_limit, "ord")


def best_first(links: DataFrame, seeds: DataFrame, steps: int, row_limit: int, salts: int = 16) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of queries that meet a limit among the best edges of all, and the seeds of the other queries.

    Queries that reach much of the graph meet most edges, so the best ones fill their
    limit. Which queries meet them is looked up from their ends: the last step is walked
    backwards from these alone, and no other edge is shuffled. A query that meets fewer of
    them is left, as all are where few nodes are reached.
    """
    reached = frontier(links, seeds, max(0, steps - 1))
    reached = written(reached, "frontier") if steps <= 1 else reached
    if reached.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return None, seeds
    # an edge without a source is under none of its ends
    once = links.filter(F.col("outgoing") & F.col("node_id").isNotNull()).select(
        F.col("node_id").alias("src"), F.col("other").alias("dst"), "rel_type", "conf")
    best = written(once.orderBy(*by_confidence()).limit(AHEAD * row_limit), "best-edges")
    ends = written(best.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "ends")
    near = reached.join(ends, "node_id", "left_semi").select("query_id", "node_id")
    if steps:
        last = links.join(ends, "node_id", "left_semi").select("node_id", "other")
        near = near.unionByName(last.join(reached.withColumnRenamed("node_id", "other"), "other").select("query_id", "node_id"))
    near = written(near.distinct(), "near")
    met = [best.join(near.withColumnRenamed("node_id", end), end).select("query_id", *EDGE_KEY, "conf") for end in ("src", "dst")]
    found = written(_first_rows(met[0].unionByName(met[1]), row_limit, salts), "traversed")
    if best.count() < AHEAD * row_limit:
        return found, None  # these were all edges
    full = found.filter(F.col("ord") == row_limit).select("query_id")
    left = seeds.join(full, "query_id", "left_anti")
    return (found, None) if left.isEmpty() else (found.join(full, "query_id", "left_semi"), left)


def best_of_tasks(met: DataFrame, k: int) -> DataFrame:
    """The rows of met(query_id, src, dst, rel_type, conf) without those that ``k`` rows of their task and query precede.

    Whatever the session's settings are, a limit then shuffles at most k rows per task and query.
    """
    return met.mapInArrow(_best_rows(k), met.schema)


def _best_rows(k: int):
    keys = [("query_id", "ascending"), ("conf", "descending")] + [(c, "ascending") for c in EDGE_KEY]

    def best(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
        """The first k rows of every query, and the last of those where there are k."""
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys))
        query = rows["query_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        return rows.filter(pa.array(place < k)), rows.filter(pa.array(place == k - 1))

    def ahead(rows: pa.Table, last: pa.Table) -> pa.Table:
        """Rows that no k known ones of their query precede, as far as confidence and source tell."""
        at = pc.index_in(rows["query_id"], value_set=last["query_id"].combine_chunks())
        conf, src = pc.take(last["conf"], at), pc.take(last["src"], at)
        better = pc.or_(pc.greater(rows["conf"], conf), pc.and_(pc.equal(rows["conf"], conf), pc.less_equal(rows["src"], src)))
        return rows.filter(pc.fill_null(better, True))

    def cut(batches):
        kept, last, waiting, n = None, None, [], 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            odd = pc.is_nan(rows["conf"])
            if pc.any(odd).as_py():  # sorts before all numbers in Spark
                yield from rows.filter(odd).to_batches()
                rows = rows.filter(pc.invert(odd))
            rows = rows if last is None or not len(last) else ahead(rows, last)
            waiting, n = waiting + [rows], n + len(rows)
            if n >= 50_000 + (0 if kept is None else len(kept)):
                kept, last = best(pa.concat_tables(waiting if kept is None else [kept, *waiting]))
                waiting, n = [], 0
        if n or kept is not None:
            rows = pa.concat_tables(waiting if kept is None else [kept, *waiting])
            yield from (best(rows)[0] if len(rows) else rows).to_batches()

    return cut


def subgraph_nodes(edges: DataFrame) -> DataFrame:
    """Ends of the edges with their first-seen order: (query_id, node_id, node_ord)."""
    seen = edges.select(
        "query_id",
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node_id"), (2 * F.col("ord")).alias("node_ord")),
                F.struct(F.col("dst").alias("node_id"), (2 * F.col("ord") + 1).alias("node_ord")),
            )
        ),
    )
    return seen.groupBy("query_id", "node_id").agg(F.min("node_ord").alias("node_ord"))


def filter_entity_types(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, entity_types: list[str]) -> DataFrame:
    """Drop edges with an end that is neither a seed nor of a requested label."""
    marks = (
        subgraph_nodes(edges)
        .join(nodes.select("node_id", "label"), "node_id", "left")
        .join(seeds.select("query_id", "node_id").distinct().withColumn("seed", F.lit(True)),
              ["query_id", "node_id"], "left")
        .filter(F.coalesce("seed", F.lit(False)) | F.col("label").isin(entity_types))
        .select("query_id", "node_id")
    )
    return keep_between(edges, marks)


def keep_between(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges with both ends among the marked (query_id, node_id)."""
    for end in ("src", "dst"):
        edges = edges.join(
            marks.select("query_id", F.col("node_id").alias(end)), ["query_id", end], "left_semi"
        )
    return edges


def scope_to_collection(
    edges: DataFrame, nodes: DataFrame, queries: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Keep what belongs to each query's collection: (edges, nodes of the subgraph).

    queries(query_id, collection_id); a null collection leaves a query alone.
    Papers of another or no collection go, and claims whose paper is not an
    in-collection paper of this subgraph; then their edges; then, only where
    something was dropped, non-papers left without an edge.
    """
    seen = written(subgraph_nodes(edges), "subgraph-nodes")
    # nodes that are not seen go first: where few are seen, as under a row limit, the stored nodes are only scanned
    described = nodes.select("node_id", "label", "collection_id", "paper_id", "source_paper_id").join(seen.select("node_id"), "node_id", "left_semi")
    facts = (
        seen.join(described, "node_id", "left")
        .join(queries.select("query_id", F.col("collection_id").alias("wanted")), "query_id")
    )
    in_scope = F.coalesce(F.col("collection_id") == F.col("wanted"), F.lit(False))
    kept_papers = facts.filter((F.col("label") == "Paper") & in_scope).select(
        "query_id", F.col("paper_id").alias("source_paper_id"), F.lit(True).alias("paper_kept")
    ).distinct()
    judged = facts.join(kept_papers, ["query_id", "source_paper_id"], "left").withColumn(
        "drop",
        F.col("wanted").isNotNull()
        & (
            ((F.col("label") == "Paper") & ~in_scope)
            | ((F.col("label") == "Claim") & F.coalesce(~F.col("paper_kept"), F.lit(True)))
        ),
    )
    judged = written(judged.select("query_id", "node_id", "node_ord", "label", "drop"), "judged")
    pruned = judged.filter("drop").select("query_id").distinct().withColumn("pruning", F.lit(True))
    flagged = judged.filter(~F.col("drop"))
    kept_edges = written(keep_between(edges, flagged.select("query_id", "node_id")), "scoped-edges")
    touched = subgraph_nodes(kept_edges).select("query_id", "node_id", F.lit(True).alias("touched"))
    kept_nodes = (
        flagged.join(touched, ["query_id", "node_id"], "left").join(pruned, "query_id", "left")
        .filter(F.col("pruning").isNull() | F.col("touched") | (F.col("label") == "Paper"))
        .select("query_id", "node_id", "node_ord")
    )
    return kept_edges, kept_nodes


def cap_nodes(
    edges: DataFrame, nodes: DataFrame, max_nodes: int | None = None
) -> DataFrame:
    """Nodes within the greedy node budget: take edges best first while their new ends still fit; all without a budget.

    Until the budget overflows, every edge is admitted, so the admitted nodes
    are a prefix of the first-seen order in which whole edges fit. If one place
    is then left, the next edge that needs exactly one new node takes it. Hence
    windows over the (row-limited) edges, no sequential pass.
    """
    if max_nodes is None:
        return nodes.select("query_id", "node_id", "node_ord")
    per_query = nodes.groupBy("query_id").agg((F.count("*") > max_nodes).alias("over"))
    large = per_query.filter("over").select("query_id")
    small = nodes.join(large, "query_id", "left_anti").select("query_id", "node_id", "node_ord")

    # an edge is a prefix's last only if its nodes are among the first ones, so no later node is placed
    seen = subgraph_nodes(edges.join(large, "query_id", "left_semi"))
    places = (
        top_k_per_group(seen, ["query_id"], [F.col("node_ord")], max_nodes + 1, "place")
        .withColumn("edge_ord", F.floor(F.col("node_ord") / 2))
        .withColumn("needs", F.max("place").over(Window.partitionBy("query_id", "edge_ord")))
    )
    prefix = places.filter(F.col("needs") <= max_nodes)
    counts = prefix.groupBy("query_id").agg(F.count("*").alias("n"))
    one_left = large.join(counts, "query_id", "left").filter(
        F.coalesce("n", F.lit(0)) == max_nodes - 1
    ).select("query_id")
    inside = prefix.select("query_id", "node_id", F.lit(True).alias("inside"))
    open_edges = (
        edges.join(one_left, "query_id", "left_semi")
        .join(inside.select("query_id", F.col("node_id").alias("src"), F.col("inside").alias("s_in")),
              ["query_id", "src"], "left")
        .join(inside.select("query_id", F.col("node_id").alias("dst"), F.col("inside").alias("d_in")),
              ["query_id", "dst"], "left")
    )
    fits = (
        (F.col("s_in").isNull() != F.col("d_in").isNull())
        | (F.col("s_in").isNull() & (F.col("src") == F.col("dst")))
    )
    last = (
        open_edges.filter(fits)
        .select("query_id", "ord", F.when(F.col("s_in").isNull(), F.col("src")).otherwise(F.col("dst")).alias("node_id"))
        .groupBy("query_id").agg(F.min_by("node_id", "ord").alias("node_id"), F.min("ord").alias("ord"))
        .select("query_id", "node_id", (2 * F.col("ord")).alias("node_ord"))
    )
    kept_nodes = small.unionByName(prefix.select("query_id", "node_id", "node_ord")).unionByName(last)
    # an edge passed over never gets both ends in, so the kept edges are the induced ones
    return kept_nodes


def _distances(ends: pa.Table) -> pa.Table:
    src, dst = ends.column("src").to_pylist(), ends.column("dst").to_pylist()
    near: dict = {}
    for a, b in zip(src, dst):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seeds = [a for a, s in zip(src, ends.column("src_seed").to_pylist()) if s]
    seeds += [b for b, s in zip(dst, ends.column("dst_seed").to_pylist()) if s]
    found = dict.fromkeys(seeds, 0)
    queue = deque(found)
    while queue:
        node = queue.popleft()
        for other in near[node]:
            if other not in found:
                found[other] = found[node] + 1
                queue.append(other)
    query = ends.column("query_id")
    return pa.table({
        "query_id": pa.array([query[0].as_py()] * len(found), query.type),
        "node_id": pa.array(list(found), ends.schema.field("src").type),
        "distance": pa.array(list(found.values()), pa.int32()),
    })


def _distance_joins(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    ends = (("src", "dst"), ("dst", "src"))
    links = written(edges.select("query_id", F.inline(F.array(*[F.struct(F.col(a).alias("node_id"), F.col(b).alias("other")) for a, b in ends]))), "links")
    known = links.select("query_id", "node_id").distinct().join(seeds.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_semi")
    last = found = written(known.withColumn("distance", F.lit(0)), "distances")
    while not last.isEmpty():
        near = last.join(links, ["query_id", "node_id"]).select("query_id", F.col("other").alias("node_id"), (F.col("distance") + 1).alias("distance")).distinct()
        last = written(near.join(found.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti"), "distances")
        found = found.unionByName(last)
    return found


def seed_distances(edges: DataFrame, seeds: DataFrame, limited: bool = False) -> DataFrame:
    """Undirected hops from the nearest seed inside each query's subgraph.

    Distances grow by joins, one written step per hop, until nothing new is met.
    ``limited`` says that a request's row limit bounds every query's edges: they
    are then walked in one grouped step, as distances after a cap may exceed any
    fixed hop count.
    """
    if not limited:
        return _distance_joins(edges, seeds)
    marks = seeds.select("query_id", "node_id").distinct()
    flagged = edges.select("query_id", "src", "dst")
    for end in ("src", "dst"):
        flagged = flagged.join(
            marks.select("query_id", F.col("node_id").alias(end), F.lit(True).alias(f"{end}_seed")),
            ["query_id", end], "left",
        )
    flagged = flagged.select(
        "query_id", "src", "dst",
        F.coalesce("src_seed", F.lit(False)).alias("src_seed"),
        F.coalesce("dst_seed", F.lit(False)).alias("dst_seed"),
    )
    kinds = dict(flagged.dtypes)
    return flagged.groupBy("query_id").applyInArrow(
        _distances, f"query_id {kinds['query_id']}, node_id {kinds['src']}, distance int"
    )
