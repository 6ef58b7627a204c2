"""Connected components of an edge table, by minimum labels and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import written


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b); component is the smallest id reachable.

    A round takes the smallest label among neighbours (partial minima, so a hub is
    reduced before the shuffle) and then the label of that label. Every round is
    a written table. Raises if ``rounds`` do not suffice.
    """
    both = written(edges.where(F.col("a") != F.col("b"))
                   .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
                   .select("e.a", "e.b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                     .select("id", F.least("id", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = (both.join(labels.withColumnsRenamed({"id": "b", "component": "label"}), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near")))
        # The label of a label: labels are ids themselves.
        nearer = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        nearest = (nearer.join(labels.withColumnsRenamed({"id": "to", "component": "further"}), "to")
                   .select("id", "was", F.least("to", "further").alias("component")))
        labels = written(nearest, "labels")
        if labels.where(F.col("was") != F.col("component")).isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
