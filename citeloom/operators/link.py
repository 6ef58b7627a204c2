"""From extracted relations to edges: endpoints, type rules, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.names import grounded
from citeloom.functions.text import norm_name
from citeloom.settings import DEFAULTS

# Relations that are never stored, and the label a target must have.
SKIPPED = ("REPORTS_RESULT", "CONTRADICTS", "CITES")
TARGET_LABEL = {
    "EVALUATES_ON": "Dataset", "TRAINED_ON": "Dataset", "USES_METHOD": "Method", "DISTILLED_FROM": "Method",
}


def name_index(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Last entry per normalised name: entries(keys..., name, node_id, label, seq)."""
    named = entries.withColumn("norm", norm_name(F.col("name")))
    return named.groupBy(*keys, "norm").agg(F.max_by(F.struct("node_id", "label"), "seq").alias("hit")).select(
        *keys, "norm", "hit.node_id", "hit.label"
    )


def _look_up(relations: DataFrame, end: str, stored: DataFrame, own: DataFrame) -> DataFrame:
    # "paper" is the source of most relations and is in no index: a key per paper,
    # which matches nothing, keeps it from becoming one hot join key
    norm = norm_name(F.col(end))
    if end == "source":
        norm = F.when(F.col(end) == "paper", F.concat(F.lit("\u0001"), F.col("paper_id"))).otherwise(norm)
    keyed = relations.withColumn("norm", norm)
    mine = own.select("paper_id", "norm", F.struct("node_id", "label").alias("mine"))
    known = stored.select("norm", F.struct("node_id", "label").alias("known"))
    return (
        keyed.join(mine, ["paper_id", "norm"], "left").join(known, "norm", "left")
        .withColumn(f"{end}_hit", F.coalesce("mine", "known")).drop("norm", "mine", "known")
    )


def link(relations: DataFrame, stored: DataFrame, own: DataFrame, paper_node: Column) -> DataFrame:
    """Relations with both endpoints known: (paper_id, ..., src, dst, dst_label).

    relations(paper_id, relation_type, source, target, ...); stored(norm,
    node_id, label) indexes existing entities, own(paper_id, norm, node_id,
    label) those of each paper, which take precedence. The source "paper"
    stands for the paper itself.
    """
    kept = relations.filter(~F.col("relation_type").isin(*SKIPPED))
    found = _look_up(_look_up(kept, "source", stored, own), "target", stored, own)
    src = F.when(F.col("source") == "paper", paper_node).otherwise(F.col("source_hit.node_id"))
    return (
        found.withColumn("src", src).withColumn("dst", F.col("target_hit.node_id"))
        .withColumn("dst_label", F.col("target_hit.label")).drop("source_hit", "target_hit")
        .filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    )


def fitting_targets(linked: DataFrame) -> DataFrame:
    """Drop relations whose target has the wrong label for their type."""
    wanted = F.lit(None).cast("string")
    for rel_type, label in TARGET_LABEL.items():
        wanted = F.when(F.col("relation_type") == rel_type, label).otherwise(wanted)
    return linked.filter(wanted.isNull() | (F.col("dst_label") == wanted))


def grounded_introductions(linked: DataFrame) -> DataFrame:
    """INTRODUCES stays only where the evidence names the target."""
    intro = F.col("relation_type") == "INTRODUCES"
    named = grounded(F.when(intro, F.col("target")).otherwise(F.lit("")),
                     F.when(intro, F.col("evidence_text")).otherwise(F.lit("")), DEFAULTS.introduces_grounding)
    return linked.filter(named | ~intro)


def without_conflicts(linked: DataFrame) -> DataFrame:
    """TRAINED_ON yields to EVALUATES_ON between the same two nodes of one paper's run."""
    evaluated = F.max((F.col("relation_type") == "EVALUATES_ON").cast("int")).over(
        Window.partitionBy("paper_id", "src", "dst")
    )
    return linked.withColumn("_evaluated", evaluated).filter(
        (F.col("relation_type") != "TRAINED_ON") | (F.col("_evaluated") == 0)
    ).drop("_evaluated")


def linked_relations(relations: DataFrame, stored: DataFrame, own: DataFrame, paper_node: Column) -> DataFrame:
    """All linking rules in order."""
    return without_conflicts(grounded_introductions(fitting_targets(link(relations, stored, own, paper_node))))
