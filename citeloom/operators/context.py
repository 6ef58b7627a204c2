"""Token-budgeted context text per query.

Token counts add up over lines, so trimming from the end is a running total
over ranked lines. Groups are one query's ranked nodes, edges and chunks, all
of which are cut to a fixed number before they get here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import token_count
from citeloom.settings import CONTEXT_LABELS, DEFAULTS

SKIPPED_RELATIONS = ("INTRODUCES", "AUTHORED_BY")


def _present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def filled(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def display_name(label: Column, title: Column, name: Column, text: Column, node_id: Column) -> Column:
    paper = F.concat(F.lit("'"), F.coalesce(title, node_id), F.lit("'"))
    return F.when(label == "Paper", paper).otherwise(filled(name, text, node_id))


def entity_line(label: Column, name: Column, title: Column, text: Column, year: Column, venue: Column,
                node_id: Column, intro_title: Column, intro_year: Column) -> Column:
    """"- [LABEL] name" with the details each label carries."""
    tag = F.concat(F.lit("- ["), F.upper(label), F.lit("] "))
    intro = F.when(
        intro_title.isNotNull(),
        F.concat(
            F.lit(" (introduced by Paper: '"), intro_title, F.lit("'"),
            F.when(F.coalesce(intro_year, F.lit(0)) != 0, F.concat(F.lit(", "), intro_year.cast("string")))
            .otherwise(F.lit("")), F.lit(")"),
        ),
    ).otherwise(F.lit(""))
    meta = F.concat_ws(", ", F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string")), F.when(_present(venue), venue))
    meta = F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(F.lit(""))
    return (
        F.when(label.isin("Method", "Dataset"), F.concat(tag, F.coalesce(name, node_id), intro))
        .when(label == "Paper", F.concat(tag, F.lit("'"), F.coalesce(title, node_id), F.lit("'"), meta))
        .when(label == "Claim", F.concat(tag, F.coalesce(text, node_id)))
        .otherwise(F.concat(tag, filled(name, title, node_id)))
    )


def relationship_line(rel_type: Column, source: Column, target: Column, evidence: Column,
                      metric: Column, value: Column, dataset: Column, margin: Column) -> Column:
    """"- source TYPE target" with the details each type carries; null for skipped types."""
    head = F.concat(F.lit("- "), source, F.lit(" "), rel_type, F.lit(" "), target)
    scored = F.when(_present(metric) & _present(value), F.concat(F.lit(" ("), metric, F.lit(": "), value, F.lit(")")))
    margined = F.when(
        _present(dataset) & _present(metric) & _present(margin),
        F.concat(F.lit(" on "), dataset, F.lit(" ("), metric, F.lit(" margin: "), margin, F.lit(")")),
    )
    quoted = F.when(_present(evidence), F.concat(F.lit(' (evidence: "'), evidence, F.lit('")')))
    none = F.lit("")
    return (
        F.when(rel_type.isin(*SKIPPED_RELATIONS), F.lit(None).cast("string"))
        .when(rel_type == "EVALUATES_ON", F.concat(head, F.coalesce(scored, none)))
        .when(rel_type == "OUTPERFORMS", F.concat(head, F.coalesce(margined, none)))
        .when(rel_type == "REPORTS_RESULT", F.concat(F.lit("- "), source, F.lit(" REPORTS_RESULT: "), target))
        .otherwise(F.concat(head, F.coalesce(quoted, none)))
    )


def introduced_by(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node_id, intro_title, intro_year): the last INTRODUCES edge wins."""
    sources = ranked.select(
        "query_id", F.col("node_id").alias("src"), F.coalesce("title", F.lit("")).alias("title"), "year"
    )
    return (
        edges.filter(F.col("rel_type") == "INTRODUCES")
        .join(sources, ["query_id", "src"])
        .groupBy("query_id", F.col("dst").alias("node_id"))
        .agg(F.max_by(F.struct("title", "year"), "ord").alias("intro"))
        .select("query_id", "node_id", F.col("intro.title").alias("intro_title"), F.col("intro.year").alias("intro_year"))
    )


def label_order(label: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in CONTEXT_LABELS]), label)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(len(CONTEXT_LABELS) + 1)).otherwise(at)


def entity_lines(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, line_no, line): grouped by label, best rank first within a label."""
    order = Window.partitionBy("query_id").orderBy(label_order(F.col("label")), "label", "rank")
    c = F.col
    return ranked.join(introduced_by(ranked, edges), ["query_id", "node_id"], "left").select(
        "query_id",
        F.row_number().over(order).alias("line_no"),
        entity_line(c("label"), c("name"), c("title"), c("text"), c("year"), c("venue"), c("node_id"),
                    c("intro_title"), c("intro_year")).alias("line"),
    )


def relationship_lines(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, line_no, line) in edge order, for edges between ranked nodes."""
    c = F.col
    named = ranked.select(
        "query_id", "node_id",
        display_name(c("label"), c("title"), c("name"), c("text"), c("node_id")).alias("shown"),
    )
    joined = edges
    for end in ("src", "dst"):
        joined = joined.join(
            named.select("query_id", c("node_id").alias(end), c("shown").alias(f"{end}_name")), ["query_id", end]
        )
    lines = joined.select(
        "query_id", "ord",
        relationship_line(c("rel_type"), c("src_name"), c("dst_name"), c("evidence_text"), c("metric"),
                          c("value"), c("dataset"), c("margin")).alias("line"),
    ).filter(c("line").isNotNull())
    order = Window.partitionBy("query_id").orderBy("ord")
    return lines.select("query_id", F.row_number().over(order).alias("line_no"), "line")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """(query_id, line_no, line) for chunk seeds, best first."""
    return chunks.select(
        "query_id", F.col("rank").alias("line_no"),
        F.concat(F.lit("- ["), F.coalesce("section_name", F.lit("")), F.lit("] "), "text").alias("line"),
    )


def build_context(
    queries: DataFrame, entities: DataFrame, relationships: DataFrame, chunks: DataFrame,
    max_tokens: int = DEFAULTS.context_tokens, reserve: int = DEFAULTS.chunk_reserve_tokens,
    count=token_count,
) -> DataFrame:
    """(query_id, text, token_count, truncated).

    Entity and relationship lines share max_tokens - reserve; relationships go
    first when they do not fit, each list from its end. Chunks follow until one
    would cross max_tokens. ``count`` maps a text column to its token count.
    """
    kinds = ((1, "ENTITIES:", entities), (2, "RELATIONSHIPS:", relationships), (3, "RELEVANT TEXT CHUNKS:", chunks))
    lines = None
    for kind, _, part in kinds:
        tagged = part.select("query_id", F.lit(kind).alias("kind"), "line_no", "line", count(F.col("line")).alias("n"))
        lines = tagged if lines is None else lines.unionByName(tagged)
    upto = Window.partitionBy("query_id").orderBy("kind", "line_no")
    budget = F.lit(max_tokens - reserve)
    # first pass: running total over entities, then relationships
    fitted = lines.withColumn("total", F.sum("n").over(upto)).withColumn(
        "fits", (F.col("kind") == 3) | (F.col("total") <= budget)
    )
    whole = Window.partitionBy("query_id")
    head_cost = F.lit(0)
    for kind, head, _ in kinds[:2]:
        any_kept = F.max(F.when((F.col("kind") == kind) & F.col("fits"), 1).otherwise(0)).over(whole)
        head_cost = head_cost + any_kept * count(F.lit(head))
    used = F.sum(F.when((F.col("kind") < 3) & F.col("fits"), F.col("n")).otherwise(0)).over(whole)
    chunk_total = F.sum(F.when(F.col("kind") == 3, F.col("n")).otherwise(0)).over(upto)
    final = (
        fitted.withColumn("base", used + head_cost)
        .withColumn("chunk_total", chunk_total)
        .withColumn(
            "kept",
            F.when(F.col("kind") == 3, F.col("base") + count(F.lit(kinds[2][1])) + F.col("chunk_total") <= max_tokens)
            .otherwise(F.col("fits")),
        )
    )
    per_kind = (
        final.groupBy("query_id", "kind")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("line_no", "line")))).alias("kept_lines"),
            F.max((~F.col("kept")).cast("int")).alias("cut"),
            F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("n"),
        )
        .withColumn(
            "block",
            F.when(
                F.size("kept_lines") > 0,
                F.concat(
                    F.when(F.col("kind") == 1, kinds[0][1]).when(F.col("kind") == 2, kinds[1][1]).otherwise(kinds[2][1]),
                    F.lit("\n"),
                    F.array_join(F.transform("kept_lines", lambda x: x["line"]), "\n"),
                ),
            ),
        )
        .withColumn("n", F.col("n") + F.when(F.col("block").isNotNull(), count(F.substring_index("block", "\n", 1))).otherwise(0))
    )
    built = per_kind.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("kind", "block")))),
                        lambda b: b["block"]), "\n\n",
        ).alias("text"),
        F.sum("n").cast("int").alias("token_count"),
        (F.max("cut") == 1).alias("truncated"),
    )
    return queries.select("query_id").join(built, "query_id", "left").select(
        "query_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def baseline_context(chunks: DataFrame) -> DataFrame:
    """(query_id, text, token_count): numbered excerpts of the vector-only baseline."""
    line = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] (paper_id="), F.coalesce("paper_id", F.lit("")),
        F.lit(", section="), F.coalesce("section_name", F.lit("")), F.lit(") "), "text",
    )
    grouped = chunks.select("query_id", F.struct("rank", line.alias("line")).alias("item")).groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["line"]), "\n\n").alias("text")
    )
    return grouped.withColumn("token_count", token_count(F.col("text")).cast("int"))


def citations(ranked: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """(query_id, paper_id, title, year, ord): ranked papers, then papers seen only as chunks.

    papers(paper_id, title). A paper known from chunks alone has no year.
    """
    shown = ranked.filter((F.col("label") == "Paper") & _present(F.col("paper_id"))).select(
        "query_id", "paper_id", "title", "year", F.col("rank").alias("ord")
    )
    extra = (
        chunks.filter(_present(F.col("paper_id")))
        .groupBy("query_id", "paper_id").agg(F.min("rank").alias("first"))
        .join(shown.select("query_id", "paper_id"), ["query_id", "paper_id"], "left_anti")
        .join(papers.select("paper_id", "title"), "paper_id", "left")
        .select("query_id", "paper_id", "title", F.lit(None).cast("int").alias("year"),
                (F.lit(1_000_000) + F.col("first")).alias("ord"))
    )
    both = shown.unionByName(extra)
    order = Window.partitionBy("query_id").orderBy("ord")
    return both.withColumn("ord", F.row_number().over(order))
