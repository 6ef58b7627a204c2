"""Entity, claim and relation extraction from sections, and answer stages.

The generation step is pluggable; everything around it (prompts, parsing,
thresholds, grounding) is column work.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.generation import Provider, generate
from citeloom.functions.names import grounded, ratio
from citeloom.functions.replies import (
    ACROSS_TYPES, CLAIM_TYPES, WITHIN_TYPES, confidence, item_extras, item_text, recover_json, reply_items,
)
from citeloom.functions.text import NON_CONTENT_SECTIONS, is_trivial_claim, norm_name, scrub_preamble, section_pieces, strip
from citeloom.runtime import row_numbers, written
from citeloom.settings import DEFAULTS

ENTITY_TASK = "List the methods, datasets, metrics and claims this section states, as one JSON object."
WITHIN_TASK = "List how the paper relates to the named entities according to this section, as one JSON object."
ACROSS_TASK = "List how the paper's entities relate to the given entities of other papers, as one JSON object."
KNOWN_FIELDS = ("type", "source", "target", "evidence_text", "confidence")


def content_sections(papers: DataFrame) -> DataFrame:
    """papers(paper_id, title, sections) to (paper_id, ord, name, text) ready for extraction.

    A section too long for a prompt is asked in pieces, so nothing of it is left
    out; ``ord`` then counts pieces.
    """
    def pieces(s: Column, i: Column) -> Column:
        text = F.when(s["name"] == "preamble", scrub_preamble(s["text"], F.col("title"))).otherwise(s["text"])
        return F.transform(section_pieces(text, DEFAULTS.section_chars), lambda x: F.struct((s["ord"] - i).alias("ahead"), s["name"].alias("name"), x.alias("text")))

    content = F.filter("sections", lambda s: ~s["name"].isin(*NON_CONTENT_SECTIONS))
    rows = papers.select("paper_id", F.posexplode(F.flatten(F.transform(content, pieces))).alias("place", "s"))
    # a piece's place counts what long sections before it have added
    return rows.select("paper_id", (F.col("s.ahead") + F.col("place")).cast("int").alias("ord"), "s.name", "s.text")


def section_prompt(*extra: Column) -> Column:
    """Prompt of a section; null for a blank one, which is never asked."""
    prompt = F.concat_ws("\n\n", F.concat(F.lit("Section: "), F.col("name")), *extra, F.col("text"))
    return F.when(strip(F.col("text")) != "", prompt)


def _field(key: str) -> Column:
    return item_text(F.col("item"), key)


def extract_entities(sections: DataFrame, providers: Sequence[Provider], pause: float = 2.0) -> DataFrame:
    """Rows (paper_id, ord, kind, pos, name, description, category, value, method, dataset, claim_type, confidence).

    kind is method, dataset, metric or claim (name holds the claim's text).
    Items below the confidence floor, names not found verbatim in the section
    and claims without support in it are dropped.
    """
    asked = sections.withColumn("reply", generate(section_prompt(), ENTITY_TASK, providers, expect_json=True, pause=pause))
    listed = asked.withColumn(
        "listed",
        F.array(*[F.struct(F.lit(kind[:-1]).alias("kind"), reply_items(F.col("reply"), kind).alias("items"))
                  for kind in ("methods", "datasets", "metrics", "claims")]),
    )
    rows = listed.select("paper_id", "ord", "text", F.inline("listed")).select(
        "paper_id", "ord", "text", "kind", F.posexplode("items").alias("pos", "item")
    )
    none = F.lit(None).cast("string")
    parsed = rows.select(
        "paper_id", "ord", "text", "kind", "pos",
        F.when(F.col("kind") == "claim", _field("text")).otherwise(_field("name")).alias("name"),
        F.when(F.col("kind") == "method", _field("description")).otherwise("").alias("description"),
        F.when(F.col("kind") == "method", _field("category")).when(F.col("kind") == "dataset", _field("domain")).alias("category"),
        F.when(F.col("kind") == "metric", _field("value")).alias("value"),
        F.when(F.col("kind") == "metric", F.nullif(_field("method"), F.lit(""))).otherwise(none).alias("method"),
        F.when(F.col("kind") == "metric", F.nullif(_field("dataset"), F.lit(""))).otherwise(none).alias("dataset"),
        F.when(F.col("kind") == "claim", F.upper(_field("type"))).alias("claim_type"),
        confidence(F.try_variant_get("item", "$.confidence", "string")).alias("confidence"),
    )
    kept = parsed.filter(
        (F.col("name") != "")
        & (F.col("confidence") >= DEFAULTS.entity_confidence)
        & ((F.col("kind") != "claim") | F.col("claim_type").isin(*CLAIM_TYPES))
        & (~F.col("kind").isin("method", "dataset") | F.contains("text", F.col("name")))
    )
    is_claim = F.col("kind") == "claim"
    supported = grounded(F.when(is_claim, F.col("name")).otherwise(F.lit("")), F.when(is_claim, F.col("text")).otherwise(F.lit("")),
                         DEFAULTS.claim_grounding)
    return kept.filter(supported | ~is_claim).drop("text")


def drop_title_and_trivial_claims(entities: DataFrame, papers: DataFrame) -> DataFrame:
    """Claims that repeat the title, or are short and hold no verb, go."""
    titled = entities.join(papers.select("paper_id", "title"), "paper_id", "left")
    is_claim = F.col("kind") == "claim"
    same = ratio(F.when(is_claim, F.lower("name")).otherwise(F.lit("")),
                 F.when(is_claim & (F.coalesce("title", F.lit("")) != ""), F.lower("title")).otherwise(F.lit("-"))) > DEFAULTS.title_match
    return titled.filter(~is_claim | (~same & ~is_trivial_claim(F.col("name")))).drop("title")


def _surviving(lengths: list[int], unit: np.ndarray, floor: float, cells: int = 4_000_000) -> list[bool]:
    """Greedy near-duplicate removal in order; the longer text of a pair stays.

    A claim dropped before its turn compares with nothing; one dropped during
    its turn goes on comparing. Claims are compared with all earlier ones in blocks of
    at most ``cells`` products; only those with a near one are then gone through.
    """
    n = len(lengths)
    alive, acts = [True] * n, [True] * n
    start = 0
    while start < n:
        end = start + 1
        while end < n and (end + 1 - start) * (end + 1) <= cells:
            end += 1
        near = np.round(unit[start:end] @ unit[:end].T, 9) > floor
        near &= np.arange(end) < np.arange(start, end)[:, None]
        for j in np.flatnonzero(near.any(axis=1)):
            turn = start + int(j)
            for i in np.flatnonzero(near[j]).tolist():
                if not acts[i]:
                    continue
                if lengths[i] >= lengths[turn]:
                    alive[turn] = acts[turn] = False
                    break
                alive[i] = False
        start = end
    return alive


def dedupe_claims(claims: DataFrame, floor: float = DEFAULTS.claim_duplicate_threshold) -> DataFrame:
    """Drop near-duplicate claims of a paper: claims(paper_id, seq, text, vector) to (paper_id, seq).

    Verbatim copies within a paper are removed first (they always lose to their
    first occurrence), so the ordered pass sees a paper's distinct claims. Claims are dealt
    by paper once, for both steps.
    """
    first = claims.repartition("paper_id").groupBy("paper_id", "text").agg(
        F.min("seq").alias("seq"), F.min_by("vector", "seq").alias("vector")
    ).withColumn("size", F.length("text"))
    kinds = dict(first.dtypes)

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("seq")
        held = rows.column("vector").combine_chunks()
        vectors = np.asarray(held.flatten(), dtype="float64").reshape(len(rows), len(held[0]))
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
        mask = pa.array(_surviving(rows.column("size").to_pylist(), unit, floor))
        return rows.filter(mask).select(["paper_id", "seq"])

    return first.drop("text").groupBy("paper_id").applyInArrow(run, f"paper_id {kinds['paper_id']}, seq {kinds['seq']}")


def extract_relations(
    sections: DataFrame, names: DataFrame, providers: Sequence[Provider], across: bool = False,
    candidates: DataFrame | None = None, pause: float = 2.0,
) -> DataFrame:
    """Rows (paper_id, ord, pos, relation_type, source, target, evidence_text, confidence, properties).

    names(paper_id, ord, names array<string>) are the section's own entities.
    Within a paper the source defaults to "paper". Across papers
    candidates(paper_id, listed string[, page]) holds the prompt lists of other papers'
    entities; a section is asked once per list, and only with one. ``pos`` goes on
    from page to page. The caller checks targets with ``known_targets``.
    """
    told = sections.join(names, ["paper_id", "ord"], "left").withColumn(
        "own", F.concat(F.lit("Entities: "), F.array_join(F.coalesce("names", F.array().cast("array<string>")), ", "))
    )
    extra = [F.col("own")]
    if not across:
        told = told.withColumn("page", F.lit(0))
    else:
        page = F.col("page") if "page" in candidates.columns else F.lit(0).alias("page")
        told = told.join(candidates.select("paper_id", page, "listed"), "paper_id")
        extra.append(F.concat(F.lit("Other papers:\n"), F.col("listed")))
    task, allowed = (ACROSS_TASK, ACROSS_TYPES) if across else (WITHIN_TASK, WITHIN_TYPES)
    asked = told.withColumn("reply", generate(section_prompt(*extra), task, providers, expect_json=True, pause=pause))
    rows = asked.select("paper_id", "ord", "page", F.posexplode(reply_items(F.col("reply"), "relations")).alias("pos", "item"))
    if across:
        onward = F.row_number().over(Window.partitionBy("paper_id", "ord").orderBy("page", "pos")) - 1
        rows = rows.withColumn("pos", onward)
    source = F.nullif(_field("source"), F.lit(""))
    return rows.select(
        "paper_id", "ord", "pos", F.upper(_field("type")).alias("relation_type"),
        (source if across else F.coalesce(source, F.lit("paper"))).alias("source"),
        _field("target").alias("target"), _field("evidence_text").alias("evidence_text"),
        confidence(F.try_variant_get("item", "$.confidence", "string")).alias("confidence"),
        item_extras(F.col("item"), KNOWN_FIELDS).alias("properties"),
    ).filter(
        F.col("relation_type").isin(*allowed) & (F.col("target") != "") & F.col("source").isNotNull()
        & (F.col("confidence") >= DEFAULTS.relation_confidence)
    )


def foreign_candidates(existing: DataFrame, own: DataFrame, per_prompt: int = DEFAULTS.candidate_entities) -> DataFrame:
    """(paper_id, page, offered array<struct<name,entity_type>>, listed): all stored entities a paper does not name itself.

    existing(node_id, name, entity_type); own(paper_id, name), with a null name for
    papers that name nothing. Entities are offered in order of node_id, at most
    ``per_prompt`` a prompt: the batch's papers meet all entities page by page, and pages
    of which nothing is left are not asked.
    """
    named = existing.select("node_id", "name", "entity_type", norm_name(F.col("name")).alias("norm"))
    numbered = row_numbers(named, [], [F.col("node_id"), F.col("name")], "_n")
    one = F.struct("_n", "name", "entity_type", "norm")
    pages = written(
        numbered.groupBy(F.floor((F.col("_n") - 1) / per_prompt).cast("int").alias("page")).agg(F.array_sort(F.collect_list(one)).alias("every")),
        "pages",
    )
    mine = own.groupBy("paper_id").agg(F.collect_set(norm_name(F.col("name"))).alias("mine"))
    asked = mine.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages.count()))))
    left = F.transform(
        F.filter("every", lambda c: ~F.array_contains("mine", c["norm"])),
        lambda c: F.struct(c["name"].alias("name"), c["entity_type"].alias("entity_type")),
    )
    listed = F.array_join(F.transform("offered", lambda c: F.concat(F.lit("- "), c["name"], F.lit(" ("), c["entity_type"], F.lit(")"))), "\n")
    return asked.join(pages, "page").select("paper_id", "page", left.alias("offered")).filter(F.size("offered") > 0).withColumn("listed", listed)


def known_targets(relations: DataFrame, offered: DataFrame) -> DataFrame:
    """Relations across papers whose target is exactly one of the names offered to the paper.

    The targets are looked up in the paper's lists; the lists, which hold all names for every
    paper, are never made rows.
    """
    targets = relations.select("paper_id", "target").distinct()
    listed = offered.select("paper_id", F.col("offered.name").alias("names")).join(targets, "paper_id")
    held = listed.filter(F.array_contains("names", F.col("target"))).select("paper_id", "target").distinct()
    return relations.join(held, ["paper_id", "target"], "left_semi")


def answer(
    questions: DataFrame, providers: Sequence[Provider], system: str, empty_reply: str, pause: float = 2.0
) -> DataFrame:
    """questions(query_id, question, text) with ``answer``; a fixed reply where there is no context."""
    prompt = F.concat(F.lit("<context>\n"), F.col("text"), F.lit("\n</context>\n\n<question>\n"), F.col("question"), F.lit("\n</question>"))
    has_text = strip(F.col("text")) != ""
    reply = generate(F.when(has_text, prompt), system, providers, pause=pause)
    return questions.withColumn("reply", reply).withColumn(
        "answer", F.when(has_text, F.col("reply")).otherwise(F.lit(empty_reply))
    ).drop("reply")


WARNING = "Check this answer: parts of it were not found in the sources that it draws on."


def faithfulness_warning(answers: DataFrame, providers: Sequence[Provider], pause: float = 2.0) -> DataFrame:
    """answers(text, answer) with ``warning`` where a second opinion scores below the floor.

    No context, no answer, a failed call or an unreadable reply give no warning.
    """
    checkable = (strip(F.col("answer")) != "") & (strip(F.col("text")) != "")
    prompt = F.concat(F.lit("CONTEXT:\n"), F.col("text"), F.lit("\n\nANSWER:\n"), F.col("answer"))
    asked = answers.withColumn(
        "opinion", generate(F.when(checkable, prompt), "Score from 0 to 1 how well the answer follows from the context, as JSON.",
                            providers, fail_open=True, pause=pause))
    return asked.withColumn("warning", F.when(reply_score(F.col("opinion")) < DEFAULTS.faithfulness_threshold, F.lit(WARNING))).drop("opinion")


def reply_score(reply: Column) -> Column:
    """The clamped "score" of a JSON reply; null if there is none."""
    parsed = F.try_parse_json(recover_json(reply))
    present = F.get_json_object(recover_json(reply), "$.score").isNotNull()
    return F.when(present, confidence(F.try_variant_get(parsed, "$.score", "string")))


def judge(answers: DataFrame, providers: Sequence[Provider], pause: float = 2.0) -> DataFrame:
    """answers(question, gold_answer, answer) with ``score``: a failed or unreadable verdict counts 0."""
    prompt = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nGold answer: "), F.col("gold_answer"),
                      F.lit("\n\nSystem's answer: "), F.col("answer"))
    verdict = generate(prompt, "Score the answer 0, 0.5 or 1 against the gold answer, as JSON.", providers,
                       expect_json=True, fail_open=True, pause=pause)
    return answers.withColumn("verdict", verdict).withColumn(
        "score", F.coalesce(reply_score(F.col("verdict")), F.lit(0.0))).drop("verdict")


def entity_totals(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Per paper: entities_found (all four kinds after claim clean-up) and relations_found."""
    found = entities.groupBy("paper_id").agg(F.count("*").alias("entities_found"))
    related = relations.groupBy("paper_id").agg(F.count("*").alias("relations_found"))
    return found.join(related, "paper_id", "full_outer").na.fill(0)
