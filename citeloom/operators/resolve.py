"""Entity resolution: mentions of a batch onto stored entities and onto each other.

Names are reduced to distinct normalised forms first. Candidate pairs come from
equi-joins on keys that every true match shares:

- prefix and containment: the shorter normalised name itself, against all
  letter-bounded substrings of the longer;
- acronym: the upper-case short form, against the initials of the longer;
- matching-blocks ratio: an unchanged segment. A ratio above the floor bounds the
  edits by the lengths, so of one segment more than edits one stays whole.

Descriptions are compared by an exact vector scan. Pairs are verified by a
pluggable test, best first, until one is confirmed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.generation import Provider, generate
from citeloom.functions.names import (
    acronym, is_acronym_variant, is_contained, is_prefix_variant, letter_signature, ratio_above, signature_distance,
)
from citeloom.functions.text import norm_name, says_yes
from citeloom.operators.knn import vector_matches
from citeloom.runtime import checkpoint, written
from citeloom.settings import DEFAULTS


def distinct_names(mentions: DataFrame) -> DataFrame:
    """mentions(name, entity_type, seq, ...) to one row per (entity_type, norm): first spelling, first seq, count."""
    return mentions.withColumn("norm", norm_name(F.col("name"))).groupBy("entity_type", "norm").agg(
        F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"), F.count("*").alias("mentions")
    )


def bounded_substrings(norm: Column, sizes: Column | None = None) -> Column:
    """Substrings of at least two characters with no letter beside them, of the given lengths if any are given."""
    size = F.length(norm)

    def letter(position: Column) -> Column:
        return F.substring(norm, position, F.lit(1)).rlike(r"^\p{L}$")

    starts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | ~letter(i - 1))
    wanted = F.sequence(F.lit(2), size) if sizes is None else F.filter(sizes, lambda n: (n >= 2) & (n <= size))

    def ends_well(i: Column, n: Column) -> Column:
        return (i + n - 1 == size) | ((i + n - 1 < size) & ~letter(i + n))

    spans = F.transform(
        starts, lambda i: F.transform(F.filter(wanted, lambda n: ends_well(i, n)), lambda n: F.substring(norm, i, n))
    )
    return F.when(size >= 2, F.array_distinct(F.flatten(spans))).otherwise(F.array().cast("array<string>"))


def most_edits(total: Column, floor: float) -> Column:
    """Most insertions and deletions between two names of ``total`` characters whose ratio is above ``floor``.

    A ratio 2M / total above the floor leaves total - 2M < (1 - floor) * total
    characters unmatched, a number as odd or even as the total.
    """
    most = F.floor((1 - floor) * total + 1e-9)
    return (most - F.pmod(total - most, F.lit(2))).cast("int")


def _partner_lengths(size: Column, floor: float) -> Column:
    r = floor / (2 - floor)
    return F.sequence(F.greatest(F.lit(1), F.ceil(size * r - 1e-9)).cast("int"), F.floor(size / r + 1e-9).cast("int"))


def _lengths(names: DataFrame, name: str) -> DataFrame:
    """One row per type, (entity_type, met): the lengths its names have."""
    return written(names.groupBy("entity_type").agg(F.collect_set(F.length(name)).alias("met")), "lengths")


def _met_lengths(names: DataFrame, name: str, floor: float) -> Column:
    """Lengths a partner may have; where the names carry ``met``, only those."""
    lengths = _partner_lengths(F.length(name), floor)
    return F.array_intersect(lengths, F.col("met")) if "met" in names.columns else lengths


def _segment(size: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` when a name is cut into equal parts."""
    start = F.floor(i * size / parts).cast("int")
    return start, F.floor((i + 1) * size / parts).cast("int") - start


def _indexed_segments(names: DataFrame, name: str, floor: float) -> DataFrame:
    """Segments of a name for every length a partner may have: the names' columns with (own, other, k, i, segment)."""
    def cut(i: Column) -> Column:
        start, size = _segment(F.col("own"), F.col("k") + 1, i)
        return F.struct(i.alias("i"), F.substring(F.col(name), start + 1, size).alias("segment"))

    sized = names.select(*names.columns, F.length(name).alias("own"), F.explode(_met_lengths(names, name, floor)).alias("other"))
    return (sized.withColumn("k", most_edits(F.col("own") + F.col("other"), floor))
            .drop("met").select("*", F.inline(F.transform(F.sequence(F.lit(0), F.col("k")), cut))))


def _probed_segments(names: DataFrame, name: str, floor: float) -> DataFrame:
    """Substrings of a name where a partner's segments may lie: the names' columns with (own, other, k, i, segment).

    Of k + 1 segments and at most ``k`` insertions and deletions, take the first
    segment up to whose end there are fewer edits than segments. It is untouched, exactly i
    edits lie before it and at most k - i behind. So it has moved by -i, -i + 2, ... or
    i places, and by no more than k - i from where it lies counted from the end: about
    k * k / 4 substrings for a pair of lengths.
    """
    def places(i: Column) -> Column:
        start, size = _segment(F.col("own"), F.col("k") + 1, i)
        longer, behind = F.col("other") - F.col("own"), F.col("k") - i
        low = F.greatest(-i, longer - behind, -start)
        low = low + F.pmod(i - low, F.lit(2))  # an edit moves what follows by one place
        high = F.least(i, longer + behind, F.col("other") - size - start)
        at = F.when(high >= low, F.sequence(start + low, start + high, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(i.alias("i"), F.substring(F.col(name), p + 1, size).alias("segment")))

    # own is the partner's length here, as in the index
    sized = names.select(*names.columns, F.length(name).alias("other"), F.explode(_met_lengths(names, name, floor)).alias("own"))
    every = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.col("k")), places)))
    return (sized.withColumn("k", most_edits(F.col("own") + F.col("other"), floor))
            .drop("met").select("*", F.inline(every)))


def name_pairs(new: DataFrame, known: DataFrame, floor: float = DEFAULTS.fuzzy_threshold) -> DataFrame:
    """All (entity_type, a, b, score) of a new name a and a known name b scoring above ``floor``.

    new, known(entity_type, norm, name), one row per normalised name. Equal
    names are left out; they are exact matches. A known name is cut into one
    segment more than a match may have edits, so one segment lies unchanged in the
    new name, near its place; both lengths and the segment's number are part of
    the join key. Pairs whose letter counts differ by more than the edits go at once.
    Keys are made only for lengths the other side has. They are many more than the
    names they come from, so their joins are told to sort and never to broadcast.
    Floors below 0.6 would leave empty segments and are refused.
    """
    if floor < 0.6:
        raise ValueError("the segment index needs a floor of 0.6 or more")
    a = new.select("entity_type", F.col("norm").alias("a"), F.col("name").alias("a_name"))
    b = known.select("entity_type", F.col("norm").alias("b"), F.col("name").alias("b_name"))

    new_lengths, known_lengths = _lengths(a, "a"), _lengths(b, "b")

    def inside(longer: DataFrame, long: str, shorter: DataFrame, short: str, met: DataFrame) -> DataFrame:
        keys = longer.join(met, "entity_type").select("entity_type", long, F.explode(bounded_substrings(F.col(long), F.col("met"))).alias(short))
        return keys.hint("merge").join(shorter.select("entity_type", short), ["entity_type", short]).select("entity_type", "a", "b")

    def initials(longer: DataFrame, long: str, shorter: DataFrame, short: str) -> DataFrame:
        left = longer.select("entity_type", long, acronym(F.col(f"{long}_name")).alias("key")).filter("key IS NOT NULL")
        right = shorter.select("entity_type", short, F.upper(f"{short}_name").alias("key"))
        return left.join(right, ["entity_type", "key"]).select("entity_type", "a", "b")

    keys = ["entity_type", "own", "other", "i", "segment"]
    a_only, b_only = a.select("entity_type", "a"), b.select("entity_type", "b")
    probed = _probed_segments(a_only.withColumn("a_sign", letter_signature(F.col("a"))).join(known_lengths, "entity_type"), "a", floor)
    indexed = _indexed_segments(b_only.withColumn("b_sign", letter_signature(F.col("b"))).join(new_lengths, "entity_type"), "b", floor)
    alike = probed.hint("merge").join(indexed.drop("k"), keys).filter(
        signature_distance(F.col("a_sign"), F.col("b_sign")) <= F.col("k")).select("entity_type", "a", "b")
    candidates = written(
        inside(a, "a", b, "b", known_lengths).unionByName(inside(b, "b", a, "a", new_lengths)).unionByName(initials(a, "a", b, "b"))
        .unionByName(initials(b, "b", a, "a")).unionByName(alike).filter("a <> b").distinct(),
        "name-pairs",
    )
    named = candidates.join(a, ["entity_type", "a"]).join(b, ["entity_type", "b"])
    pattern = (
        is_prefix_variant(F.col("a_name"), F.col("b_name")) | is_acronym_variant(F.col("a_name"), F.col("b_name"))
        | is_contained(F.col("a_name"), F.col("b_name"))
    )
    # verified in two steps so that only pairs without a pattern reach Python
    marked = named.withColumn("pattern", pattern)
    scored = marked.withColumn(
        "score",
        F.when(F.col("pattern"), F.lit(1.0)).otherwise(
            ratio_above(F.when(F.col("pattern"), F.lit("")).otherwise(F.col("a")),
                        F.when(F.col("pattern"), F.lit("")).otherwise(F.col("b")), floor)
        ),
    )
    return scored.filter(F.col("score") > floor).select("entity_type", "a", "b", "score")


def roots(parents: DataFrame) -> DataFrame:
    """Follow (key, parent) pointers to the end by doubling: (key, root).

    Every round halves the longest chain; lineage is cut per round.
    """
    current = checkpoint(parents.select("key", F.col("parent").alias("root")))
    while True:
        up = current.select(F.col("key").alias("root"), F.col("root").alias("higher"))
        moved = checkpoint(
            current.join(up, "root", "left").select("key", F.coalesce("higher", "root").alias("root"), (
                F.col("higher").isNotNull() & (F.col("higher") != F.col("root"))).alias("moved"))
        )
        current = moved.select("key", "root")
        if moved.filter("moved").isEmpty():
            return current


def first_confirmed(pairs: DataFrame, confirm: Callable[[DataFrame], DataFrame] | None, order: list[Column]) -> DataFrame:
    """For every new name (entity_type, a) its first pair in ``order`` that ``confirm`` keeps.

    Pairs are asked about in rounds of ranks 1, 2 to 3, 4 to 7, ..., and only for
    names still open: rounds grow with the logarithm of the longest shortlist, and at
    most as many later candidates are asked about as came before. Without
    ``confirm`` the first pair counts.
    """
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("entity_type", "a").orderBy(*order)))
    if confirm is None:
        return written(ranked.filter("place = 1"), "first-pairs")
    open_pairs, place, found = written(ranked, "ranked-pairs"), 1, None
    columns = open_pairs.columns
    while not open_pairs.isEmpty():
        asked = confirm(open_pairs.filter(F.col("place") < 2 * place)).select(*columns)
        yes = written(asked.groupBy("entity_type", "a").agg(F.min_by(F.struct(*columns), "place").alias("first")).select("first.*"), "confirmed")
        found = yes if found is None else found.unionByName(yes)
        open_pairs = written(open_pairs.filter(F.col("place") >= 2 * place).join(yes.select("entity_type", "a"), ["entity_type", "a"], "left_anti"), "open-pairs")
        place *= 2
    return open_pairs if found is None else found


SAME_TASK = "Two names from research papers follow. Say yes if they mean the same thing, otherwise no."


def ask_model(providers: Sequence[Provider], new_text: DataFrame | None = None, stored_text: DataFrame | None = None,
              pause: float = 2.0) -> Callable[[DataFrame], DataFrame]:
    """A test for ``resolve`` that asks a model about every pair; anything but a yes, and any failure, is a no.

    new_text(entity_type, norm, description) and stored_text(node_id, description)
    are told along with the names.
    """
    def confirm(pairs: DataFrame) -> DataFrame:
        told = pairs.withColumns({"_new": F.lit(""), "_old": F.lit("")})
        if new_text is not None:
            told = told.drop("_new").join(new_text.select("entity_type", F.col("norm").alias("a"), F.col("description").alias("_new")), ["entity_type", "a"], "left")
        if stored_text is not None:
            told = told.drop("_old").join(stored_text.select("node_id", F.col("description").alias("_old")), "node_id", "left")

        def line(label: str, name: str, text: str) -> Column:
            return F.concat(F.lit(f"{label} ("), "entity_type", F.lit("): "), name, F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(", "), text)).otherwise(""))

        prompt = F.concat_ws("\n", line("First", "a", "_new"), line("Second", "name", "_old"))
        return told.withColumn("_reply", generate(prompt, SAME_TASK, providers, fail_open=True, pause=pause)).filter(
            F.coalesce(says_yes(F.col("_reply")), F.lit(False))).drop("_reply", "_new", "_old")

    return confirm


def resolve(
    mentions: DataFrame, stored: DataFrame, confirm: Callable[[DataFrame], DataFrame] | None = None,
    mention_vectors: DataFrame | None = None, dimension: int = DEFAULTS.embedding_dimension,
    fuzzy: float = DEFAULTS.fuzzy_threshold, close: float = DEFAULTS.embedding_threshold,
) -> DataFrame:
    """One row per new name: (entity_type, norm, name, seq, method, node_key).

    mentions(name, entity_type, seq); stored(node_id, entity_type, name[,
    vector, is_alias]) with aliases as further rows of the same node; an alias
    never matches exactly, only as a shortlisted candidate. mention_vectors
    (entity_type, norm, vector) enables the description channel. ``confirm``
    filters shortlisted pairs (entity_type, a, b, score, node_id, name), node_id
    null for another new name; None accepts all. Every node that has a shortlisted
    spelling is a candidate, so nodes that share an alias are told apart.

    method is exact (a stored name), fuzzy (best confirmed stored candidate, or
    an earlier new name) or none. node_key is the stored node id, or
    "new:type:norm" of the first name of a new entity. Ids of stored entities
    never change, whichever spelling becomes canonical.
    """
    new = written(distinct_names(mentions), "new-names")
    alias = F.col("is_alias") if "is_alias" in stored.columns else F.lit(False)
    spelled = written(
        stored.withColumn("norm", norm_name(F.col("name"))).withColumn("alias", alias).groupBy("entity_type", "norm", "node_id").agg(
            F.min("alias").alias("alias"), F.min("name").alias("name")),
        "known-spellings",
    )
    known = written(spelled.groupBy("entity_type", "norm").agg(F.min_by("name", F.struct("alias", "node_id")).alias("name")), "known-names")
    primary = spelled.filter(~F.col("alias")).groupBy("entity_type", "norm").agg(F.min("node_id").alias("node_id"))
    exact = new.join(primary, ["entity_type", "norm"])
    rest = written(new.join(primary, ["entity_type", "norm"], "left_anti"), "unmatched")

    same_alias = rest.join(known.select("entity_type", "norm"), ["entity_type", "norm"], "left_semi").select(
        "entity_type", F.col("norm").alias("a"), F.col("norm").alias("b"), F.lit(1.0).alias("score"))
    pairs = name_pairs(rest, known, fuzzy).unionByName(same_alias)
    if mention_vectors is not None:
        asked = mention_vectors.join(rest.select("entity_type", "norm"), ["entity_type", "norm"], "left_semi").select(
            F.concat_ws("\u0001", "entity_type", "norm").alias("query_id"), "vector", F.col("entity_type").alias("scope"))
        described = stored.filter(F.col("vector").isNotNull()).select(
            F.concat_ws("\u0001", "entity_type", norm_name(F.col("name"))).alias("id"), "vector", F.col("entity_type").alias("scope"))
        close_pairs = vector_matches(described, asked, close, dimension).select(
            F.substring_index("query_id", "\u0001", 1).alias("entity_type"), F.substring_index("query_id", "\u0001", -1).alias("a"),
            F.substring_index("id", "\u0001", -1).alias("b"), "score")
        pairs = pairs.unionByName(close_pairs)
    shortlist = pairs.groupBy("entity_type", "a", "b").agg(F.max("score").alias("score"))
    nodes = spelled.select("entity_type", F.col("norm").alias("b"), "node_id", "name")
    matched = first_confirmed(shortlist.join(nodes, ["entity_type", "b"]), confirm, [F.desc("score"), F.col("node_id"), F.col("b")]).select(
        "entity_type", F.col("a").alias("norm"), "node_id")

    # names of this batch among themselves: each points to its best earlier look-alike
    open_names = rest.join(matched, ["entity_type", "norm"], "left_anti")
    earlier = rest.select("entity_type", F.col("norm").alias("b"), "name", F.col("seq").alias("b_seq"))
    own_pairs = (
        name_pairs(open_names, rest, fuzzy)
        .join(open_names.select("entity_type", F.col("norm").alias("a"), "seq"), ["entity_type", "a"])
        .join(earlier, ["entity_type", "b"]).filter(F.col("b_seq") < F.col("seq"))
        .withColumn("node_id", F.lit(None).cast(spelled.schema["node_id"].dataType))
    )
    pointers = first_confirmed(own_pairs, confirm, [F.desc("score"), F.col("b_seq")]).select("entity_type", "a", "b")
    key = lambda t, n: F.concat_ws("\u0001", t, n)
    links = roots(pointers.select(key("entity_type", "a").alias("key"), key("entity_type", "b").alias("parent")))

    of_known = matched.select(key("entity_type", "norm").alias("root"), F.col("node_id").alias("root_node"))
    settled = (
        rest.withColumn("key", key("entity_type", "norm"))
        .join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
        .join(of_known, "root", "left")
    )
    created = F.concat(F.lit("new:"), F.replace("root", F.lit("\u0001"), F.lit(":")))
    joined = settled.select(
        "entity_type", "norm", "name", "seq",
        F.when((F.col("root") == F.col("key")) & F.col("root_node").isNull(), "none").otherwise("fuzzy").alias("method"),
        F.coalesce("root_node", created).alias("node_key"),
    )
    return joined.unionByName(exact.select("entity_type", "norm", "name", "seq", F.lit("exact").alias("method"),
                                           F.col("node_id").alias("node_key")))


def merged_entities(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """Canonical name per entity: the shortest spelling, stored before new on ties: (node_key, name, spellings)."""
    old = stored.join(resolved.select(F.col("node_key").alias("node_id")).distinct(), "node_id", "left_semi").select(
        F.col("node_id").alias("node_key"), "name", F.lit(0).alias("age"), F.lit(None).cast(resolved.schema["seq"].dataType).alias("seq"))
    names = resolved.select("node_key", "name", F.lit(1).alias("age"), "seq").unionByName(old)
    return names.groupBy("node_key").agg(
        F.min_by("name", F.struct(F.length("name"), "age", "seq", "name")).alias("name"), F.count_distinct("name").alias("spellings"))


def alias_rows(resolved: DataFrame, stored: DataFrame, canonical: DataFrame) -> DataFrame:
    """Distinct (node_key, alias) spellings that differ from the canonical name, as rows."""
    old = stored.select(F.col("node_id").alias("node_key"), F.col("name").alias("alias"))
    rows = resolved.select("node_key", F.col("name").alias("alias")).unionByName(old).distinct()
    return rows.join(canonical.select("node_key", F.col("name").alias("canonical")), "node_key").filter(
        norm_name(F.col("alias")) != norm_name(F.col("canonical"))).select("node_key", "alias")

