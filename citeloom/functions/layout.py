"""Title and authors from first-page layout lines, as column expressions.

A layout is array<struct<size,text>> of upright, non-blank lines in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import let, strip

# Line shapes that carry no author name, affiliation tokens, marks, and the
# limits of a byline that no abstract ends.
NOISE = (
    r"(?i)^(?:[†‡∗\*\d\s,]*$|\{.*\}.*@.*\..*$|\{|.*@[\w.-]+\.\w+.*$"
    r"|\s*(?:university|department|institute|lab|google|microsoft|stanford|mit)\b|[†‡∗\*§]+\s+\S)"
)
AFFILIATION = (
    r"(?i)^\d+[A-Za-z]|\b(?:university|department|institute|laboratory|corporation|technologies|technological)\b"
)
FOOTNOTE_MARKS = r"[†‡∗\*§]+$"
SIZE_TOLERANCE, LONGEST_LINE, SCANNED_LINES, AUTHOR_LINES = 0.5, 200, 40, 12


def _title_run(layout: Column) -> Column:
    """struct<first, after>: 0-based bounds of the first run of largest-font lines."""
    top = F.array_max(F.transform(layout, lambda x: x["size"])) - SIZE_TOLERANCE
    return let(
        F.struct(F.transform(layout, lambda x: x["size"] >= top).alias("big"), F.size(layout).alias("n")),
        lambda f: let(
            F.array_position(f["big"], True),
            lambda first: F.struct(
                (first - 1).cast("int").alias("first"),
                F.coalesce(
                    F.get(F.filter(F.sequence(F.lit(1), f["n"]), lambda i: (i > first) & ~F.get(f["big"], i - 1)), F.lit(0)) - 1,
                    f["n"],
                ).cast("int").alias("after"),
            ),
        ),
    )


def title_of(layout: Column) -> Column:
    joined = let(
        _title_run(layout),
        lambda run: strip(F.array_join(F.transform(F.slice(layout, run["first"] + 1, run["after"] - run["first"]), lambda x: x["text"]), " ")),
    )
    return F.when(F.size(layout) > 0, F.nullif(joined, F.lit("")))


def split_run_on_names(text: Column) -> Column:
    """Names of a byline without separators: a capital starts a new name once two words are gathered."""
    def step(acc: Column, word: Column) -> Column:
        start_new = (F.size(F.split(acc["open"], " ")) >= 2) & word.rlike(r"^\p{Lu}")
        return F.when(
            start_new, F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), word.alias("open"))
        ).otherwise(
            F.struct(acc["done"].alias("done"), F.when(acc["open"] == "", word).otherwise(F.concat_ws(" ", acc["open"], word)).alias("open"))
        )

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    state = F.aggregate(
        words, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")), step
    )
    return let(state, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def authors_of(layout: Column) -> Column:
    """Author names between the title and the abstract; null if there are none."""
    def names_in(lines: Column) -> Column:
        parts = F.flatten(F.transform(lines, lambda line: F.split(line, r",| and ")))
        kept = F.filter(F.transform(parts, strip), lambda n: (n != "") & ~n.rlike(AFFILIATION))
        regrouped = let(
            kept,
            lambda k: F.when(
                (F.size(k) == 1) & (F.size(F.split(F.get(k, F.lit(0)), r"\s+")) > 4), split_run_on_names(F.get(k, F.lit(0)))
            ).otherwise(k),
        )
        unmarked = F.transform(regrouped, lambda n: strip(F.regexp_replace(n, FOOTNOTE_MARKS, "")))
        return F.filter(unmarked, lambda n: n != "")

    def byline(run: Column) -> Column:
        rest = F.transform(F.slice(layout, run["after"] + 1, F.size(layout)), lambda x: x["text"])

        def upto_abstract(lines: Column) -> Column:
            stop = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit("abstract"))), True)
            head = F.filter(F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")), lambda x: ~x.rlike(NOISE))
            open_end = F.filter(F.slice(lines, 1, SCANNED_LINES), lambda x: ~x.rlike(NOISE) & (F.length(x) <= LONGEST_LINE))
            return F.when(stop > 0, head).otherwise(F.slice(open_end, 1, AUTHOR_LINES))

        return let(rest, upto_abstract)

    lines = let(_title_run(layout), byline)
    found = let(lines, lambda x: F.when(F.size(x) > 0, names_in(x)))
    return F.when((F.size(layout) > 0) & title_of(layout).isNotNull(), found)
