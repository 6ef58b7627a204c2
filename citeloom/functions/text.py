"""Text functions: normalising, sections, references, sentences, tokens, clean-up.

All are column expressions that stay on the JVM side. A document is one row and
is worked on inside its row, so none of them shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known section headings, sections without content, verb hints.
SECTION_HEADERS = (
    "abstract", "introduction", "related work", "background", "method", "methods",
    "methodology", "approach", "model architecture", "architecture", "proposed method",
    "system description", "training", "experiments", "experimental setup", "evaluation",
    "results", "discussion", "conclusion", "conclusions", "future work", "limitations",
    "acknowledgments", "acknowledgements", "references", "appendix",
)
NON_CONTENT_SECTIONS = ("references", "acknowledgments", "acknowledgements")
VERB_HINT = (
    r"\b(is|are|was|were|has|have|had|can|could|will|would|shows?|showed|achiev\w*"
    r"|outperform\w*|propos\w*|introduc\w*|demonstrat\w*|obtain\w*|report\w*|present\w*"
    r"|train\w*|improv\w*|reduc\w*|find|finds|found|enable\w*|allow\w*)\b"
)

_LINE_BREAKS = "\r\n|[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
_HEAD, _BODY = "\u0001", "\u0002"
TOKEN = r"\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; lambdas would else repeat it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Drop white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank; ends are trimmed."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_name(name: Column) -> Column:
    """Comparison form of a name: lower case, single blanks."""
    return collapse(F.lower(name))


def norm_title(title: Column) -> Column:
    """Comparison form of a title: no trailing bracket, letters and digits only."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*\([^)]*\)\s*$", "")
    return F.regexp_replace(F.lower(bare), "[^a-z0-9]", "")


def split_sections(text: Column) -> Column:
    """array<struct<ord,name,text>> of a paper's sections, in order of first mention.

    A heading is a line holding nothing but optional numbering and a known
    name. Text before the first heading is the "preamble", a repeated heading
    appends to its section, empty sections vanish. With at most one section
    left the whole text is returned as "full_text", untouched. The control
    characters that mark headings here are dropped from other texts.
    """
    lines = F.regexp_replace(F.translate(text, _HEAD + _BODY, ""), _LINE_BREAKS, "\n")
    lines = F.when(lines.endswith("\n"), lines).otherwise(F.concat(lines, F.lit("\n")))
    heading = (
        r"(?imd)^[^\S\n]*(?:[\divx]+[.\)][^\S\n]*)*(" + "|".join(SECTION_HEADERS) + r")[^\S\n]*\n"
    )
    marked = F.regexp_replace(lines, heading, f"{_HEAD}$1{_BODY}")
    parts = F.transform(
        F.split(marked, _HEAD),
        lambda piece, i: F.struct(
            F.when(i == 0, F.lit("preamble"))
            .otherwise(F.lower(F.substring_index(piece, _BODY, 1))).alias("name"),
            F.when(i == 0, piece).otherwise(F.substring_index(piece, _BODY, -1)).alias("body"),
        ),
    )

    def merged(parts: Column) -> Column:
        def body_of(name: Column) -> Column:
            bodies = F.transform(F.filter(parts, lambda p: p["name"] == name), lambda p: p["body"])
            return strip(F.array_join(bodies, ""))

        names = F.array_distinct(F.transform(parts, lambda p: p["name"]))
        sections = F.transform(names, lambda n: F.struct(n.alias("name"), body_of(n).alias("text")))
        return F.filter(sections, lambda s: s["text"] != "")

    whole = F.array(F.struct(F.lit(0).alias("ord"), F.lit("full_text").alias("name"), text.alias("text")))
    return let(
        let(parts, merged),
        lambda kept: F.when(F.size(kept) <= 1, whole).otherwise(
            F.transform(
                kept, lambda s, i: F.struct(i.alias("ord"), s["name"].alias("name"), s["text"].alias("text"))
            )
        ),
    )


def split_references(section: Column) -> Column:
    """Entries of a reference list: numbered style, or name-year if that finds more."""
    numbered = _entries(F.split(section, r"\n(?=\[?\d{1,3}\]?[.\s])"))
    name_year = _entries(
        F.split(section, r"\n(?=[A-Z][\w\-À-ÿ]*[.,]?\s[^\n]{0,120}?(?:19|20)\d{2}\.)")
    )
    best = let(
        F.struct(numbered.alias("a"), name_year.alias("b")),
        lambda x: F.when(F.size(x["a"]) >= F.size(x["b"]), x["a"]).otherwise(x["b"]),
    )
    return F.when(F.coalesce(section, F.lit("")) == "", F.array().cast("array<string>")).otherwise(best)


def _entries(parts: Column) -> Column:
    cleaned = F.transform(parts, lambda e: F.replace(strip(e), F.lit("\n"), F.lit(" ")))
    return F.filter(cleaned, lambda e: e != "")


def split_sentences(text: Column) -> Column:
    """Sentences: a break follows . ! ? and white space before a capital or digit."""
    return F.filter(
        F.split(strip(text), r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: strip(s) != ""
    )


def tokens(text: Column) -> Column:
    """Word and punctuation tokens; leading blanks stay with their token."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens; additive over strings joined by white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def page_index(pages: Column) -> Column:
    """struct<text, ends>: the normalised pages joined by blanks, and where each one ends."""
    clean = F.transform(F.coalesce(pages, F.array().cast("array<string>")), collapse)
    ends = F.aggregate(
        F.transform(clean, lambda page: F.length(page) + 1),
        F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n).cast("int"))),
    )
    return F.struct(F.array_join(clean, " ").alias("text"), ends.alias("ends"))


def locate_page(text: Column, index: Column) -> Column:
    """1-based page on which the first 40 normalised characters of a text begin; null if nowhere."""
    snippet = F.substring(collapse(text), 1, 40)
    return let(
        F.when(snippet != "", F.instr(index["text"], snippet) - 1),
        lambda at: F.when(at >= 0, F.size(F.filter(index["ends"], lambda end: end <= at)) + 1),
    )


def truncate_section(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("\n[truncated]"))
    )


def section_pieces(text: Column, limit: int) -> Column:
    """A text as pieces of at most ``limit`` characters, cut at white space where there is any; together they hold all words."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\S.{{0,{limit - 1}}}(?!\S)|\S{{{limit}}}"), F.lit(0))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pieces)


def scrub_preamble(text: Column, title: Column) -> Column:
    """Remove the title's first occurrence and all e-mail addresses; trim."""
    at = F.instr(text, title)
    without = F.when(
        (F.coalesce(title, F.lit("")) != "") & (at > 0),
        F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(title), F.length(text))),
    ).otherwise(text)
    without = F.regexp_replace(without, r"(?U)\{[\w\s,]+\}@[\w.]+", "")
    return strip(F.regexp_replace(without, r"(?U)[\w.]+@[\w.]+\.\w+", ""))


def word_count(text: Column) -> Column:
    clean = collapse(text)
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " ")))


def is_trivial_claim(text: Column, min_words: int = 5) -> Column:
    return (word_count(text) < min_words) & ~text.rlike("(?i)" + VERB_HINT)


def arxiv_id(identifier: Column) -> Column:
    """New or old style identifier found anywhere in an id, URL or file name."""
    bare = F.regexp_replace(strip(identifier), r"(?i)\.pdf$", "")
    found = F.regexp_extract(
        bare, r"(?i)(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[A-Za-z]{2})?/\d{7}(?:v\d+)?)", 1
    )
    return F.nullif(found, F.lit(""))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|br|h[1-6]|li|div|article|nav|ul|title)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(text, r"[ \t]*\n\s*", "\n"))


def says_yes(reply: Column) -> Column:
    """True if the first non-blank line of a reply contains "yes"."""
    lines = F.filter(F.split(strip(reply), r"\r\n|[\n\r]"), lambda x: strip(x) != "")
    return F.coalesce(F.lower(F.get(lines, F.lit(0))).contains("yes"), F.lit(False))


def claim_key(paper_id: Column, text: Column) -> Column:
    """Content key of a claim: paper and case- and blank-insensitive text."""
    return F.substring(F.sha2(F.concat_ws(":", paper_id, collapse(F.lower(text))), 256), 1, 24)
