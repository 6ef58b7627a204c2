"""Reading model replies: JSON recovery, typed rows, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import strip

# Claim and relation vocabularies.
CLAIM_TYPES = ("RESULT", "HYPOTHESIS", "LIMITATION", "FUTURE_WORK")
WITHIN_TYPES = (
    "USES_METHOD", "EVALUATES_ON", "TRAINED_ON", "INTRODUCES", "DISTILLED_FROM", "REPORTS_RESULT",
)
ACROSS_TYPES = ("EXTENDS", "OUTPERFORMS", "CONTRADICTS", "CITES")

def recover_json(raw: Column) -> Column:
    """JSON object text from a reply: fence removed, else the outermost braces; null if neither parses."""
    text = strip(raw)
    fenced = F.regexp_extract(text, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    body = F.when(text.rlike(r"(?s)^```(?:json)?\s*(.*?)\s*```$"), fenced).otherwise(text)
    outer = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return (
        F.when(F.try_parse_json(body).isNotNull(), body)
        .when((outer != "") & F.try_parse_json(outer).isNotNull(), outer)
    )


def confidence(value: Column) -> Column:
    """Clamp to [0, 1]; anything that is no number counts as 0."""
    number = value.try_cast("double")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    # min(1.0, nan) keeps the bound, so NaN clamps to 1
    return F.when(number.isNull(), F.lit(0.0)).when(F.isnan(number), F.lit(1.0)).otherwise(clamped)


def reply_items(reply: Column, field: str) -> Column:
    """array<variant> listed under ``field`` of the recovered object; empty if absent."""
    listed = F.try_variant_get(F.try_parse_json(recover_json(reply)), f"$.{field}", "array<variant>")
    return F.coalesce(listed, F.array().cast("array<variant>"))


def item_text(item: Column, key: str) -> Column:
    """Trimmed text of a field; "" if absent or the item is no object."""
    return strip(F.coalesce(F.try_variant_get(item, f"$.{key}", "string"), F.lit("")))


def item_extras(item: Column, known: tuple[str, ...]) -> Column:
    """The item's other fields as a string map, nulls left out."""
    fields = F.try_variant_get(item, "$", "map<string,string>")
    return F.map_filter(fields, lambda k, v: ~k.isin(*known) & v.isNotNull())
