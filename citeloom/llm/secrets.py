"""Scan for secrets whose parts lie apart: identifiers, secret values and endpoints, linked within scopes.

DataFrame and SQL functions only. A text is read once; what follows moves offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import written

SCOPE = 250  # code points between the starts of parts that belong together

_VALUE = "[\"']?\\x20*[:=]\\x20*[\"']?"
# Fixed patterns of the base kinds; the group of `assign` is the value.
BASE = {
    "assign": f"(?i)(password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
# Candidates that count only beside complementary parts. Repeats are bounded where a start may fail, so long runs cost no more.
WEAK = {
    "login": f"(?i)(user_?name|user_?id|user|login|client_?id|account){_VALUE}([A-Za-z0-9+/_.=@-]+)",
    "opaque": "[A-Za-z0-9+/_-]{20,}",
    "endpoint": "[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\\x20\\x09-\\x0D\"'<>]+",
}
KINDS = (*BASE, *WEAK)
# What every match of a kind holds: texts without it are not searched.
SIGNS = {"assign": (":", "="), "login": (":", "="), "access": ("AKIA",), "endpoint": ("://",)}
IDENTIFIER, SECRET = ("access", "login"), ("assign", "hex", "opaque")


def _holds(kind: str, match: Column) -> Column:
    """What a match must satisfy beyond its pattern."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, BASE[kind], 2)) >= 6
    if kind == "login":
        return F.length(F.regexp_extract(match, WEAK[kind], 2)) >= 3
    if kind == "opaque":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.length(match) >= {"access": 20, "hex": 24, "endpoint": 1}[kind]


def _pattern(kind: str) -> str:
    # hex digits fill most words: runs too short are left out by the pattern, which finds the same long ones
    return "[0-9a-f]{24,}" if kind == "hex" else (BASE | WEAK)[kind]


def _matched(kind: str) -> Column:
    found = F.regexp_extract_all("text", F.lit(_pattern(kind)), F.lit(0))
    if kind not in SIGNS:
        return found
    possible = F.lit(False)
    for sign in SIGNS[kind]:
        possible = possible | F.contains(F.col("text"), F.lit(sign))
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, parts): every row's matches as (kind, at, gap, size, holds), written.

    ``gap`` is the length of text between a match and the one of its kind before
    it. Every row has one part without kind, so that none is lost when parts are
    taken one by one. Null texts are empty. The table is written because row
    numbers are given while reading.
    """
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = found.select("*", *[_matched(k).alias(f"m_{k}") for k in KINDS])

    def parts(kind: str) -> Column:
        # the text between matches, cut only where there are any
        gaps = F.when(F.size(f"m_{kind}") > 0, F.split("text", _pattern(kind), -1))
        zipped = F.zip_with(f"m_{kind}", F.transform(gaps, F.length), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        kept = F.slice(zipped, F.lit(1), F.size(f"m_{kind}"))
        return F.when(F.size(f"m_{kind}") > 0, F.transform(kept, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("long").alias("at"), x["g"].cast("long").alias("gap"),
            F.length(x["m"]).cast("long").alias("size"), _holds(kind, x["m"]).alias("holds")))).otherwise(F.array())

    none = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("gap"),
                            F.lit(0).cast("long").alias("size"), F.lit(True).alias("holds")))
    return written(hits.select("row", "doc_id", F.concat(none, *[parts(k) for k in KINDS]).alias("parts")), "secret-parts")


def spans(parts: DataFrame) -> DataFrame:
    """(row, kind, start, end) of matches that hold, in code points; end exclusive.

    Weak matches that overlap a base one are left out: the base span says it already.
    """
    # one shuffle by text serves all windows; what meets in a task are offsets of single texts
    each = parts.where(F.size("parts") > 1).select("row", F.inline("parts")).where(F.col("kind").isNotNull()).repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = (each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).where("holds")
              .select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end"))
    base = F.col("kind").isin(*BASE)
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    free = (placed.withColumn("_left", F.max(F.when(base, F.col("end"))).over(before))
            .withColumn("_right", F.min(F.when(base, F.col("start"))).over(after)))
    overlaps = F.coalesce(F.col("_left") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_right") < F.col("end"), F.lit(False))
    return free.where(base | ~overlaps).drop("_left", "_right")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that complementary parts of their scope confirm.

    Scopes are met by an interval join on a grid: a cell holds, per part, the
    first and last start; a candidate meets its own cell and both neighbours, as one
    row. So a text full of parts makes no pairs. An identifier needs a base
    secret, a secret a base identifier; a weak one of the other side does only
    with an endpoint in scope. An endpoint needs an identifier and a secret.
    """
    roles = {"id": F.col("kind") == "access", "weak_id": F.col("kind") == "login", "secret": F.col("kind").isin("assign", "hex"),
             "weak_secret": F.col("kind") == "opaque", "endpoint": F.col("kind") == "endpoint"}
    cell = F.floor(F.col("start") / scope)
    cells = found.groupBy("row", cell.alias("cell")).agg(
        *[f(F.when(c, F.col("start"))).alias(f"{n}_{r}") for r, c in roles.items() for n, f in (("first", F.min), ("last", F.max))])
    moved = cells.select("row", F.explode(F.array(*[F.struct((F.col("cell") + d).alias("cell"), F.lit(d).alias("d")) for d in (-1, 0, 1)])).alias("to"), *[c for c in cells.columns if c not in ("row", "cell")])
    step = F.col("to.d")
    around = moved.groupBy("row", F.col("to.cell").alias("cell")).agg(
        *[F.max(F.when((step == 0) & F.col(f"first_{r}").isNotNull(), True)).alias(f"own_{r}") for r in roles],
        *[F.min(F.when(step == -1, F.col(f"first_{r}"))).alias(f"next_{r}") for r in roles],
        *[F.max(F.when(step == 1, F.col(f"last_{r}"))).alias(f"prior_{r}") for r in roles])

    def near(role: str) -> Column:
        reach = F.coalesce(F.col(f"next_{role}") - F.col("start") <= scope, F.lit(False)) | F.coalesce(F.col("start") - F.col(f"prior_{role}") <= scope, F.lit(False))
        return F.coalesce(F.col(f"own_{role}"), F.lit(False)) | reach

    confirmed = (F.when(F.col("kind") == "login", near("secret") | (near("weak_secret") & near("endpoint")))
                 .when(F.col("kind") == "opaque", near("id") | (near("weak_id") & near("endpoint")))
                 .otherwise((near("id") | near("weak_id")) & (near("secret") | near("weak_secret"))))
    weak = found.where(F.col("kind").isin(*WEAK)).withColumn("cell", cell)
    return weak.join(around, ["row", "cell"]).where(confirmed).select("row", "kind", "start", "end")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: ``found``, its spans (start, rank of the kind, end, kind), in order.

    Base spans always, weak ones where their scope confirms them. Null and empty
    texts and an empty table have no spans; repeated rows are scanned for
    themselves. Other columns of the table are not read. Documents without any match
    pass by the shuffles.
    """
    parts = matches(docs)
    all_spans = written(spans(parts), "secret-spans")
    reported = all_spans.where(F.col("kind").isin(*BASE)).unionByName(linked(all_spans, scope))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    each = F.struct("start", rank.alias("rank"), "end", "kind")
    grouped = reported.groupBy("row").agg(F.sort_array(F.collect_list(each)).alias("found"))
    kind_of = grouped.schema["found"].dataType.simpleString()
    some = parts.where(F.size("parts") > 1).select("row", "doc_id").join(grouped, "row", "left")
    none = parts.where(F.size("parts") <= 1).select("doc_id", F.lit(None).cast(kind_of).alias("found"))
    return some.select("doc_id", "found").unionByName(none).withColumn("found", F.coalesce("found", F.array().cast(kind_of)))


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, their SHA-256, and all spans as text."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))

    def text(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
