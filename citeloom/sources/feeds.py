"""arXiv metadata and evaluation sets, from documents already fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import collapse, let, strip


_FEED = (
    "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>"
)


def atom_metadata(xml: Column) -> Column:
    """struct<title,authors,abstract,year> of the first entry; null if it is an error or has no title."""
    parsed = F.from_xml(xml, _FEED, {"ignoreNamespace": "true"})
    return let(
        F.get(parsed["entry"], F.lit(0)),
        lambda e: F.when(
            (F.coalesce(e["title"], F.lit("")) != "")
            & ~F.coalesce(F.contains(e["id"], F.lit("api/errors")), F.lit(False)),
            F.struct(
                collapse(e["title"]).alias("title"),
                F.filter(
                    F.transform(
                        F.coalesce(e["author"], F.array().cast("array<struct<name:string>>")),
                        lambda a: strip(F.coalesce(a["name"], F.lit(""))),
                    ),
                    lambda n: n != "",
                ).alias("authors"),
                F.nullif(collapse(e["summary"]), F.lit("")).alias("abstract"),
                F.substring(e["published"], 1, 4).try_cast("int").alias("year"),
            ),
        ),
    )


def evaluation_set(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(papers, questions) of JSON evaluation files: one object per file, or one per line."""
    whole = spark.read.option("multiLine", multi_line).json(path)
    return whole.select(F.inline("papers")), whole.select(F.inline("questions"))
