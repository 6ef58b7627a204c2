"""Uploaded files: scan, validation, duplicate detection, parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import html_text, split_references, split_sections
from citeloom.settings import DEFAULTS

PARSED = (
    "path string, full_text string, pages array<string>, title string, authors array<string>, "
    "tables array<struct<page_number:int,markdown:string>>, "
    "layout array<struct<size:double,text:string>>, error string"
)


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def rejection(content: Column, limit_mb: int | None = None, length: Column | None = None) -> Column:
    """Why a file is not accepted; null if it is. No size is too large unless a limit is named.

    ``length`` is the size as listed, where the source tells it.
    """
    head = F.when(F.substring(content, 1, 5) != F.lit(b"%PDF-"), F.lit("not a valid PDF (missing %PDF- header)"))
    if limit_mb is None:
        return head
    size = F.length(content) if length is None else length
    too_big = F.concat(F.format_string("%.1f", size / F.lit(1048576.0)), F.lit(f"MB exceeds the {limit_mb}MB limit"))
    return head.when(size > limit_mb * 1048576, too_big)


def upload(files: DataFrame, stored: DataFrame, order: Column, limit_mb: int | None = None) -> DataFrame:
    """files(batch_id, filename, content) with status queued, rejected or duplicate, and the reason.

    stored(content_hash, paper_id). Within the upload the first copy in
    ``order`` is queued. A batch may hold any number of files; a size limit holds
    only where one is named.
    """
    marked = (
        files.withColumn("content_hash", F.sha2("content", 256)).withColumn("error", rejection(F.col("content"), limit_mb)).drop("content")
    )
    first = (
        marked.filter(F.col("error").isNull()).groupBy("content_hash").agg(F.min(F.struct(order.alias("o"))).alias("first"))
    )
    joined = marked.join(first, "content_hash", "left").join(
        stored.select("content_hash", "paper_id"), "content_hash", "left"
    )
    return joined.select(
        "batch_id", "filename", "content_hash",
        F.when(F.col("error").isNotNull(), "rejected")
        .when(F.col("paper_id").isNotNull() | (F.col("first.o") != order), "duplicate").otherwise("queued").alias("status"),
        F.concat_ws(": ", F.when(F.col("error").isNotNull(), F.col("filename")), "error").alias("error"),
        "paper_id",
    ).withColumn("error", F.nullif("error", F.lit("")))


def parse(files: DataFrame, parser: Callable[[bytes], dict] | None = None) -> DataFrame:
    """Parse file contents, one row each; a failure becomes the row's ``error``.

    ``parser`` maps bytes to the fields of PARSED. The default needs PyMuPDF,
    which is imported on the workers. NUL characters are removed.
    """
    extract = parser or pdf_parser

    def clean(value):
        if isinstance(value, str):
            return value.replace("\x00", "")
        if isinstance(value, list):
            return [clean(v) for v in value]
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items()}
        return value

    kind = pa.schema([
        ("path", pa.string()), ("full_text", pa.string()), ("pages", pa.list_(pa.string())), ("title", pa.string()),
        ("authors", pa.list_(pa.string())),
        ("tables", pa.list_(pa.struct([("page_number", pa.int32()), ("markdown", pa.string())]))),
        ("layout", pa.list_(pa.struct([("size", pa.float64()), ("text", pa.string())]))), ("error", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                row = dict.fromkeys(kind.names)
                try:
                    row.update(clean(extract(content)))
                except Exception as error:  # a bad file never fails the batch
                    row["error"] = f"could not parse: {error}"
                rows.append(row | {"path": path})
            yield from pa.Table.from_pylist(rows, schema=kind).to_batches()

    return files.select("path", "content").mapInArrow(run, PARSED)


def pdf_parser(content: bytes) -> dict:
    """Pages, first-page layout lines and tables through PyMuPDF."""
    import fitz  # optional dependency

    with fitz.open(stream=content, filetype="pdf") as doc:
        pages = [page.get_text() for page in doc]
        lines = []
        if doc.page_count:
            for block in doc[0].get_text("dict")["blocks"]:
                for line in block.get("lines", []):
                    text = "".join(span["text"] for span in line["spans"]).strip()
                    upright = line.get("dir", (1, 0))[1] == 0
                    if upright and text:
                        lines.append({"size": float(max(span["size"] for span in line["spans"])), "text": text})
        tables = []
        for number, page in enumerate(doc, 1):
            finder = getattr(page, "find_tables", None)
            for table in (finder().tables if finder else []):
                tables.append({"page_number": number, "markdown": table.to_markdown()})
    return {"full_text": "\n".join(pages), "pages": pages, "layout": lines, "tables": tables}


def papers_from(parsed: DataFrame) -> DataFrame:
    """Parsed files with sections, references, and title and authors from the layout where missing."""
    from citeloom.functions.layout import authors_of, title_of

    good = parsed.filter(F.col("error").isNull())
    cut = good.withColumn("sections", split_sections(F.col("full_text")))
    refs = F.get(F.filter("sections", lambda s: s["name"] == "references"), F.lit(0))["text"]
    return (
        cut.withColumn("references", split_references(refs))
        .withColumn("authors", F.coalesce("authors", authors_of(F.col("layout"))))
        .withColumn("title", F.coalesce("title", title_of(F.col("layout"))))
    )


def html_papers(pages: DataFrame) -> DataFrame:
    """Web pages as papers: title from the page, text without markup, one page of text."""
    title = F.nullif(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), F.lit(""))
    return pages.select(
        F.col("page_id").cast("string").alias("paper_id"), title.alias("title"), html_text(F.col("html")).alias("text")
    ).withColumn("sections", split_sections(F.col("text"))).withColumn("pages", F.array("text"))
