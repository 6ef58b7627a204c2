"""Chunking of sectioned papers, inside each paper's row.

Sentences, token counts and chunk texts are JVM expressions; the packing helper
sees only token counts. Chunk numbers follow from the position in the exploded
array, so nothing is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import locate_page, page_index, split_sentences, token_count, tokens
from citeloom.settings import DEFAULTS


def pack(counts: list[int], size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Greedy packing of sentences: (first, end, token_from, token_to) per chunk.

    token_from is -1 for a chunk of whole sentences. A sentence above the size
    is cut by tokens. A full chunk hands its last sentences (about ``overlap``
    tokens, at least one) to the next, unless they leave no room.
    """
    out: list[tuple[int, int, int, int]] = []
    first = total = 0
    for i, n in enumerate(counts):
        if n > size:
            if i > first:
                out.append((first, i, -1, -1))
            out += [(i, i + 1, at, min(at + size, n)) for at in range(0, n, size)]
            first, total = i + 1, 0
            continue
        if total + n > size:
            out.append((first, i, -1, -1))
            start, carried = i - 1, counts[i - 1]
            while start > first and carried + counts[start - 1] <= overlap:
                start -= 1
                carried += counts[start]
            first, total = (start, carried) if carried + n <= size else (i, 0)
        total += n
    if len(counts) > first:
        out.append((first, len(counts), -1, -1))
    return out


def _packer(size: int, overlap: int):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def run(sections: pd.Series) -> pd.Series:
        return pd.Series([
            [[s, *piece] for s, counts in enumerate(paper) for piece in pack([int(c) for c in counts], size, overlap)]
            for paper in sections
        ])

    return run


def chunk_papers(
    papers: DataFrame, size: int = DEFAULTS.chunk_tokens, overlap: int = DEFAULTS.overlap_tokens,
    count=token_count, cut=tokens,
) -> DataFrame:
    """papers(paper_id, sections[, pages, tables, collection_id]) to schema.CHUNKS.

    sections: array<struct<ord,name,text>>; pages: array<string>; tables:
    array<struct<page_number,markdown>>, each of which becomes one chunk.
    ``count``/``cut`` swap the tokenizer.
    """
    for name, kind in (("pages", "array<string>"), ("tables", "array<struct<page_number:int,markdown:string>>"),
                       ("collection_id", "string")):
        if name not in papers.columns:
            papers = papers.withColumn(name, F.lit(None).cast(kind))
    split = papers.withColumn(
        "parts", F.transform("sections", lambda s: F.struct(s["name"].alias("name"), split_sentences(s["text"]).alias("sentences")))
    ).withColumn("page_index", page_index(F.col("pages")))
    packed = split.withColumn(
        "pieces", _packer(size, overlap)(F.transform("parts", lambda p: F.transform(p["sentences"], lambda s: count(s).cast("int"))))
    )

    def piece_text(piece):
        sentences = F.get(F.col("parts"), piece[0])["sentences"]
        whole = F.array_join(F.slice(sentences, piece[1] + 1, piece[2] - piece[1]), " ")
        part = F.array_join(F.slice(cut(F.get(sentences, piece[1])), piece[3] + 1, piece[4] - piece[3]), "")
        return F.when(piece[3] < 0, whole).otherwise(part)

    texts = F.transform(
        F.transform("pieces", lambda p: F.struct(F.get(F.col("parts"), p[0])["name"].alias("section_name"), piece_text(p).alias("text"))),
        lambda c: F.struct(
            c["section_name"].alias("section_name"), c["text"].alias("text"),
            locate_page(c["text"], F.col("page_index")).alias("page_number"),
        ),
    )
    of_tables = F.transform(
        F.coalesce("tables", F.array().cast("array<struct<page_number:int,markdown:string>>")),
        lambda t: F.struct(F.lit("table").alias("section_name"), t["markdown"].alias("text"), t["page_number"].alias("page_number")),
    )
    numbered = packed.select("paper_id", "collection_id", F.posexplode(F.concat(texts, of_tables)).alias("chunk_index", "c"))
    return numbered.select(
        F.concat_ws("_", "paper_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "paper_id",
        "c.section_name", "chunk_index", "c.page_number", "c.text", "collection_id",
    )
