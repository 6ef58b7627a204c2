"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_STR, _INT, _DBL, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

PAPERS = _s(
    ("paper_id", _STR), ("title", _STR), ("authors", T.ArrayType(_STR)), ("year", _INT),
    ("venue", _STR), ("arxiv_id", _STR), ("doi", _STR), ("abstract", _STR), ("pdf_path", _STR),
    ("content_hash", _STR), ("raw_text", _STR),
    ("sections", T.ArrayType(_s(("ord", _INT), ("name", _STR), ("text", _STR)))),
    ("ingestion_status", _STR), ("collection_id", _STR), ("created_at", _TS), ("updated_at", _TS),
)
COLLECTIONS = _s(("collection_id", _STR), ("name", _STR), ("description", _STR), ("created_at", _TS))
JOBS = _s(
    ("job_id", _STR), ("paper_id", _STR), ("status", _STR), ("entities_found", _INT),
    ("relations_found", _INT), ("error_message", _STR), ("started_at", _TS),
    ("completed_at", _TS), ("created_at", _TS),
)
QUERY_LOG = _s(
    ("query_log_id", _STR), ("query_text", _STR), ("graphrag_answer", _STR),
    ("vanilla_answer", _STR), ("retrieved_nodes", T.ArrayType(_STR)), ("user_feedback", _STR),
    ("compare_verdict", _STR), ("latency_ms", _INT), ("created_at", _TS),
)
NODES = _s(
    ("node_id", _STR), ("label", _STR), ("name", _STR), ("title", _STR), ("text", _STR),
    ("paper_id", _STR), ("source_paper_id", _STR), ("collection_id", _STR), ("year", _INT),
    ("venue", _STR), ("abstract", _STR), ("description", _STR), ("category", _STR), ("domain", _STR),
    ("claim_type", _STR), ("confidence", _DBL),
)
EDGES = _s(
    ("src", _STR), ("dst", _STR), ("rel_type", _STR), ("confidence", _DBL),
    ("evidence_text", _STR), ("metric", _STR), ("value", _STR), ("dataset", _STR),
    ("margin", _STR), ("occurrence_count", T.LongType()),
)
CHUNKS = _s(
    ("chunk_id", _STR), ("paper_id", _STR), ("section_name", _STR), ("chunk_index", _INT),
    ("page_number", _INT), ("text", _STR), ("collection_id", _STR),
)

# The states of the enumerated columns.
INGESTION_STATUS = ("pending", "processing", "completed", "failed")
JOB_STATUS = (
    "queued", "parsing", "chunking", "embedding", "extracting_entities",
    "extracting_relations", "resolving_entities", "writing_graph", "completed", "failed",
)
VERDICTS = ("vanilla", "graphrag", "tie_good", "tie_bad")
