"""Tunable parameters. The values are fixed defaults of the retrieval contract."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # retrieval
    chunk_top_k: int = 10
    entity_top_k: int = 5
    hops: int = 2
    max_hops: int = 4
    alpha: float = 0.4
    beta: float = 0.4
    gamma: float = 0.2
    ranked_nodes: int = 20
    candidate_entities: int = 500
    search_limit: int = 20
    # context
    context_tokens: int = 8000
    chunk_reserve_tokens: int = 1500
    # ingestion
    chunk_tokens: int = 1000
    overlap_tokens: int = 200
    section_chars: int = 10_000
    entity_confidence: float = 0.5
    relation_confidence: float = 0.5
    fuzzy_threshold: float = 0.85
    embedding_threshold: float = 0.55
    claim_duplicate_threshold: float = 0.90
    claim_grounding: float = 40.0
    introduces_grounding: float = 70.0
    title_match: float = 85.0
    faithfulness_threshold: float = 0.6
    embedding_dimension: int = 384


DEFAULTS = Settings()

# Relation types a graph may hold, and the label orders used for
# tie-breaks (ranking) and for grouping (context).
RELATION_TYPES = (
    "AUTHORED_BY", "USES_METHOD", "EVALUATES_ON", "TRAINED_ON", "INTRODUCES",
    "DISTILLED_FROM", "REPORTS_RESULT", "EXTENDS", "OUTPERFORMS",
)
RANK_LABELS = ("Method", "Paper", "Dataset")
CONTEXT_LABELS = ("Method", "Dataset", "Paper", "Author", "Metric", "Claim")
SEARCH_LABELS = ("Paper", "Method", "Dataset", "Author", "Claim")


def effective_hops(hops: int | None, settings: Settings = DEFAULTS) -> int:
    """None and 0 mean the default; the result is clamped to 1..max_hops."""
    return max(1, min(settings.max_hops, hops or settings.hops))


def effective_k(k: int | None, default: int) -> int:
    """None and 0 mean the default."""
    return k or default
