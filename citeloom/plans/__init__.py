"""All registered queries."""

from citeloom.plans import graph, ingestion, retrieval, text, writes  # noqa: F401
from citeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
