"""All registered queries of the core and their DuckDB twins."""

from __future__ import annotations

from . import q_graph, q_kmers, q_stats  # noqa: F401
from .registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES", "query"]
