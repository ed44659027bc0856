"""Query name to Spark builder and SQL."""

from __future__ import annotations

from strandmill.plans import block_queries, cluster_queries, interval_queries, model_queries, naming_queries, relational_queries, sequence_queries, source_queries, stat_queries, table_queries  # noqa: F401
from strandmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
