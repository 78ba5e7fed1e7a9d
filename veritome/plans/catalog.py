"""All queries over the reference's own operators, with their oracles."""

from __future__ import annotations

from veritome.plans import authority_queries, blocker_queries, index_queries, inventory_queries, knowledge_queries, match_run_queries, matching_queries, quality_queries, scalar_queries, snapshot_queries, source_queries, state_queries, stream_queries  # noqa: F401  they register themselves
from veritome.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
