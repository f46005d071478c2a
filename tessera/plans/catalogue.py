"""All registered queries of the reference's operators."""

from __future__ import annotations

from tessera.plans import board_queries, flow_queries, report_queries, retrieval_queries, scalar_queries, state_queries, text_queries, view_queries  # noqa: F401  they register
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
