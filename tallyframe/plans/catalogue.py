"""All queries over the reference's operators, by name, and the DuckDB SQL of each."""

from __future__ import annotations

from tallyframe.plans import cover_queries, fact_queries, fiscal_queries, label_queries, report_queries, stream_queries, text_queries  # noqa: F401  registering is their effect
from tallyframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
