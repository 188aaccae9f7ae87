"""All queries for the operators of the survey, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import catalog_queries, control_queries, dashboard_queries, metric_queries, retrieval_queries, source_queries, workbook_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
