"""Queries over the driver's tables, with the SQL that gives the same rows."""

from . import cross_queries, join_queries, metric_queries, misc_queries, rolling_queries, stat_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
