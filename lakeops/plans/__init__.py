"""Registered queries of the warehouse operators."""

from lakeops.plans import changes, loading, more, relational, streams, tables, warehouse  # noqa: F401
from lakeops.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
