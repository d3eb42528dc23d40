"""Registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from tessel.query_sets import graph, history, problems, relational, retrieval, tables  # noqa: F401
from tessel.query_sets.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
