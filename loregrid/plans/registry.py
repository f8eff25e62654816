"""The queries on the driver's tables, and their SQL."""

from __future__ import annotations

from . import auditing, queries, relational, windows

QUERIES = queries.QUERIES | auditing.QUERIES | relational.QUERIES | windows.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | auditing.ORACLE_SQL | relational.ORACLE_SQL | windows.ORACLE_SQL
