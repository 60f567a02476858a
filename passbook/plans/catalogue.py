"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dialect_queries, document_queries, label_queries, layout_queries, ledger_queries, line_queries, page_queries, report_queries

_PARTS = (ledger_queries, dialect_queries, document_queries, label_queries, layout_queries, line_queries, page_queries, report_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
