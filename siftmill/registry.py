"""The registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftmill.plans import best_copy, chain_queries, detail_queries, history_queries, language_queries, posting_queries, table_queries

_MODULES = (best_copy, posting_queries, table_queries, chain_queries, detail_queries, language_queries, history_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
