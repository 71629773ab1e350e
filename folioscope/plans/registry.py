"""Names of the queries of the engine proper: each operator over the driver tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import index_queries, naming_queries, search_queries, table_queries, workflow_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (index_queries, naming_queries, search_queries, table_queries, workflow_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
