"""Named queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import code_queries, control_queries, graph_queries, history_queries, index_queries, record_queries, report_queries, text_queries, view_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = graph_queries.QUERIES | text_queries.QUERIES | record_queries.QUERIES | report_queries.QUERIES | control_queries.QUERIES | code_queries.QUERIES | index_queries.QUERIES | history_queries.QUERIES | view_queries.QUERIES
ORACLES: dict[str, str] = graph_queries.ORACLES | text_queries.ORACLES | record_queries.ORACLES | report_queries.ORACLES | control_queries.ORACLES | code_queries.ORACLES | index_queries.ORACLES | history_queries.ORACLES | view_queries.ORACLES
