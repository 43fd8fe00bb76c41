"""Queries of general data-quality operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recolta.operators import orphans as O
from recolta.sources.tables import table


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, name) for name in ("memory_nodes", "memory_edges", "items")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(*_tables(spark, d)).select("src_table", "src_column", "src_key", "reason").distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_counts(*_tables(spark, d))


_P3 = """
WITH v AS (
  SELECT memory_id, item_id, created_at, forgotten_at FROM memory_nodes WHERE memory_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, forgotten_at DESC NULLS LAST, item_id DESC NULLS LAST) = 1),
r AS (
  SELECT 'memory_edges' AS src_table, 'from_memory_id' AS src_column, edge_id AS src_key, 'm' AS kind, from_memory_id AS ref, created_at FROM memory_edges
  UNION ALL SELECT 'memory_edges', 'to_memory_id', edge_id, 'm', to_memory_id, created_at FROM memory_edges
  UNION ALL SELECT 'memory_nodes', 'item_id', memory_id, 'i', item_id, created_at FROM v),
t AS (
  SELECT 'm' AS kind, memory_id AS ref, created_at AS made_at, forgotten_at AS gone_at FROM v
  UNION ALL SELECT 'i', id, min(captured_at), NULL FROM items WHERE id IS NOT NULL GROUP BY id),
o AS (
  SELECT DISTINCT src_table, src_column, src_key, r.created_at,
    CASE WHEN t.ref IS NULL THEN 'missing' WHEN made_at > r.created_at THEN 'late' WHEN gone_at <= r.created_at THEN 'deleted' END AS reason
  FROM r LEFT JOIN t ON r.kind = t.kind AND r.ref = t.ref WHERE r.ref IS NOT NULL AND r.ref <> '')
"""

QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
SQL = {
    "p3_found": _P3 + "SELECT DISTINCT src_table, src_column, src_key, reason FROM o WHERE reason IS NOT NULL",
    "p3_counts": _P3 + "SELECT src_table, src_column, reason, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL",
}
