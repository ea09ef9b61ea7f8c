"""Registration of queries, and SQL fragments shared by their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# The triple views of sources.tables, for the checks.
EVENTS = """ev AS (
  SELECT 'U' || user_id AS subj, event_type AS pred,
         CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS obj, event_id AS seq
  FROM events)"""

STAR = """star AS (
  SELECT 'N' || n_nationkey AS subj, 'inRegion' AS pred, 'R' || n_regionkey AS obj FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'inNation', 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'C' || c_custkey, 'segment', c_mktsegment FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'inNation', 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 'O' || o_orderkey, 'placedBy', 'C' || o_custkey FROM orders
  UNION ALL SELECT 'O' || o_orderkey, 'status', o_orderstatus FROM orders
  UNION ALL SELECT 'O' || l_orderkey, 'soldBy', 'S' || l_suppkey FROM lineitem
  UNION ALL SELECT 'O' || l_orderkey, 'hasPart', 'P' || l_partkey FROM lineitem
  UNION ALL SELECT 'P' || p_partkey, 'brand', p_brand FROM part
  UNION ALL SELECT 'P' || p_partkey, 'type', p_type FROM part)"""

UNIVERSE = """uni AS (
  SELECT s.subj, p.pred, CAST(p_partkey AS VARCHAR) AS obj
  FROM part, (VALUES ('A'), ('B'), ('C')) s(subj), (VALUES ('foo'), ('bar')) p(pred))"""
