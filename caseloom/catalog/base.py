"""Registry of runnable queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, folder)``; ``covers`` names the inventory items."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# events as a log: one case per user and day
LOG = """WITH log AS (
  SELECT user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS case_id, event_id, user_id,
         event_type AS activity, ts, epoch_us(ts) // 1000 AS ms, value,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos
  FROM events),
seqs AS (SELECT case_id, count(*) AS n_events, string_agg(activity, ', ' ORDER BY pos) AS seq,
         min(ts) AS start_ts, max(ts) AS end_ts, min(ms) AS t0, max(ms) AS t1 FROM log GROUP BY case_id),
cases AS (SELECT *, row_number() OVER (ORDER BY start_ts, case_id) AS case_index FROM seqs),
steps AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY case_id ORDER BY pos), 0) AS duration,
          lag(activity) OVER (PARTITION BY case_id ORDER BY pos) AS prev,
          lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS next,
          lead(ms) OVER (PARTITION BY case_id ORDER BY pos) - ms AS gap FROM log)
"""

# orders with lineitem as a log in recorded (line number) order
SHIP = """WITH ship AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity,
         l_shipdate AS ts, epoch_us(l_shipdate) // 1000 AS ms, o_orderdate AS ordered,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_quantity, l_shipdate) AS pos,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

# conversations as a log without timestamps
TALK = """WITH talk AS (
  SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS activity,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
  FROM conversations)
"""


def uniform_sql(seed: int, salt: str, *keys: str) -> str:
    """The number of ``plans.fingerprint.uniform`` in SQL."""
    parts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', {parts})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"
