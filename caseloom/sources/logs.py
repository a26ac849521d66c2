"""Tables as event logs (the event table used by every operator)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.plans.slices import positions

EVENT_COLUMNS = ["case_id", "pos", "activity", "ts", "lifecycle", "instance", "resource", "attrs"]


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One parquet table; timestamps without zone are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{table}.parquet")


def as_log(df: DataFrame, case: Column | str, activity: Column | str, ts: Column | str,
           tiebreak: list[str], keep: list[str] | None = None) -> DataFrame:
    """Any table as an event log, numbered by (ts, tiebreak) within the case.

    ``keep`` names further columns to carry; ``tiebreak`` columns must make the
    order total and are carried too.
    """
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    carried = list(dict.fromkeys([*tiebreak, *(keep or [])]))
    base = df.select(F.coalesce(col(case).cast("string"), F.lit("")).alias("case_id"),
                     F.coalesce(col(activity), F.lit("")).alias("activity"), col(ts).cast("timestamp").alias("ts"), *carried)
    return positions(base, ["case_id"], ["ts", *tiebreak], "pos").select("case_id", "pos", "activity", "ts", *carried)


def as_sequence(df: DataFrame, case: Column | str, activity: Column | str, order: str,
                keep: list[str] | None = None) -> DataFrame:
    """An event log without timestamps: numbered by a numeric ``order`` column."""
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    base = df.select(F.coalesce(col(case).cast("string"), F.lit("")).alias("case_id"),
                     F.coalesce(col(activity), F.lit("")).alias("activity"), F.col(order), *(keep or []))
    return positions(base, ["case_id"], [order, *(keep or [])], "pos")


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a log: one case per user and day."""
    events = load(spark, folder, "events")
    return as_log(events, F.concat_ws("|", "user_id", F.to_date("ts").cast("string")),
                  "event_type", "ts", ["event_id"], ["user_id", "value"])


def shipments_log(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` with ``lineitem`` as a log whose recorded order is the line
    number, while the timestamps (ship dates) are not sorted.  Both tables meet
    by case, so the numbers of a case need no further shuffle."""
    lines = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("activity"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity")
    orders = load(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_orderdate").cast("timestamp").alias("ordered"))
    joined = lines.join(orders, "case_id").select(
        "case_id", "activity", "ts", "ordered", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "ts"]
    return positions(joined, ["case_id"], order, "pos", counted=lines.select("case_id"))


def conversations_log(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` as a log without timestamps."""
    turns = load(spark, folder, "conversations").select("conv_id", "turn", "role")
    return as_sequence(turns, "conv_id", "role", "turn")
