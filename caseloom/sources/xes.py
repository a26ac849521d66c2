"""XES event logs (XML, plain or gzip) as event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Attribute keys of the event-log standard.
NAME = "concept:name"
INSTANCE = "concept:instance"
LIFECYCLE = "lifecycle:transition"
RESOURCE = "org:resource"
TIMESTAMP = "time:timestamp"
LOCATION = "location:room"
KNOWN = [NAME, INSTANCE, LIFECYCLE, RESOURCE, TIMESTAMP]
KINDS = ["string", "date", "int", "float", "boolean"]

PART = "trace:offset"
TRACE_ROWS = 100_000

_PAIRS = "array<struct<_key:string,_value:string>>"
_ATTRIBUTES = ",".join(f"`{k}`:{_PAIRS}" for k in KINDS)
SCHEMA = ", ".join(f"`{k}` {_PAIRS}" for k in KINDS) + f", event array<struct<{_ATTRIBUTES}>>"


def _all(prefix: str) -> Column:
    empty = F.array().cast(_PAIRS)
    return F.concat(*[F.coalesce(F.col(f"{prefix}`{k}`"), empty) for k in KINDS])


def _value(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["_key"] == key), F.lit(0))["_value"]


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """Event table of one XES file or a folder of them.

    Unknown event attributes go to ``attrs``.  A case written in several
    ``trace`` elements carries their offsets and is numbered through.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").schema(SCHEMA).load(path)
    about = traces.select(_all("").alias("_about"), F.posexplode("event").alias("_i", "event"))
    events = about.select(
        F.coalesce(_value(F.col("_about"), NAME), F.lit("")).alias("case_id"),
        (F.coalesce(_value(F.col("_about"), PART).cast("bigint"), F.lit(0)) + F.col("_i") + 1).alias("pos"),
        _all("event.").alias("_has"))
    has = F.col("_has")
    rest = F.filter(has, lambda p: ~p["_key"].isin(KNOWN) & p["_key"].isNotNull())
    keys = F.array_distinct(F.transform(rest, lambda p: p["_key"]))
    attrs = F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(
        F.filter(has, lambda p: p["_key"] == k), F.lit(0))["_value"]))
    return events.select(
        "case_id", "pos", F.coalesce(_value(has, NAME), F.lit("")).alias("activity"),
        _value(has, TIMESTAMP).cast("timestamp").alias("ts"), _value(has, LIFECYCLE).alias("lifecycle"),
        _value(has, INSTANCE).alias("instance"), _value(has, RESOURCE).alias("resource"), attrs.alias("attrs"))


def read_xes_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case-level attributes: ``case_id, key, value``."""
    traces = spark.read.format("xml").option("rowTag", "trace").schema(SCHEMA).load(path)
    about = traces.select(_all("").alias("_about"))
    return about.select(F.coalesce(_value(F.col("_about"), NAME), F.lit("")).alias("case_id"),
                        F.explode("_about").alias("a")).select(
        "case_id", F.col("a._key").alias("key"), F.col("a._value").alias("value")).where(
            ~F.col("key").isin(NAME, PART)).distinct()


def _pair(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value")))


def write_xes(log: DataFrame, path: str) -> None:
    """Write an event table as XES files.

    A ``trace`` element holds at most ``TRACE_ROWS`` events, so no row grows
    with the case; longer cases become several elements with an offset.
    """
    have = set(log.columns)
    columns = [(NAME, "activity"), (LIFECYCLE, "lifecycle"), (INSTANCE, "instance"), (RESOURCE, "resource")]
    pairs = [F.array_compact(F.array(*[_pair(k, F.col(c)) for k, c in columns if c in have]))]
    if "attrs" in have:
        entries = F.transform(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))),
                              lambda e: F.struct(e["key"].alias("_key"), e["value"].alias("_value")))
        pairs.append(F.filter(entries, lambda p: p["_value"].isNotNull()))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    event = F.struct("pos", F.struct(F.concat(*pairs).alias("string"),
                                     F.array_compact(F.array(_pair(TIMESTAMP, stamp))).alias("date")).alias("e"))
    offset = F.expr(f"((pos - 1) div {TRACE_ROWS}) * {TRACE_ROWS}")
    traces = log.groupBy("case_id", offset.alias("_offset")).agg(F.array_sort(F.collect_list(event)).alias("_events"))
    rows = traces.select(
        F.array(_pair(NAME, F.col("case_id"))).alias("string"),
        F.when(F.col("_offset") > 0, F.array(_pair(PART, F.col("_offset")))).alias("int"),
        F.transform("_events", lambda e: e["e"]).alias("event"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)
