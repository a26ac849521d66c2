"""Queries that run a stream over the events and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog.base import LOG, query
from caseloom.catalog.likelihood import CUT, scored_steps
from caseloom.functions.maths import epoch_ms
from caseloom.operators.anomaly import ll_cutoffs
from caseloom.plans.lineage import stored
from caseloom.streaming import operators as st
from caseloom.streaming.run import append_to_folder, append_to_table, events_stream, updates_to_table


def r(col, digits=6):
    return F.round(col, digits)


# the watermark has millisecond resolution; windows up to it are closed
_MARK = "(SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)"


@query("stream_hourly_activity", "ST1", f"""SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS start_ms, event_type AS activity, count(*) AS n, round(avg(value), 6) AS mean_value
  FROM events GROUP BY 1, 2 HAVING epoch_us(date_trunc('hour', any_value(ts))) // 1000 + 3600000 <= {_MARK}""")
def _(spark, folder):
    rows = append_to_table(st.hourly_activity(events_stream(spark, folder)))
    return rows.select(epoch_ms("start").alias("start_ms"), "activity", "n", r("mean_value").alias("mean_value"))


@query("stream_sliding_activity", "ST2", f"""SELECT start_ms, activity, count(*) AS n, round(avg(value), 6) AS mean_value FROM (
    SELECT event_type AS activity, value, (epoch_us(ts) // 3600000000 - k) * 3600000 AS start_ms FROM events, generate_series(0, 5) t(k))
  GROUP BY 1, 2 HAVING start_ms + 6 * 3600000 <= {_MARK}""")
def _(spark, folder):
    rows = append_to_table(st.sliding_activity(events_stream(spark, folder)))
    return rows.select(epoch_ms("start").alias("start_ms"), "activity", "n", r("mean_value").alias("mean_value"))


@query("stream_sessions", "ST3", f"""WITH g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
  SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS n FROM g GROUP BY user_id, s
  HAVING epoch_us(max(ts)) + 1800000000 <= {_MARK} * 1000""")
def _(spark, folder):
    rows = append_to_table(st.sessions(events_stream(spark, folder), "user_id"))
    return rows.select("user_id", epoch_ms("start").alias("start_ms"), epoch_ms("last").alias("last_ms"), "n")


@query("stream_running_normal", "ST4", """SELECT event_type AS activity, count(*) AS n, round(avg(value - 40), 6) AS mean, round(var_pop(value - 40), 4) AS var_pop,
  round(var_samp(value - 40), 4) AS var_samp, count(*) FILTER (value < 40) AS n_negative FROM events GROUP BY 1""")
def _(spark, folder):
    stream = events_stream(spark, folder).withColumn("value", F.col("value") - 40)
    rows = updates_to_table(st.running_normal(stream), ["activity"])
    return rows.select("activity", "n", r("mean").alias("mean"), r("var_pop", 4).alias("var_pop"),
                       r("var_samp", 4).alias("var_samp"), "n_negative")


@query("stream_rolling_forecast", "ST5", f"""WITH o AS (SELECT event_type AS activity, epoch_us(ts) // 3600000000 AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2
    HAVING (epoch_us(any_value(ts)) // 3600000000 + 1) * 3600000 <= {_MARK}),
  b AS (SELECT a.activity, a.h, a.n, min(p.h) AS fh, arg_min(p.n, p.h) AS fv, count(*) AS k FROM o a JOIN o p ON p.activity = a.activity AND p.h <= a.h AND p.h > a.h - 672 GROUP BY 1, 2, 3)
  SELECT activity, h * 3600000 AS at_ms, n AS naive, round(CASE WHEN h > fh THEN greatest(0, n + (n - fv) / (h - fh)) ELSE n END, 6) AS drift, CAST(k AS INTEGER) AS history FROM b""")
def _(spark, folder):
    counts = st.hourly_activity(events_stream(spark, folder)).select("activity", F.col("start").alias("at"), "n")
    hours = spark.readStream.schema(counts.schema).parquet(append_to_folder(counts))
    rows = append_to_table(st.rolling_forecast(hours))
    return rows.select("activity", epoch_ms("at").alias("at_ms"), "naive", r("drift").alias("drift"), "history")


@query("stream_outlier_flags", "ST6", LOG + CUT + "SELECT event_id, activity, round(ld, 5) AS log_density, is_outlier FROM marked")
def _(spark, folder):
    scored, dists = scored_steps(spark, folder)
    cutoffs = stored(ll_cutoffs(scored))
    rows = append_to_table(st.outlier_flags(events_stream(spark, folder), dists, cutoffs))
    return rows.select("event_id", "activity", r("log_density", 5).alias("log_density"), "is_outlier")


@query("stream_event_gaps", "ST7", LOG + f"SELECT case_id, event_id, ms, duration AS gap_ms FROM steps WHERE ms < {_MARK}")
def _(spark, folder):
    return append_to_table(st.event_gaps(events_stream(spark, folder)))
