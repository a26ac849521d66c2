"""Queries over ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog.base import LOG, SHIP, query
from caseloom.operators import filters as f
from caseloom.operators import windows as w
from caseloom.plans.ranks import value_ranks
from caseloom.plans.slices import hot_keys
from caseloom.sources.logs import events_log, load, shipments_log

KINDS = ["click", "error", "signup", "purchase", "view"]


@query("correlation_durations", "W1", LOG + """, firsts AS (SELECT * FROM (SELECT s.*,
    lag(ms) OVER (PARTITION BY case_id ORDER BY pos) AS before, min(ms) OVER (PARTITION BY case_id) AS c0,
    row_number() OVER (PARTITION BY case_id, activity ORDER BY pos) AS occ FROM steps s) WHERE occ = 1)
  SELECT case_id, """ + ", ".join(
    f"""coalesce(max(before - c0) FILTER (activity = '{a}'), 0) AS "{a} (case duration)",
    coalesce(max(ms - before) FILTER (activity = '{a}'), 0) AS "{a} (duration)" """ for a in KINDS)
    + " FROM firsts GROUP BY case_id")
def _(spark, folder):
    return w.correlation_durations(events_log(spark, folder), KINDS)


@query("active_case_load", "W2", LOG + """, marked AS (SELECT l.*, c.case_index, CASE WHEN pos = 1 THEN 1 ELSE 0 END AS f,
    CASE WHEN pos = n_events THEN 1 ELSE 0 END AS e FROM log l JOIN cases c USING (case_id))
  SELECT case_id, pos, (sum(f - e) OVER (ORDER BY ts, case_index, pos) + e)::BIGINT AS load FROM marked""")
def _(spark, folder):
    return w.active_case_load(events_log(spark, folder)).select("case_id", "pos", F.col("load").cast("bigint"))


@query("active_case_load_sorted_shipments", "W2,F7", SHIP + """, s AS (SELECT case_id, ts,
    row_number() OVER (PARTITION BY case_id ORDER BY ts, pos) AS pos, count(*) OVER (PARTITION BY case_id) AS n FROM ship),
  c AS (SELECT case_id, row_number() OVER (ORDER BY min(ts), case_id) AS case_index FROM s GROUP BY case_id),
  m AS (SELECT s.*, case_index, CASE WHEN pos = 1 THEN 1 ELSE 0 END AS f, CASE WHEN pos = n THEN 1 ELSE 0 END AS e
    FROM s JOIN c USING (case_id))
  SELECT case_id, pos, (sum(f - e) OVER (ORDER BY ts, case_index, pos) + e)::BIGINT AS load FROM m""")
def _(spark, folder):
    cases = load(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id"))
    log = f.reorder_by_time(shipments_log(spark, folder).select("case_id", "pos", "ts"), cases)
    return w.active_case_load(log, hot_keys(cases, ["case_id"]) is None).select("case_id", "pos", F.col("load").cast("bigint"))


@query("step_durations", "W3", LOG + "SELECT case_id, pos, activity, duration FROM steps")
def _(spark, folder):
    return w.step_durations(events_log(spark, folder)).select("case_id", "pos", "activity", "duration")


@query("step_links", "W4", LOG + """SELECT case_id, pos, coalesce(lag(pos) OVER o, 0) AS parent_pos,
  coalesce(lead(pos) OVER o, 0) AS child_pos FROM log WINDOW o AS (PARTITION BY case_id ORDER BY pos)""")
def _(spark, folder):
    return w.step_links(events_log(spark, folder)).select(
        "case_id", "pos", F.coalesce("parent_pos", F.lit(0)).alias("parent_pos"),
        F.coalesce("child_pos", F.lit(0)).alias("child_pos"))


@query("running_entropy", "W5", LOG + """, counted AS (SELECT case_index, row_number() OVER (PARTITION BY seq ORDER BY case_index) AS c FROM cases),
  summed AS (SELECT case_index, sum(c * log2(c) - CASE WHEN c > 1 THEN (c - 1) * log2(c - 1) ELSE 0 END)
    OVER (ORDER BY case_index) AS s FROM counted)
  SELECT case_index AS sample_count, round(log2(case_index) - s / case_index, 6) AS sample_entropy FROM summed
  WHERE case_index < 50 OR case_index % 10 = 0""")
def _(spark, folder):
    curve = w.running_entropy(events_log(spark, folder))
    return curve.select("sample_count", (F.round("sample_entropy", 6) + 0.0).alias("sample_entropy"))


@query("case_time_series", "W11", LOG + """, p AS (SELECT case_id, activity, CASE WHEN t1 = t0 THEN 0
    ELSE CAST(floor(200.0::DOUBLE * (ms - t0) / (t1 - t0) + 0.5) AS INTEGER) END AS t FROM log JOIN cases USING (case_id)),
  a AS (SELECT case_id, t, string_agg(DISTINCT activity, ',' ORDER BY activity) AS active FROM p GROUP BY case_id, t),
  g AS (SELECT case_id, CAST(unnest(generate_series(0, CASE WHEN t1 = t0 THEN 0 ELSE 200 END)) AS INTEGER) AS t FROM cases)
  SELECT g.case_id, g.t, coalesce(a.active, '') AS active FROM g LEFT JOIN a USING (case_id, t)""")
def _(spark, folder):
    series = w.case_time_series(events_log(spark, folder))
    return series.select("case_id", "t", F.array_join("active", ",").alias("active"))


@query("largest_keys", "W9", LOG + """SELECT activity, event_id, rn FROM (SELECT activity, event_id,
  row_number() OVER (PARTITION BY activity ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn <= 25""")
def _(spark, folder):
    from pyspark.sql import Window
    events = load(spark, folder, "events").select(
        F.col("event_type").alias("activity"), "event_id", F.struct("ts", "event_id").alias("at"))
    top = w.largest_keys(events, ["activity"], "at", 25)
    rank = F.row_number().over(Window.partitionBy("activity").orderBy(F.desc("at"))).cast("bigint")
    return top.select("activity", "event_id", rank.alias("rn"))


@query("sample_rank", "W10", LOG + """, d AS (SELECT activity, duration FROM steps WHERE pos > 1),
  p AS (SELECT DISTINCT l.activity, CAST(floor(value * 60000) AS DOUBLE) AS probe FROM log l
        WHERE activity IN (SELECT activity FROM d)),
  s AS (SELECT activity, CAST(duration AS DOUBLE) AS v, 0 AS q, 1 AS w FROM d UNION ALL SELECT activity, probe, 1, 0 FROM p),
  r AS (SELECT activity, v, q, sum(w) OVER (PARTITION BY activity ORDER BY v, q) AS below FROM s)
  SELECT activity, v AS probe, greatest(below - 1, 0)::BIGINT AS rank FROM r WHERE q = 1""")
def _(spark, folder):
    steps = w.step_durations(events_log(spark, folder))
    ranks = value_ranks(steps.where("pos > 1"), ["activity"], "duration")
    probes = steps.select("activity", F.floor(F.col("value") * 60000).cast("double").alias("probe"))
    return w.sample_rank(ranks, probes, ["activity"], "duration", "probe").select("activity", "probe", "rank")
