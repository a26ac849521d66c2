"""Queries over case, key and pair aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog.base import LOG, SHIP, query
from caseloom.functions.maths import epoch_ms, normal_quantile
from caseloom.operators import aggs as a
from caseloom.operators import filters as f
from caseloom.operators import temporal as tp
from caseloom.operators import windows as w
from caseloom.sources.logs import events_log, load, shipments_log


def r(col, digits=4):
    return F.round(col, digits)


@query("case_durations", "A2", SHIP + """SELECT case_id, (arg_max(ms, pos) - arg_min(ms, pos))::BIGINT AS duration FROM ship GROUP BY case_id""")
def _(spark, folder):
    return a.case_durations(shipments_log(spark, folder))


@query("duration_stats", "A2", LOG + """, d AS (SELECT (t1 - t0) / 60000.0::DOUBLE AS d FROM cases)
  SELECT count(*) AS n, round(min(d), 4) AS min, round(max(d), 4) AS max, round(avg(d), 4) AS mean,
    round(stddev_samp(d), 4) AS sd, round(var_samp(d), 2) AS variance, round(sum(d), 2) AS sum,
    round(median(d), 4) AS median FROM d""")
def _(spark, folder):
    s = a.duration_stats(events_log(spark, folder), "minutes")
    return s.select("n", r("min").alias("min"), r("max").alias("max"), r("mean").alias("mean"), r("sd").alias("sd"),
                    r("variance", 2).alias("variance"), r("sum", 2).alias("sum"), r("median").alias("median"))


@query("case_bounds", "A3", SHIP + """SELECT case_id, min(ms) - 10 AS lower, max(ms) + 10 AS upper FROM ship GROUP BY case_id""")
def _(spark, folder):
    return a.case_bounds(shipments_log(spark, folder))


@query("earliest_event", "A3", SHIP + "SELECT min(ms) AS earliest FROM ship")
def _(spark, folder):
    return a.earliest(shipments_log(spark, folder))


@query("grouped_rows", "A4,U1", """SELECT event_type AS key, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events""")
def _(spark, folder):
    ev = load(spark, folder, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = a.group_rows(ev, lambda d: d["event_type"], ["ts", "event_id"])
    return out.select("key", "event_id", "place")


@query("grouped_sum_avg", "A4,U1", """SELECT event_type || '-' || (user_id % 3) AS key, round(sum(value), 4) AS sum,
  round(avg(value), 4) AS avg FROM events GROUP BY 1""")
def _(spark, folder):
    ev = load(spark, folder, "events")
    key = F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string"))
    both = a.sum_by(ev, key, F.col("value")).join(a.avg_by(ev, key, F.col("value")), "key")
    return both.select("key", r("sum").alias("sum"), r("avg").alias("avg"))


@query("grouped_argmax", "A4,U1", """SELECT event_type AS key, arg_max(event_id, (value, event_id)) AS value FROM events GROUP BY 1""")
def _(spark, folder):
    ev = load(spark, folder, "events")
    return a.max_by(ev, F.col("event_type"), F.col("event_id"), F.struct("value", "event_id"))


@query("nan_free_mean", "A5", """SELECT event_type AS activity, round(avg(value) FILTER (user_id % 4 <> 0), 6) AS mean FROM events GROUP BY 1""")
def _(spark, folder):
    ev = load(spark, folder, "events").withColumn(
        "v", F.when(F.col("user_id") % 4 == 0, float("nan")).otherwise(F.col("value")))
    return ev.groupBy(F.col("event_type").alias("activity")).agg(r(a.nanmean(F.col("v")), 6).alias("mean"))


@query("mean_interarrival", "A34", LOG + """SELECT count(*) AS n, round((arg_max(t1, case_index) + 10 - arg_min(t0, case_index)) / 3600000.0::DOUBLE / count(*), 6)
  AS mean_interarrival FROM cases""")
def _(spark, folder):
    return a.mean_interarrival(events_log(spark, folder)).select("n", r("mean_interarrival", 6).alias("mean_interarrival"))


DFG = """, dfg AS (SELECT activity AS before, next AS after, count(*) AS n, avg(gap / 60000.0::DOUBLE) AS mean,
    coalesce(stddev_samp(gap / 60000.0::DOUBLE), 0) AS sd FROM steps WHERE next IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT '_Start', activity, count(*), avg((ms - t0) / 60000.0::DOUBLE),
    coalesce(stddev_samp((ms - t0) / 60000.0::DOUBLE), 0) FROM log JOIN cases USING (case_id) GROUP BY 2)
"""


@query("directly_follows", "A9", LOG + DFG + "SELECT before, after, n, round(mean, 4) AS mean, round(sd, 4) AS sd FROM dfg")
def _(spark, folder):
    d = tp.directly_follows(events_log(spark, folder))
    return d.select("before", "after", "n", r("mean").alias("mean"), r("sd").alias("sd"))


@query("relative_positions", "A10", LOG + DFG + """, s AS (SELECT after AS activity, mean FROM dfg WHERE before = '_Start')
  SELECT activity, round(mean / (SELECT max(mean) FROM s), 6) AS relative_position,
    activity = (SELECT arg_max(activity, (mean, activity)) FROM s) AS latest FROM s""")
def _(spark, folder):
    from caseloom.plans.models import stored
    p = tp.relative_positions(stored(tp.directly_follows(events_log(spark, folder))))
    return p.select("activity", r("relative_position", 6).alias("relative_position"), "latest")


@query("temporal_matrix", "A11", LOG + DFG + """SELECT before, after,
  round(mean / CASE WHEN before = '_Start' THEN (SELECT max(mean) FROM dfg) ELSE (SELECT sum(mean) FROM dfg) END, 6) AS force,
  round(n / (SELECT max(n) FROM dfg), 6) AS weight FROM dfg""")
def _(spark, folder):
    from caseloom.plans.models import stored
    m = tp.temporal_matrix(stored(tp.directly_follows(events_log(spark, folder))))
    return m.select("before", "after", r("force", 6).alias("force"), r("weight", 6).alias("weight"))


def _pair_sql(cte: str, log: str) -> str:
    return cte + f""", p AS (SELECT a.activity AS before, b.activity AS after, (b.ms - a.ms) / 60000.0::DOUBLE AS gap, b.pos - a.pos AS d
    FROM {log} a JOIN {log} b ON a.case_id = b.case_id AND a.pos < b.pos
  UNION ALL SELECT '_Start', b.activity, (b.ms - a.ms) / 60000.0::DOUBLE, 1 FROM {log} a JOIN {log} b ON a.case_id = b.case_id AND a.pos = 1)
  SELECT before, after, count(*) AS n, round(avg(gap), 3) AS mean, round(coalesce(stddev_samp(gap), 0), 3) AS sd,
    round(avg(d), 6) AS mean_distance, count(*) FILTER (d = 1) AS n_direct FROM p GROUP BY 1, 2"""


def _pairs(p):
    return p.select("before", "after", "n", r("mean", 3).alias("mean"), r("sd", 3).alias("sd"),
                    r("mean_distance", 6).alias("mean_distance"), "n_direct")


@query("pairwise_gaps", "J3", _pair_sql(LOG, "log"))
def _(spark, folder):
    return _pairs(tp.pairwise_gaps(events_log(spark, folder)))


@query("pairwise_gaps_shipments", "J3", _pair_sql(SHIP, "ship"))
def _(spark, folder):
    return _pairs(tp.pairwise_gaps(shipments_log(spark, folder)))


PROFILE = """, ids AS (SELECT activity, row_number() OVER (ORDER BY min((case_index, pos))) - 1 AS id
    FROM log JOIN cases USING (case_id) GROUP BY activity),
  p AS (SELECT a.activity AS before, b.activity AS after, b.ms - a.ms AS gap, coalesce((SELECT string_agg(DISTINCT m.activity, ',' ORDER BY m.activity)
      FROM log m WHERE m.case_id = a.case_id AND m.pos > a.pos AND m.pos < b.pos), '') AS between_set
    FROM log a JOIN log b ON a.case_id = b.case_id AND a.pos < b.pos),
  prof AS (SELECT after AS event, before AS other, between_set, gap AS d FROM p JOIN ids i ON i.activity = before JOIN ids j ON j.activity = after WHERE i.id >= j.id
    UNION ALL SELECT before, after, between_set, -gap FROM p JOIN ids i ON i.activity = before JOIN ids j ON j.activity = after WHERE j.id >= i.id)
"""


@query("class_ids", "J4", LOG + PROFILE + "SELECT activity, id FROM ids")
def _(spark, folder):
    return tp.class_ids(events_log(spark, folder))


@query("temporal_profile", "J4", LOG + PROFILE + """SELECT event, other, between_set, count(*) AS n, round(sum(d) / 60000.0::DOUBLE, 3) AS minutes,
  round(avg(d * d / 3600000000.0::DOUBLE), 2) AS mean_square, count(*) FILTER (d < 0) AS n_negative FROM prof GROUP BY 1, 2, 3""")
def _(spark, folder):
    p = tp.temporal_profile(events_log(spark, folder))
    return p.select("event", "other", F.array_join("between", ",").alias("between_set"), "n",
                    r(F.col("sum_ms") / 60000.0, 3).alias("minutes"),
                    r(F.col("sum_sq") / 3.6e9 / F.col("n"), 2).alias("mean_square"), "n_negative")


EXCLUDING = """, kept AS (SELECT * FROM prof WHERE event <> other AND between_set NOT LIKE '%click%' AND between_set NOT LIKE '%view%'),
  sides AS (SELECT event, d FROM kept UNION ALL SELECT other, -d FROM kept)
"""


@query("durations_excluding", "J5", LOG + PROFILE + EXCLUDING + """SELECT event, count(*) AS n, round(sum(d) / 60000.0::DOUBLE, 3) AS minutes,
  count(*) FILTER (d < 0) AS n_negative FROM sides GROUP BY event""")
def _(spark, folder):
    d = tp.durations_excluding(tp.temporal_profile(events_log(spark, folder)), ["click", "view"])
    return d.select("event", "n", r(F.col("sum_ms") / 60000.0, 3).alias("minutes"), "n_negative")


@query("temporal_score", "A12", LOG + PROFILE + EXCLUDING + """SELECT event, round(0.7 / (abs(avg(d / 3600000.0::DOUBLE)) + 1)
  + 0.3 / ln(2 + count(*) FILTER (d < 0)), 6) AS score FROM sides GROUP BY event""")
def _(spark, folder):
    d = tp.durations_excluding(tp.temporal_profile(events_log(spark, folder)), ["click", "view"])
    mean = F.col("sum_ms") / 3.6e6 / F.col("n")
    return d.select("event", r(tp.temporal_score(mean, F.col("n_negative")), 6).alias("score"))


@query("normal_stats", "A14", """WITH v AS (SELECT event_type AS activity, value - 40 AS x FROM events)
  SELECT activity, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 4) AS var_pop, round(var_samp(x), 4) AS var_samp,
  round(stddev_samp(x), 6) AS sd, count(*) FILTER (x < 0) AS n_negative FROM v GROUP BY activity""")
def _(spark, folder):
    v = load(spark, folder, "events").select(F.col("event_type").alias("activity"), (F.col("value") - 40).alias("x"))
    s = a.normal_stats(v, ["activity"], "x")
    return s.select("activity", "n", r("mean", 6).alias("mean"), r("var_pop").alias("var_pop"),
                    r("var_samp").alias("var_samp"), r("sd", 6).alias("sd"), "n_negative")


@query("normal_stats_removal", "A14", """WITH v AS (SELECT event_type AS activity, value - 40 AS x FROM events WHERE user_id % 5 <> 0)
  SELECT activity, count(*) AS n, round(avg(x), 4) AS mean, round(var_pop(x), 3) AS var_pop, round(var_samp(x), 3) AS var_samp,
  count(*) FILTER (x < 0) AS n_negative FROM v GROUP BY activity""")
def _(spark, folder):
    v = load(spark, folder, "events").select(F.col("event_type").alias("activity"), (F.col("value") - 40).alias("x"),
                                             "user_id")
    s = a.remove_from_stats(a.normal_stats(v, ["activity"], "x"),
                            a.normal_stats(v.where("user_id % 5 = 0"), ["activity"], "x"), ["activity"])
    return s.select("activity", "n", r("mean").alias("mean"), r("var_pop", 3).alias("var_pop"),
                    r("var_samp", 3).alias("var_samp"), "n_negative")


_Z995 = normal_quantile(0.995)
_T995 = " + ".join(f"{c!r}::DOUBLE / (n - 1) ** {i}" for i, c in enumerate([
    _Z995, (_Z995**3 + _Z995) / 4, (5 * _Z995**5 + 16 * _Z995**3 + 3 * _Z995) / 96,
    (3 * _Z995**7 + 19 * _Z995**5 + 17 * _Z995**3 - 15 * _Z995) / 384]))


@query("mean_confidence_interval", "A27", f"""WITH s AS (SELECT event_type AS activity, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
  w AS (SELECT *, 2 * ({_T995}) * sqrt(v / n) AS w FROM s)
  SELECT activity, n, round(m, 6) AS mean, round(w, 4) AS ci_width, round(w / 2, 4) AS half_width, round((m / (m - w / 2) - 1) * 100, 4) AS error_percent FROM w""")
def _(spark, folder):
    ci = a.mean_ci(load(spark, folder, "events").withColumnRenamed("event_type", "activity"), ["activity"], "value")
    return ci.select("activity", "n", r("mean", 6).alias("mean"), r("ci_width").alias("ci_width"),
                     r("half_width").alias("half_width"), r("error_percent").alias("error_percent"))


@query("retrieval_stats", "A28", """WITH d AS (SELECT event_type AS activity, value > 80 AS p, user_id % 3 = 0 OR value > 120 AS y FROM events),
  c AS (SELECT activity, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp,
    count(*) FILTER (NOT p AND NOT y) AS tn, count(*) FILTER (NOT p AND y) AS fn FROM d GROUP BY 1)
  SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c""")
def _(spark, folder):
    ev = load(spark, folder, "events").withColumnRenamed("event_type", "activity")
    s = a.retrieval_stats(ev, F.col("value") > 80, (F.col("user_id") % 3 == 0) | (F.col("value") > 120), ["activity"])
    return s.select("activity", "tp", "fp", "tn", "fn", r("precision", 6).alias("precision"),
                    r("recall", 6).alias("recall"), r("accuracy", 6).alias("accuracy"))


@query("roc_curve", "A29", """WITH d AS (SELECT value AS score, CAST(user_id % 3 = 0 AS INTEGER) AS y FROM events),
  g AS (SELECT score, count(*) AS n, sum(y) AS p FROM d GROUP BY score)
  SELECT score, n, round(sum(p) OVER o / (SELECT sum(y) FROM d), 6) AS tpr,
    round((sum(n) OVER o - sum(p) OVER o) / (SELECT sum(1 - y) FROM d), 6) AS fpr FROM g WINDOW o AS (ORDER BY score)""")
def _(spark, folder):
    ev = load(spark, folder, "events").withColumnRenamed("value", "score")
    return a.roc(ev, "score", F.col("user_id") % 3 == 0).select(
        "score", "n", r("tpr", 6).alias("tpr"), r("fpr", 6).alias("fpr"))


@query("forecast_eval", "A30", """SELECT event_type AS method, count(*) AS n, round(avg((value - 50) / 86400000.0::DOUBLE * 1e6), 6) AS me,
  round(avg(((value - 50) * 1e3 / 86400000.0::DOUBLE) ** 2), 12) AS mse, round(avg(abs(value - 50) / 86400000.0::DOUBLE * 1e6), 6) AS mae,
  round(sqrt(avg(((value - 50) * 1e3 / 86400000.0::DOUBLE) ** 2)), 9) AS rmse FROM events GROUP BY 1""")
def _(spark, folder):
    ev = load(spark, folder, "events").select(F.col("event_type").alias("method"), F.col("value").alias("p"),
                                              F.lit(50.0).alias("y"))
    big = a.forecast_eval(ev.select("method", (F.col("p") * 1e6).alias("p"), (F.col("y") * 1e6).alias("y")),
                          ["method"], "p", "y").select("method", "n", r("me", 6).alias("me"), r("mae", 6).alias("mae"))
    mid = a.forecast_eval(ev.select("method", (F.col("p") * 1e3).alias("p"), (F.col("y") * 1e3).alias("y")),
                          ["method"], "p", "y").select("method", r("mse", 12).alias("mse"), r("rmse", 9).alias("rmse"))
    return big.join(mid, "method")


@query("average_results", "A31", """SELECT event_type AS model, round(avg(value) FILTER (user_id % 4 <> 0), 6) AS fitness,
  round(avg(user_id), 6) AS precision FROM events GROUP BY 1""")
def _(spark, folder):
    ev = load(spark, folder, "events").select(
        F.col("event_type").alias("model"),
        F.when(F.col("user_id") % 4 == 0, float("nan")).otherwise(F.col("value")).alias("fitness"),
        F.col("user_id").cast("double").alias("precision"))
    out = a.average_results(ev, ["model"], ["fitness", "precision"])
    return out.select("model", r("fitness", 6).alias("fitness"), r("precision", 6).alias("precision"))


@query("subset_support", "A32", LOG + """, s AS (SELECT DISTINCT case_id, activity FROM log),
  two AS (SELECT a.case_id, a.activity || ',' || b.activity AS subset FROM s a JOIN s b ON a.case_id = b.case_id AND a.activity < b.activity),
  three AS (SELECT a.case_id, a.activity || ',' || b.activity || ',' || c.activity AS subset FROM s a JOIN s b ON a.case_id = b.case_id
    AND a.activity < b.activity JOIN s c ON a.case_id = c.case_id AND b.activity < c.activity)
  SELECT subset, count(*) AS n_cases FROM (SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY subset""")
def _(spark, folder):
    return a.subset_support(events_log(spark, folder), 2, 3).select(
        F.array_join("subset", ",").alias("subset"), "n_cases")


@query("hourly_medians", "A33", """SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS hour_ms, count(*) AS n, round(median(value), 6) AS median_value,
  """ + ", ".join(f"count(*) FILTER (event_type = '{k}') AS event_type_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def _(spark, folder):
    ev = load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    levels = sorted(row[0] for row in ev.select("event_type").distinct().collect())  # as many as there are types
    out = a.hourly(ev, "ts", ["value"], {"event_type": levels})
    return out.select(epoch_ms("hour").alias("hour_ms"), "n", r("median_value", 6).alias("median_value"),
                      *(f"event_type_{k}" for k in levels))


@query("duration_matrix", "S5", LOG + """SELECT case_id, """ + ", ".join(
    f"coalesce(arg_max(duration, pos) FILTER (activity = '{k}'), -1) AS {k}"
    for k in ["click", "error", "signup", "purchase", "view"]) + " FROM steps GROUP BY case_id")
def _(spark, folder):
    from caseloom.sources.sinks import duration_matrix
    kinds = ["click", "error", "signup", "purchase", "view"]
    m = duration_matrix(events_log(spark, folder), kinds)
    return m.select("case_id", *[F.coalesce(F.col(k), F.lit(-1)).alias(k) for k in kinds])


@query("quality_distance", "A26,U5", """SELECT l_returnflag AS model, round((avg(l_discount) + avg(l_tax) + 1 - (avg(l_discount) * 5 + avg(l_tax) * 9) / 2) / 3, 8) AS distance
  FROM lineitem GROUP BY 1""")
def _(spark, folder):
    rows = load(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return rows.select("model", r(a.quality_distance(F.col("d") * 5, F.col("t") * 9, F.col("d"), F.col("t")), 8).alias("distance"))
