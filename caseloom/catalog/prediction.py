"""Queries over series, forecasts, remaining time and path distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog.base import LOG, query
from caseloom.functions.maths import epoch_ms
from caseloom.operators import filters as f
from caseloom.operators import forecast as fc
from caseloom.operators import graph as g
from caseloom.operators import joins as j
from caseloom.operators import remaining as rm
from caseloom.operators import windows as w
from caseloom.operators.aggs import case_durations
from caseloom.plans.lineage import stored
from caseloom.sources.logs import events_log, load


def r(col, digits=6):
    return F.round(col, digits)


KEYS = ["activity", "part"]


def parted(spark, folder):
    """Event kinds in ten parts, so that hourly series have gaps."""
    ev = load(spark, folder, "events")
    return ev.select(F.col("event_type").alias("activity"), (F.col("user_id") % 10).alias("part"),
                     F.col("ts").cast("timestamp").alias("ts"), "event_id", "value",
                     F.floor(F.col("value") * 60000).cast("bigint").alias("duration"))


_OBS = """WITH ev AS (SELECT event_type AS activity, user_id % 10 AS part, epoch_us(ts) // 1000 AS ms, ts, event_id, value,
    CAST(floor(value * 60000) AS BIGINT) AS duration FROM events),
  obs AS (SELECT activity, part, ms // 3600000 AS idx, count(*)::DOUBLE AS value FROM ev GROUP BY 1, 2, 3)
"""
_SERIES = """, ser AS (SELECT activity, part, idx, row_number() OVER (PARTITION BY activity, part ORDER BY idx) AS place, value FROM (
    SELECT activity, part, unnest(generate_series(min(idx), max(idx))) AS idx FROM obs GROUP BY 1, 2) LEFT JOIN obs USING (activity, part, idx))
"""
SERIES = _OBS + _SERIES


def hourly_counts(spark, folder, missing="keep"):
    return fc.build_series(parted(spark, folder), KEYS, "count", missing)


@query("time_index", "T1", "SELECT event_id, epoch_us(ts) // 3600000000 AS hour_index, epoch_us(ts) // 900000000 AS quarter_index FROM events")
def _(spark, folder):
    ms = epoch_ms("ts")
    return parted(spark, folder).select("event_id", fc.time_index(ms).alias("hour_index"),
                                        fc.time_index(ms, 900_000).alias("quarter_index"))


@query("count_series", "T2,W6", SERIES + """SELECT activity, part, idx, place, last_value(value IGNORE NULLS) OVER (PARTITION BY activity, part ORDER BY idx) AS value FROM ser""")
def _(spark, folder):
    return hourly_counts(spark, folder, "last").select("activity", "part", "idx", "place", "value")


@query("average_series", "T2", _OBS.replace("ms // 3600000 AS idx, count(*)::DOUBLE AS value", "(ms - duration) // 3600000 AS idx, avg(duration) AS value") + _SERIES + """
  SELECT activity, part, idx, round(coalesce(value, avg(value) OVER (PARTITION BY activity, part)), 4) AS value FROM ser""")
def _(spark, folder):
    s = fc.build_series(parted(spark, folder), KEYS, "average", "mean")
    return s.select("activity", "part", "idx", r("value", 4).alias("value"))


@query("carry_forward_modes", "W6", SERIES + """SELECT activity, part, idx, coalesce(value, -1) AS kept,
  round(coalesce(value, avg(value) OVER (PARTITION BY activity, part)), 6) AS averaged FROM ser""")
def _(spark, folder):
    s = stored(hourly_counts(spark, folder))
    kept = w.carry_forward(s, KEYS, "place", "value", "keep").withColumnRenamed("filled", "kept")
    both = w.carry_forward(kept, KEYS, "place", "value", "mean")
    return both.select("activity", "part", "idx", F.coalesce("kept", F.lit(-1.0)).alias("kept"), r("filled").alias("averaged"))


@query("bounded_history", "W7", SERIES + """SELECT activity, part, idx, count(value) OVER o AS history_n, round(coalesce(avg(value) OVER o, -1), 6) AS history_mean,
  coalesce(first_value(value) OVER o, -1) AS history_oldest FROM ser WINDOW o AS (PARTITION BY activity, part ORDER BY idx ROWS BETWEEN 672 PRECEDING AND CURRENT ROW)""")
def _(spark, folder):
    h = w.bounded_history(stored(hourly_counts(spark, folder)), KEYS, "place", "value")
    return h.select("activity", "part", "idx", "history_n", F.coalesce(r("history_mean"), F.lit(-1.0)).alias("history_mean"),
                    F.coalesce("history_oldest", F.lit(-1.0)).alias("history_oldest"))


@query("last_season", "W8", SERIES + """SELECT activity, part, idx, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY activity, part, idx % 24 ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lag(value) OVER (PARTITION BY activity, part ORDER BY idx), -1) AS seasonal FROM ser""")
def _(spark, folder):
    s = w.last_season(stored(hourly_counts(spark, folder)), KEYS, "place", "idx", "value")
    return s.select("activity", "part", "idx", F.coalesce("seasonal", F.lit(-1.0)).alias("seasonal"))


def _percentile_sql(p: float) -> str:
    at = f"({p} * (n + 1) / 100.0::DOUBLE)"
    return f"""CASE WHEN {at} < 1 THEN v[1] WHEN {at} >= n THEN v[n] ELSE v[floor({at})::BIGINT]
      + ({at} - floor({at})) * (v[floor({at})::BIGINT + 1] - v[floor({at})::BIGINT]) END"""


@query("forecast_average", "T3", SERIES + f""", s AS (SELECT activity, part, avg(value) AS prediction, count(*) AS n, list_sort(list(value)) AS v FROM ser WHERE value IS NOT NULL GROUP BY 1, 2)
  SELECT activity, part, round(prediction, 6) AS prediction, round({_percentile_sql(5)}, 6) AS lower, round({_percentile_sql(95)}, 6) AS upper FROM s""")
def _(spark, folder):
    p = fc.forecast_average(hourly_counts(spark, folder), KEYS)
    return p.select(*KEYS, r("prediction").alias("prediction"), r("lower").alias("lower"), r("upper").alias("upper"))


@query("forecast_naive", "T4", SERIES + "SELECT activity, part, arg_max(value, idx) FILTER (value IS NOT NULL) AS prediction FROM ser GROUP BY 1, 2")
def _(spark, folder):
    return fc.forecast_naive(hourly_counts(spark, folder), KEYS).select(*KEYS, "prediction")


TARGET = 474_500  # an hour in February 2024, after the last event


@query("forecast_drift", "T5", SERIES + f""", e AS (SELECT activity, part, arg_min(value, idx) FILTER (value IS NOT NULL) AS a, arg_max(value, idx) FILTER (value IS NOT NULL) AS b,
    max(idx) AS hi, max(idx) - min(idx) FILTER (value IS NOT NULL) + 1 AS t FROM ser GROUP BY 1, 2)
  SELECT activity, part, round(CASE WHEN t > 1 THEN greatest(0, b + ({TARGET} - hi) * (b - a) / (t - 1)) ELSE b END, 6) AS prediction FROM e""")
def _(spark, folder):
    p = fc.forecast_drift(hourly_counts(spark, folder), KEYS, TARGET)
    return p.select(*KEYS, r("prediction").alias("prediction"))


@query("forecast_seasonal", "T6", SERIES + f"""SELECT activity, part, coalesce(arg_max(value, idx) FILTER (value IS NOT NULL AND idx % 24 = {TARGET % 24}),
  arg_max(value, idx) FILTER (value IS NOT NULL)) AS prediction FROM ser GROUP BY 1, 2""")
def _(spark, folder):
    return fc.forecast_seasonal(hourly_counts(spark, folder), KEYS, TARGET).select(*KEYS, "prediction")


_DECISIONS = LOG + """, dec AS (SELECT coalesce(prev, '_Start') AS state, activity, ms FROM steps),
  obs AS (SELECT state, activity, ms // 3600000 AS idx, count(*)::DOUBLE AS value FROM dec GROUP BY 1, 2, 3),
  ser AS (SELECT state, activity, idx, last_value(value IGNORE NULLS) OVER (PARTITION BY state, activity ORDER BY idx) AS value FROM (
    SELECT state, activity, unnest(generate_series(min(idx), max(idx))) AS idx FROM obs GROUP BY 1, 2) LEFT JOIN obs USING (state, activity, idx))
"""


def _decisions(spark, folder):
    return j.with_state(events_log(spark, folder)).select("state", "activity", "ts")


for _method, _expr in (("average", "avg(value)"), ("naive", "arg_max(value, idx)"),
                       ("seasonal", f"coalesce(arg_max(value, idx) FILTER (idx % 24 = {TARGET % 24}), arg_max(value, idx))")):
    @query(f"branch_forecast_{_method}", "T7", _DECISIONS + f""", p AS (SELECT state, activity, {_expr} AS prediction FROM ser GROUP BY 1, 2)
      SELECT state, activity, round(prediction, 6) AS prediction, round(prediction / sum(prediction) OVER (PARTITION BY state), 6) AS probability FROM p""")
    def _(spark, folder, method=_method):
        p = fc.forecast_branch_probs(_decisions(spark, folder), method, TARGET)
        return p.select("state", "activity", r("prediction").alias("prediction"), r("probability").alias("probability"))


@query("branch_forecast_plain_counts", "T7", _DECISIONS + """SELECT state, activity, count(*)::DOUBLE AS prediction,
  round(count(*) / sum(count(*)) OVER (PARTITION BY state), 6) AS probability FROM dec GROUP BY 1, 2""")
def _(spark, folder):
    p = fc.forecast_branch_probs(_decisions(spark, folder), "last_observation", TARGET)
    return p.select("state", "activity", "prediction", r("probability").alias("probability"))


@query("forecast_distribution", "T8", SERIES + f""", s AS (SELECT activity, part, avg(value) AS m, count(*) AS n, list_sort(list(value)) AS v FROM ser WHERE value IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT activity, part, m, {_percentile_sql(5)} AS lo, {_percentile_sql(95)} AS hi FROM s)
  SELECT activity, part, CASE WHEN abs(hi - lo) < 1e-5 THEN 'DETERMINISTIC' ELSE 'NORMAL' END AS dist_type, round(m, 6) AS p1,
    CASE WHEN abs(hi - lo) < 1e-5 THEN -1 ELSE round((hi - lo) / 2, 6) END AS p2 FROM b""")
def _(spark, folder):
    d = fc.to_dist(fc.forecast_average(hourly_counts(spark, folder), KEYS))
    return d.select(*KEYS, "dist_type", r(F.col("params")[0]).alias("p1"),
                    F.coalesce(r(F.try_element_at("params", F.lit(2))), F.lit(-1.0)).alias("p2"))


@query("single_bucket_forecast", "T8", _OBS + f""", s AS (SELECT activity, part, avg(duration) AS m, count(*) AS n, list_sort(list(duration::DOUBLE)) AS v FROM ev GROUP BY 1, 2)
  SELECT activity, part, round(m, 4) AS prediction, round({_percentile_sql(2.5)}, 4) AS lower, round({_percentile_sql(97.5)}, 4) AS upper FROM s""")
def _(spark, folder):
    p = fc.single_bucket(parted(spark, folder), KEYS)
    return p.select(*KEYS, r("prediction", 4).alias("prediction"), r("lower", 4).alias("lower"), r("upper", 4).alias("upper"))


@query("calendar_features", "T9", "SELECT event_id, hour(ts) AS hour, dayofweek(ts) AS weekday FROM events WHERE dayofweek(ts) NOT IN (0, 6)")
def _(spark, folder):
    c = fc.calendar_features(parted(spark, folder), "ts", drop_weekends=True)
    return c.select("event_id", F.col("hour").cast("bigint"), F.col("weekday").cast("bigint"))


@query("rolling_fit", "T10", _OBS + """, p AS (SELECT * FROM ev WHERE event_id % 3 = 0), t AS (SELECT * FROM ev WHERE event_id % 3 <> 0)
  SELECT p.event_id, count(t.value) AS n, round(coalesce(avg(t.value), -1), 10) AS mean, round(coalesce(stddev_samp(t.value), 0), 7) AS sd
  FROM p LEFT JOIN t ON t.activity = p.activity AND t.part = p.part AND t.ts < p.ts GROUP BY p.event_id""")
def _(spark, folder):
    ev = parted(spark, folder)
    fit = fc.rolling_fit(ev.where("event_id % 3 <> 0"), ev.where("event_id % 3 = 0").select(*KEYS, "ts", "event_id"), KEYS, "value")
    return fit.select("event_id", F.col("n").cast("bigint"), r(F.coalesce("mean", F.lit(-1.0)), 10).alias("mean"), r("sd", 7).alias("sd"))


# ---------------------------------------------------------------- remaining time

_REMAIN = LOG + """, rem AS (SELECT l.*, t1 - ms AS remaining, ms - t0 AS elapsed, (case_index - 1) % 5 AS fold FROM log l JOIN cases USING (case_id))
"""


@query("remaining_naive", "R1", _REMAIN + """SELECT case_id, pos, round(greatest((SELECT avg(t1 - t0) FROM cases) - elapsed, 0), 2) AS predicted FROM rem""")
def _(spark, folder):
    log = events_log(spark, folder)
    mean = case_durations(log).agg(F.avg("duration")).scalar()
    timed = rm.remaining_times(log)
    return timed.select("case_id", "pos", r(rm.remaining_naive(mean, F.col("elapsed")), 2).alias("predicted"))


_STATE_SQL = {
    "last": "activity",
    "list": "string_agg(activity, ',') OVER (PARTITION BY case_id ORDER BY pos)",
    "bag": "array_to_string(list_sort(list(activity) OVER (PARTITION BY case_id ORDER BY pos)), ',')",
    "set": "array_to_string(list_sort(list_distinct(list(activity) OVER (PARTITION BY case_id ORDER BY pos))), ',')",
}
for _state, _expr in _STATE_SQL.items():
    @query(f"remaining_by_{_state}", "R2", _REMAIN + f""", st AS (SELECT *, {_expr} AS state FROM rem),
      model AS (SELECT state, avg(remaining) AS m FROM st WHERE fold <> 0 GROUP BY state)
      SELECT case_id, pos, round(coalesce(m, greatest((SELECT avg(t1 - t0) FROM cases WHERE (case_index - 1) % 5 <> 0) - elapsed, 0)), 2) AS predicted
      FROM st LEFT JOIN model USING (state) WHERE fold = 0""")
    def _(spark, folder, state=_state):
        log = stored(events_log(spark, folder).select("case_id", "pos", "activity", "ts"))
        p = rm.remaining_by_state(f.kfold(log, 5, 0, in_fold=False), f.kfold(log, 5, 0), state)
        return p.select("case_id", "pos", r("predicted", 2).alias("predicted"))


@query("conditional_duration", "R3", _REMAIN + """, d AS (SELECT t1 - t0 AS duration FROM cases), p AS (SELECT DISTINCT elapsed::DOUBLE AS elapsed FROM rem WHERE elapsed > 0)
  SELECT elapsed, count(duration) AS n_left, round(coalesce(avg(duration), elapsed), 2) AS expected FROM p LEFT JOIN d ON duration >= elapsed GROUP BY elapsed""")
def _(spark, folder):
    log = stored(events_log(spark, folder).select("case_id", "pos", "activity", "ts"))
    probes = rm.remaining_times(log).where("elapsed > 0")
    c = rm.conditional_duration(case_durations(log), probes, [])
    return c.select("elapsed", F.col("n_left").cast("bigint"), r("expected", 2).alias("expected"))


@query("conditional_expectation", "R3", """WITH s AS (SELECT event_type AS activity, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
  SELECT event_id, round(m + value, 6) AS exponential, round(CASE WHEN value < hi THEN (greatest(lo, value) + hi) / 2 ELSE value END, 6) AS uniform
  FROM events JOIN s ON s.activity = event_type""")
def _(spark, folder):
    from caseloom.operators.distributions import fit_durations
    from caseloom.plans.models import join_model
    ev = load(spark, folder, "events").withColumnRenamed("event_type", "activity")
    data = ev.select("activity", F.col("value").alias("duration"))
    e = fit_durations(data, "EXPONENTIAL").select("activity", F.col("dist_type").alias("t1"), F.col("params").alias("p1"))
    u = fit_durations(data, "UNIFORM").select("activity", F.col("dist_type").alias("t2"), F.col("params").alias("p2"))
    both = join_model(ev.select("event_id", "activity", "value"), stored(e.join(u, "activity")), ["activity"])
    v = F.col("value")
    return both.select("event_id", r(rm.conditional_expectation(F.col("t1"), F.col("p1"), v)).alias("exponential"),
                       r(rm.conditional_expectation(F.col("t2"), F.col("p2"), v)).alias("uniform"))


@query("deadline_risk", "R4", _REMAIN + """, p AS (SELECT DISTINCT activity AS state, floor(value * 600000)::DOUBLE AS budget FROM log),
  c AS (SELECT p.state, budget, count(*) AS total, count(*) FILTER (remaining <= budget) AS below FROM p JOIN rem ON activity = state GROUP BY 1, 2)
  SELECT state, budget, total, round(1 - (greatest(below - 1, 0) + 0.5) / (total + 1), 6) AS risk FROM c""")
def _(spark, folder):
    log = stored(events_log(spark, folder).select("case_id", "pos", "activity", "ts", "value"))
    probes = log.select(F.col("activity").alias("state"), F.floor(F.col("value") * 600_000).alias("budget"))
    return rm.deadline_risk(log, probes, "last", "budget").select("state", "budget", "total", r("risk").alias("risk"))


_POINTS = _REMAIN + """, per AS (SELECT CAST(floor(avg(t1 - t0) * 2 / 10) AS BIGINT) AS p FROM cases),
  pts AS (SELECT case_id, case_index, i, t0 + i * p AS at_ms, i * p AS elapsed, t1 - (t0 + i * p) AS remaining FROM cases, per, generate_series(0, 9) t(i)
    WHERE n_events >= 2 AND t1 - (t0 + i * p) >= 0)
"""


@query("monitoring_points", "R5", _POINTS + "SELECT case_id, CAST(i AS INTEGER) AS i, at_ms, elapsed, remaining FROM pts")
def _(spark, folder):
    return rm.monitoring_points(events_log(spark, folder), 10)


@query("compare_predictors", "R6,A30", _POINTS + """, pf AS (SELECT *, (case_index - 1) % 5 AS fold FROM pts),
  st AS (SELECT pf.*, (SELECT arg_max(activity, pos) FROM log WHERE log.case_id = pf.case_id AND ms <= at_ms) AS state FROM pf),
  means AS (SELECT f.fold, (SELECT avg(t1 - t0) FROM cases WHERE (case_index - 1) % 5 <> f.fold) AS mean FROM (SELECT DISTINCT fold FROM pf) f),
  sm AS (SELECT f.fold, r.activity AS state, avg(r.remaining) AS m FROM (SELECT DISTINCT fold FROM pf) f JOIN rem r ON r.fold <> f.fold GROUP BY 1, 2),
  pe AS (SELECT DISTINCT fold, elapsed FROM pf),
  ce AS (SELECT pe.fold, pe.elapsed, coalesce(avg(t1 - t0), pe.elapsed) AS e FROM pe LEFT JOIN cases ON (case_index - 1) % 5 <> pe.fold AND t1 - t0 >= pe.elapsed GROUP BY 1, 2),
  allp AS (SELECT remaining, greatest(mean - st.elapsed, 0) AS naive, coalesce(m, greatest(mean - st.elapsed, 0)) AS state_p, e - st.elapsed AS cond
    FROM st JOIN means USING (fold) LEFT JOIN sm ON sm.fold = st.fold AND sm.state = st.state JOIN ce ON ce.fold = st.fold AND ce.elapsed = st.elapsed),
  errs AS (SELECT 'naive' AS method, (naive - remaining) / 3600000.0::DOUBLE AS x FROM allp UNION ALL SELECT 'state', (state_p - remaining) / 3600000.0::DOUBLE FROM allp
    UNION ALL SELECT 'conditional', (cond - remaining) / 3600000.0::DOUBLE FROM allp)
  SELECT method, count(*) AS n, round(avg(x), 4) AS me, round(avg(x * x), 4) AS mse, round(avg(abs(x)), 4) AS mae, round(sqrt(avg(x * x)), 4) AS rmse FROM errs GROUP BY method""")
def _(spark, folder):
    c = rm.compare_predictors(events_log(spark, folder), 5, 10)
    return c.select("method", "n", r("me", 4).alias("me"), r("mse", 4).alias("mse"), r("mae", 4).alias("mae"), r("rmse", 4).alias("rmse"))


@query("subset_study", "R7")
def _(spark, folder):
    log = events_log(spark, folder).select("case_id", "pos", "activity", "ts")
    return rm.subset_study(log, ["click"], ["error", "purchase", "signup", "view"], 2, 5, 10)


# ---------------------------------------------------------------- path distances

def _edges(spark, folder, n):
    lines = load(spark, folder, "lineitem")
    a, b = F.col("l_partkey") % n, F.col("l_suppkey") % n
    return lines.where(a < b).groupBy(a.cast("string").alias("src"), b.cast("string").alias("dst")).agg(
        F.min("l_quantity").alias("weight"), F.max("l_quantity").alias("heavy"))


def _edges_sql(n, agg):
    return f"""WITH RECURSIVE e AS (SELECT l_partkey % {n} AS s, l_suppkey % {n} AS d, {agg}(l_quantity) AS w FROM lineitem
      WHERE l_partkey % {n} < l_suppkey % {n} GROUP BY 1, 2)"""


@query("shortest_paths", "G1", _edges_sql(40, "min") + """, p AS (SELECT 0 AS node, 0.0::DOUBLE AS x UNION SELECT e.d, p.x + e.w FROM p JOIN e ON e.s = p.node)
  SELECT CAST(node AS VARCHAR) AS node, min(x) AS distance FROM p GROUP BY node""")
def _(spark, folder):
    return g.path_distances(_edges(spark, folder, 40), "0")


@query("longest_paths", "G1", _edges_sql(40, "max") + """, p AS (SELECT 0 AS node, 0.0::DOUBLE AS x UNION SELECT e.d, p.x + e.w FROM p JOIN e ON e.s = p.node)
  SELECT CAST(node AS VARCHAR) AS node, max(x) AS distance FROM p GROUP BY node""")
def _(spark, folder):
    edges = _edges(spark, folder, 40).select("src", "dst", F.col("heavy").alias("weight"))
    return g.path_distances(edges, "0", longest=True)


@query("all_pairs_distances", "G2", _edges_sql(12, "min") + """, p AS (SELECT s, d, w AS x FROM e UNION SELECT p.s, e.d, p.x + e.w FROM p JOIN e ON e.s = p.d)
  SELECT CAST(s AS VARCHAR) AS src, CAST(d AS VARCHAR) AS dst, min(x) AS distance FROM p GROUP BY 1, 2
  UNION ALL SELECT n, n, 0.0 FROM (SELECT DISTINCT CAST(s AS VARCHAR) AS n FROM e UNION SELECT CAST(d AS VARCHAR) FROM e)""")
def _(spark, folder):
    return g.all_pairs_distances(_edges(spark, folder, 12))


def _deliveries(spark, folder):
    """A graph that grows with the tables: customers to orders, orders to suppliers."""
    orders, lines = load(spark, folder, "orders"), load(spark, folder, "lineitem")
    placed = orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"),
                           F.col("o_totalprice").cast("double").alias("weight"))
    sent = lines.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"),
                        F.col("l_extendedprice").cast("double").alias("weight"))
    first = orders.agg(F.min("o_custkey")).first()[0]
    return placed.unionByName(sent), f"c{first}"


def _deliveries_sql(agg):
    return f"""WITH k AS (SELECT min(o_custkey) AS c FROM orders), mine AS (SELECT o_orderkey, o_totalprice::DOUBLE AS p FROM orders, k WHERE o_custkey = c)
  SELECT 'c' || c AS node, 0.0::DOUBLE AS distance FROM k UNION ALL SELECT 'o' || o_orderkey, round(p, 2) FROM mine
  UNION ALL SELECT 's' || l_suppkey, round({agg}(p + l_extendedprice::DOUBLE), 2) FROM mine JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""


@query("delivery_paths", "G1", _deliveries_sql("min"))
def _(spark, folder):
    return g.path_distances(*_deliveries(spark, folder)).select("node", r("distance", 2).alias("distance"))


@query("delivery_paths_longest", "G1", _deliveries_sql("max"))
def _(spark, folder):
    edges, source = _deliveries(spark, folder)
    longest = g.path_distances(edges, source, longest=True)
    return longest.select("node", r("distance", 2).alias("distance"))


@query("distances_from_customers", "G2", """WITH a AS (SELECT o_custkey AS c, o_orderkey AS o, min(o_totalprice)::DOUBLE AS w FROM orders GROUP BY 1, 2),
  b AS (SELECT l_orderkey AS o, l_suppkey AS s, min(l_extendedprice)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)
  SELECT 'c' || c_custkey AS source, 'c' || c_custkey AS node, 0.0::DOUBLE AS distance FROM customer
  UNION ALL SELECT 'c' || c, 'o' || o, round(w, 2) FROM a JOIN customer ON c = c_custkey
  UNION ALL SELECT 'c' || c, 's' || s, round(min(a.w + b.w), 2) FROM a JOIN customer ON c = c_custkey JOIN b USING (o) GROUP BY c, s""")
def _(spark, folder):
    customers = load(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"))
    found = g.distances_from(_deliveries(spark, folder)[0], customers)
    return found.select("source", "node", r("distance", 2).alias("distance"))
