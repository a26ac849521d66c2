"""Queries that write an export to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog.base import LOG, query
from caseloom.catalog.likelihood import SCORED, samples, valued_steps
from caseloom.functions.maths import epoch_ms
from caseloom.operators import anomaly as an
from caseloom.operators import distributions as ds
from caseloom.operators import remaining as rm
from caseloom.operators import windows as w
from caseloom.operators.aggs import case_durations
from caseloom.plans.lineage import new_folder, stored
from caseloom.sources import sinks, xes
from caseloom.sources.logs import events_log


def r(col, digits=6):
    return F.round(col, digits)


@query("xes_round_trip", "S1,S2", LOG + """SELECT case_id, pos, activity, ms, 'complete' AS lifecycle, CAST(user_id AS VARCHAR) AS resource,
  CAST(event_id AS VARCHAR) AS event FROM log""")
def _(spark, folder):
    log = events_log(spark, folder).select(
        "case_id", "pos", "activity", "ts", F.lit("complete").alias("lifecycle"), F.col("user_id").cast("string").alias("resource"),
        F.create_map(F.lit("event"), F.col("event_id").cast("string")).alias("attrs"))
    path = new_folder(spark, "xes")
    xes.write_xes(log, path)
    return xes.read_xes(spark, path).select("case_id", "pos", "activity", epoch_ms("ts").alias("ms"), "lifecycle", "resource",
                                            F.col("attrs")["event"].alias("event"))


@query("training_export", "S4", LOG + """, marked AS (SELECT s.*, c.case_index, CASE WHEN s.pos = 1 THEN 1 ELSE 0 END AS f,
    CASE WHEN s.pos = n_events THEN 1 ELSE 0 END AS e FROM steps s JOIN cases c USING (case_id))
  SELECT activity, duration::DOUBLE AS duration, (sum(f - e) OVER (ORDER BY ts, case_index, pos) + e)::BIGINT AS system_load, ms FROM marked""")
def _(spark, folder):
    steps = w.active_case_load(w.step_durations(events_log(spark, folder)))
    path = new_folder(spark, "training")
    sinks.write_training(steps.select("activity", F.col("duration").cast("double").alias("duration"),
                                      F.col("load").cast("bigint").alias("system_load"), "ts"), path)
    return sinks.read_training(spark, path).select("activity", "duration", "system_load", epoch_ms("ts").alias("ms"))


@query("duration_matrix_export", "S5", LOG + """SELECT case_id, """ + ", ".join(
    f"coalesce(CAST(arg_max(duration, pos) FILTER (activity = '{k}') AS VARCHAR), 'NaN') AS {k}"
    for k in ["click", "error", "purchase", "signup", "view"]) + " FROM steps GROUP BY case_id")
def _(spark, folder):
    path = new_folder(spark, "matrix")
    sinks.write_duration_matrix(sinks.duration_matrix(events_log(spark, folder), ["click", "error", "purchase", "signup", "view"]), path)
    return spark.read.option("header", True).option("sep", ";").csv(path).withColumnRenamed("CaseId", "case_id")


@query("likelihood_export", "S6", LOG + SCORED + """SELECT case_id, round(sum(ld), 4) AS log_likelihood, arg_max(ms, pos) - arg_min(ms, pos) AS case_duration
  FROM scored GROUP BY case_id""")
def _(spark, folder):
    dists = stored(ds.fit_durations(samples(spark, folder), "NORMAL"))
    path = new_folder(spark, "likelihoods")
    sinks.write_likelihoods(an.case_likelihood(ds.with_density(valued_steps(spark, folder), dists)), path)
    rows = spark.read.schema("case_id string, log_likelihood double, case_duration bigint, n_events bigint").option(
        "header", True).option("sep", ";").csv(f"{path}/cases")
    return rows.select("case_id", r("log_likelihood", 4).alias("log_likelihood"), "case_duration")


@query("prediction_export", "S7", LOG + """, m AS (SELECT avg(t1 - t0) AS d, stddev_samp(t1 - t0) AS s FROM cases)
  SELECT case_id AS "numCase", 'naive' AS method, round(greatest(d - (ms - t0), 0), 2) AS prediction, round(s, 2) AS confidence_interval,
    (t1 - ms)::DOUBLE AS real_duration FROM log JOIN cases USING (case_id), m""")
def _(spark, folder):
    log = events_log(spark, folder)
    stats = case_durations(log).agg(F.avg("duration").alias("d"), F.stddev_samp("duration").alias("s"))
    rows = rm.remaining_times(log).select(
        F.col("case_id").alias("numCase"), F.lit("naive").alias("method"),
        rm.remaining_naive(stats.select("d").scalar(), F.col("elapsed")).alias("prediction"),
        stats.select("s").scalar().alias("confidence_interval"), F.col("remaining").cast("double").alias("real_duration"))
    path = new_folder(spark, "predictions")
    sinks.write_predictions(rows, path)
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    return back.select("numCase", "method", r("prediction", 2).alias("prediction"),
                       r("confidence_interval", 2).alias("confidence_interval"), "real_duration")


@query("entropy_curve_export", "S8", LOG + """, counted AS (SELECT case_index, row_number() OVER (PARTITION BY seq ORDER BY case_index) AS c FROM cases),
  summed AS (SELECT case_index, sum(c * log2(c) - CASE WHEN c > 1 THEN (c - 1) * log2(c - 1) ELSE 0 END) OVER (ORDER BY case_index) AS s FROM counted)
  SELECT case_index AS "sampleCount", round(log2(case_index) - s / case_index, 6) AS "sampleEntropy" FROM summed WHERE case_index < 50 OR case_index % 10 = 0""")
def _(spark, folder):
    path = new_folder(spark, "entropy")
    sinks.write_entropy_curve(w.running_entropy(events_log(spark, folder)), path)
    back = spark.read.schema("sampleCount bigint, sampleEntropy double").option("header", True).csv(path)
    return back.select("sampleCount", (r("sampleEntropy") + 0.0).alias("sampleEntropy"))
