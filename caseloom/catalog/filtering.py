"""Queries over renaming, filtering, splitting and perturbing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog.base import LOG, SHIP, TALK, query, uniform_sql
from caseloom.functions.maths import epoch_ms, format_duration, to_unit
from caseloom.operators import filters as f
from caseloom.plans.lineage import stored
from caseloom.sources.logs import conversations_log, events_log, shipments_log


@query("events_as_log", "S3", LOG + "SELECT case_id, pos, activity, ms, event_id, value FROM log")
def _(spark, folder):
    return events_log(spark, folder).select("case_id", "pos", "activity", epoch_ms("ts").alias("ms"),
                                            "event_id", "value")


@query("rename_activities", "F1,U2", LOG + """SELECT case_id, pos, upper(activity) || ':complete' AS activity FROM log""")
def _(spark, folder):
    log = events_log(spark, folder)
    renamed = f.rename(log, lambda name, life: F.concat(F.upper(name), F.lit(":"),
                                                        F.coalesce(life, F.lit("complete"))))
    return renamed.select("case_id", "pos", "activity")


@query("flatten_lifecycle", "F2", LOG + """SELECT case_id, pos,
  activity || '_' || CASE WHEN pos = 1 THEN 'start' WHEN activity = 'error' THEN 'null' ELSE 'complete' END AS activity
  FROM log""")
def _(spark, folder):
    log = events_log(spark, folder).withColumn("lifecycle", F.when(F.col("pos") == 1, "start").when(
        F.col("activity") != "error", "complete"))
    return f.flatten_lifecycle(log).select("case_id", "pos", "activity")


@query("escape_underscores", "F3", LOG + """SELECT case_id, pos, replace(activity || '_' || user_id, '_', '§€§') AS escaped,
  activity || '_' || user_id AS restored, replace(activity || '_' || user_id, '_', '#') AS hashed FROM log""")
def _(spark, folder):
    log = events_log(spark, folder).withColumn("activity", F.concat_ws("_", "activity", "user_id"))
    out = f.escape_underscores(log).withColumn("escaped", F.col("activity"))
    out = f.unescape_underscores(out).withColumn("restored", F.col("activity"))
    return f.hash_underscores(out).select("case_id", "pos", "escaped", "restored", F.col("activity").alias("hashed"))


@query("base_activity", "F4", SHIP + "SELECT case_id, pos, activity FROM ship")
def _(spark, folder):
    log = shipments_log(spark, folder)
    log = log.withColumn("activity", F.concat("activity", F.lit("+complete+x")))
    return f.base_activity(log).select("case_id", "pos", "activity")


@query("unroll_loops", "F5", LOG + """SELECT case_id, pos, CASE WHEN rn > 1 THEN activity || '_' || rn ELSE activity END AS activity
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id, activity ORDER BY pos) AS rn FROM log)""")
def _(spark, folder):
    return f.unroll_loops(events_log(spark, folder)).select("case_id", "pos", "activity")


@query("unroll_loops_conversations", "F5", TALK + """SELECT case_id, pos, CASE WHEN rn > 1 THEN activity || '_' || rn ELSE activity END AS activity
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id, activity ORDER BY pos) AS rn FROM talk)""")
def _(spark, folder):
    return f.unroll_loops(conversations_log(spark, folder)).select("case_id", "pos", "activity")


@query("reduplicate", "F6", LOG + """, named AS (
    SELECT case_id, pos, activity || '_' || (user_id % 7 + CASE WHEN (activity = 'click' AND user_id % 7 = 3)
      OR (activity = 'view' AND user_id % 7 IN (0, 2)) OR (activity = 'error' AND user_id % 7 <> 1) THEN 2 ELSE 0 END) AS activity FROM log),
  classes AS (SELECT DISTINCT activity, regexp_extract(activity, '^(.*)_([0-9]+)$', 1) AS base,
      CAST(regexp_extract(activity, '^(.*)_([0-9]+)$', 2) AS INTEGER) AS k FROM named),
  ok AS (SELECT c.activity, c.base FROM classes c WHERE CASE
      WHEN c.k = 0 THEN EXISTS (SELECT 1 FROM classes d WHERE d.base = c.base AND d.k = 1)
      WHEN c.k = 1 THEN EXISTS (SELECT 1 FROM classes d WHERE d.base = c.base AND d.k IN (0, 2))
      ELSE (SELECT count(*) FROM classes d WHERE d.base = c.base AND d.k BETWEEN 1 AND c.k - 1) = c.k - 1
           AND EXISTS (SELECT 1 FROM classes d WHERE d.base = c.base AND d.k IN (0, 2)) END)
  SELECT n.case_id, n.pos, coalesce(o.base, n.activity) AS activity FROM named n LEFT JOIN ok o ON o.activity = n.activity""")
def _(spark, folder):
    # iterations 0 to 8, where some activities lack one
    phase = F.col("user_id") % 7
    lacks = ((F.col("activity") == "click") & (phase == 3)) | (
        (F.col("activity") == "view") & phase.isin(0, 2)) | ((F.col("activity") == "error") & (phase != 1))
    log = events_log(spark, folder).withColumn("activity", F.concat_ws(
        "_", "activity", F.when(lacks, phase + 2).otherwise(phase).cast("string")))
    return f.reduplicate(log).select("case_id", "pos", "activity")


@query("reorder_by_time", "F7", SHIP + """SELECT case_id, activity, ms,
  row_number() OVER (PARTITION BY case_id ORDER BY ts, pos) AS pos FROM ship""")
def _(spark, folder):
    return f.reorder_by_time(shipments_log(spark, folder)).select(
        "case_id", "activity", epoch_ms("ts").alias("ms"), "pos")


@query("sort_cases", "F8", LOG + "SELECT case_id, t0 AS start_ms, n_events, case_index FROM cases")
def _(spark, folder):
    return f.sort_cases(events_log(spark, folder)).select(
        "case_id", epoch_ms("start").alias("start_ms"), "n_events", F.col("case_index").cast("bigint"))


@query("most_frequent_variant", "F9", LOG + """, v AS (SELECT seq, count(*) AS n, max(case_index) AS reached FROM cases GROUP BY seq),
  best AS (SELECT reached FROM v ORDER BY n DESC, reached LIMIT 1)
  SELECT l.case_id, l.pos, l.activity FROM log l JOIN cases c USING (case_id) JOIN best ON c.case_index = best.reached""")
def _(spark, folder):
    return f.most_frequent_variant(events_log(spark, folder)).select("case_id", "pos", "activity")


@query("most_frequent_variant_cases", "F9", LOG + """, v AS (SELECT seq, count(*) AS n, max(case_index) AS reached FROM cases GROUP BY seq),
  best AS (SELECT seq FROM v ORDER BY n DESC, reached LIMIT 1)
  SELECT l.case_id, l.pos, l.activity FROM log l JOIN cases c USING (case_id) JOIN best ON c.seq = best.seq""")
def _(spark, folder):
    return f.most_frequent_variant(events_log(spark, folder), all_cases=True).select("case_id", "pos", "activity")


@query("filter_classes", "F10", LOG + """SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS pos, activity
  FROM log WHERE activity IN ('click', 'purchase')""")
def _(spark, folder):
    return f.filter_classes(events_log(spark, folder), ["click", "purchase"]).select("case_id", "pos", "activity")


@query("kfold_in", "F11", LOG + """SELECT l.case_id, l.pos FROM log l JOIN cases c USING (case_id) WHERE (case_index - 1) % 5 = 2""")
def _(spark, folder):
    return f.kfold(events_log(spark, folder), 5, 2).select("case_id", "pos")


@query("kfold_out", "F11", LOG + """SELECT l.case_id, l.pos FROM log l JOIN cases c USING (case_id) WHERE (case_index - 1) % 5 <> 2""")
def _(spark, folder):
    return f.kfold(events_log(spark, folder), 5, 2, in_fold=False).select("case_id", "pos")


@query("ratio_split", "F12", LOG + """SELECT l.case_id, l.pos,
  CASE WHEN (case_index - 1) / (SELECT count(*) FROM cases) <= 0.3 THEN 1 ELSE 2 END AS part
  FROM log l JOIN cases c USING (case_id)""")
def _(spark, folder):
    return f.ratio_split(events_log(spark, folder), 0.3).select("case_id", "pos", "part")


@query("prefix_until", "F13", LOG + """SELECT case_id, pos FROM (
  SELECT case_id, pos, max(CASE WHEN ts > t0 + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY case_id ORDER BY pos) AS late
  FROM (SELECT *, first_value(ts) OVER (PARTITION BY case_id ORDER BY pos) AS t0 FROM log)) WHERE late = 0""")
def _(spark, folder):
    from caseloom.plans.slices import with_case_values
    log = with_case_values(events_log(spark, folder), first_ts=F.min_by("ts", "pos"))
    return f.prefix_until(log, F.col("first_ts") + F.expr("INTERVAL 6 HOURS")).select("case_id", "pos")


@query("prefix_until_unsorted", "F13", SHIP + """SELECT case_id, pos FROM (
  SELECT case_id, pos, max(CASE WHEN ts > TIMESTAMP '1998-06-01' THEN 1 ELSE 0 END)
    OVER (PARTITION BY case_id ORDER BY pos) AS late FROM ship) WHERE late = 0""")
def _(spark, folder):
    return f.prefix_until(shipments_log(spark, folder), F.lit("1998-06-01").cast("timestamp")).select("case_id", "pos")


@query("starting_after", "F13", SHIP + """SELECT count(*) AS dropped_cases FROM ship
  WHERE pos = 1 AND ts > TIMESTAMP '1998-06-01'""")
def _(spark, folder):
    return f.starting_after(shipments_log(spark, folder), F.lit("1998-06-01").cast("timestamp"))


@query("training_up_to", "F14", LOG + """SELECT activity, count(*) AS n, sum(duration)::BIGINT AS total FROM steps
  WHERE ts < TIMESTAMP '2024-01-15' GROUP BY activity""")
def _(spark, folder):
    from caseloom.operators.windows import step_durations
    steps = step_durations(events_log(spark, folder))
    return f.training_up_to(steps, F.lit("2024-01-15").cast("timestamp")).groupBy("activity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total"))


def _u(salt: str, *keys: str) -> str:
    return uniform_sql(7, salt, *(keys or ("case_id", "pos")))


@query("add_noise", "F15", LOG + f""", d AS (SELECT case_id, pos, activity, ms, {_u('keep')} >= 0.2 AS keep, {_u('spare')} AS spare, {_u('twice')} < 0.1 AS twice, {_u('at')} AS u FROM log),
  m AS (SELECT *, bool_or(keep) OVER c AS kept_any, row_number() OVER (PARTITION BY case_id ORDER BY spare, pos) = 1 AS pick, min(ms) OVER c - 10 AS lo, max(ms) OVER c + 10 AS hi
    FROM d WINDOW c AS (PARTITION BY case_id)),
  e AS (SELECT case_id, pos, activity, ts, 0 AS copy FROM m JOIN log USING (case_id, pos, activity) WHERE keep OR (NOT kept_any AND pick)
    UNION ALL SELECT case_id, pos, activity, make_timestamp((lo + CAST(floor(u * (hi - lo)) AS BIGINT)) * 1000), 1 FROM m WHERE twice)
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ts, copy, pos) AS pos, activity, epoch_us(ts) AS us FROM e""")
def _(spark, folder):
    rows = f.add_noise(events_log(spark, folder), 0.1, 0.2, 7)
    return rows.select("case_id", "pos", "activity", F.unix_micros("ts").alias("us"))


@query("accurate_noise", "F16", LOG + f""", c AS (SELECT case_id, max(pos) AS n, arg_min(ms, pos) AS t0, arg_max(ms, pos) - arg_min(ms, pos) AS d FROM log GROUP BY 1),
  a AS (SELECT *, floor(n * 0.3::DOUBLE) + CASE WHEN {_u('affected', 'case_id')} < n * 0.3::DOUBLE - floor(n * 0.3::DOUBLE) THEN 1 ELSE 0 END AS affected FROM c),
  x AS (SELECT *, floor(affected * 0.5::DOUBLE) + CASE WHEN {_u('deleted', 'case_id')} < affected * 0.5::DOUBLE - floor(affected * 0.5::DOUBLE) THEN 1 ELSE 0 END AS deleted FROM a),
  k AS (SELECT l.case_id, l.pos, l.activity, l.ts, n, t0, affected, deleted, row_number() OVER (PARTITION BY l.case_id ORDER BY {_u('draw', 'l.case_id', 'l.pos')}, l.pos) AS rk
    FROM log l JOIN x USING (case_id)),
  g AS (SELECT activity AS name, row_number() OVER (ORDER BY activity) AS class FROM (SELECT DISTINCT activity FROM log)),
  e AS (SELECT case_id, pos, activity, ts, 0 AS copy FROM k WHERE rk > deleted OR (deleted >= n AND rk = n)
    UNION ALL SELECT case_id, pos, name, make_timestamp((t0 + CAST(floor({_u('at')} * (SELECT avg(d) FROM c)) AS BIGINT)) * 1000), 1
      FROM k JOIN g ON class = 1 + floor({_u('class')} * (SELECT count(*) FROM g)) WHERE rk > deleted AND rk <= affected)
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ts, copy, pos) AS pos, activity, epoch_us(ts) AS us FROM e""")
def _(spark, folder):
    rows = f.accurate_noise(events_log(spark, folder), 0.3, 0.5, 7)
    return rows.select("case_id", "pos", "activity", F.unix_micros("ts").alias("us"))


@query("add_noise_without_noise", "F15", LOG + "SELECT case_id, pos, activity, ms FROM log")
def _(spark, folder):
    return f.add_noise(events_log(spark, folder), 0.0, 0.0, 7).select("case_id", "pos", "activity", epoch_ms("ts").alias("ms"))


@query("accurate_noise_sizes", "F16", LOG + """SELECT case_id, true AS deletions_fit, true AS insertions_fit FROM cases""")
def _(spark, folder):
    log = stored(events_log(spark, folder).select("case_id", "pos", "activity", "ts"))

    def sizes(ratio, name):
        return f.accurate_noise(log, 0.3, ratio, 7).groupBy("case_id").agg(F.max("pos").alias(name))

    n, whole = F.col("n"), F.floor(F.col("n") * 0.3)
    both = log.groupBy("case_id").agg(F.max("pos").alias("n")).join(sizes(1.0, "less"), "case_id").join(
        sizes(0.0, "more"), "case_id")
    return both.select("case_id", (F.col("less").between(n - whole - 1, n - whole) & (F.col("less") >= 1)).alias("deletions_fit"),
                       F.col("more").between(n + whole, n + whole + 1).alias("insertions_fit"))


@query("unit_conversion", "F17", LOG + """SELECT case_id, pos, round(duration / 60000.0::DOUBLE, 6) AS minutes,
  round(duration / 3600000.0::DOUBLE, 9) AS hours, round(duration / 31536000000.0::DOUBLE, 12) AS years FROM steps""")
def _(spark, folder):
    from caseloom.operators.windows import step_durations
    steps = step_durations(events_log(spark, folder))
    d = F.col("duration")
    return steps.select("case_id", "pos", F.round(to_unit(d, "minutes"), 6).alias("minutes"),
                        F.round(to_unit(d, "hours"), 9).alias("hours"),
                        F.round(to_unit(d, "years"), 12).alias("years"))


@query("format_duration", "F18", LOG + """SELECT case_id, pos, printf('%02d:%02d:%02d', duration // 3600000,
  (duration // 60000) % 60, (duration // 1000) % 60) AS text FROM steps""")
def _(spark, folder):
    from caseloom.operators.windows import step_durations
    steps = step_durations(events_log(spark, folder))
    return steps.select("case_id", "pos", format_duration(F.col("duration")).alias("text"))


@query("trace_text", "F19", LOG + "SELECT case_id, CAST(0 AS BIGINT) AS chunk, seq AS text FROM seqs")
def _(spark, folder):
    return f.trace_text(events_log(spark, folder))


@query("trace_text_full", "F19", LOG + """SELECT case_id, CAST(0 AS BIGINT) AS chunk, string_agg(activity || '+complete by '
  || user_id || '(' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ')', ', ' ORDER BY pos) AS text FROM log GROUP BY case_id""")
def _(spark, folder):
    log = events_log(spark, folder).withColumn("lifecycle", F.lit("complete")).withColumn(
        "resource", F.col("user_id").cast("string"))
    return f.trace_text(log, bare=False)


@query("event_classes", "F20", LOG + "SELECT activity, count(*) AS n FROM log GROUP BY activity")
def _(spark, folder):
    return f.event_classes(events_log(spark, folder))


@query("classes_by_count", "F20", SHIP + """SELECT n, string_agg(activity, ',' ORDER BY activity) AS classes FROM (
  SELECT activity, count(*) AS n FROM ship GROUP BY activity) GROUP BY n""")
def _(spark, folder):
    return f.classes_by_count(shipments_log(spark, folder)).withColumn("classes", F.array_join("classes", ","))


@query("check_boundaries", "F21", LOG + """, b AS (SELECT case_id, start_ts, split_part(seq, ', ', 1) AS first_activity,
    split_part(seq, ', ', -1) AS last_activity FROM cases),
  e AS (SELECT first_activity AS fa, last_activity AS la FROM b ORDER BY start_ts, case_id LIMIT 1)
  SELECT case_id, first_activity, last_activity FROM b, e WHERE first_activity <> fa OR last_activity <> la""")
def _(spark, folder):
    return f.check_boundaries(events_log(spark, folder))


@query("variants", "A1", LOG + """SELECT n_events, CAST(0 AS BIGINT) AS chunk, seq AS text, count(*) AS n_cases FROM cases GROUP BY n_events, seq""")
def _(spark, folder):
    return f.variant_texts(events_log(spark, folder)).select("n_events", "chunk", "text", "n_cases")


@query("variants_conversations", "A1", TALK + """SELECT seq AS text, count(*) AS n_cases FROM (SELECT case_id,
  string_agg(activity, ', ' ORDER BY pos) AS seq FROM talk GROUP BY case_id) GROUP BY seq""")
def _(spark, folder):
    return f.variant_texts(conversations_log(spark, folder)).select("text", "n_cases")


@query("union_split_parts", "O4", LOG + "SELECT case_id, pos, activity FROM log")
def _(spark, folder):
    parts = f.ratio_split(events_log(spark, folder), 0.5).select("case_id", "pos", "activity", "part")
    return parts.where("part = 1").unionByName(parts.where("part = 2")).drop("part")
