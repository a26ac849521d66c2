"""Ordered operators: durations, load, running entropy, histories, case time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.maths import epoch_ms, round_half_up
from caseloom.operators.filters import SEQUENCE, case_sequences, number_cases
from caseloom.plans.slices import (neighbours, running, running_dense, running_in_case, slice_of, sweep,
                                   with_case_values)


def step_durations(log: DataFrame) -> DataFrame:
    """Add ``duration`` (ms since the previous event of the case, 0 for the first)."""
    timed = neighbours(log, ["case_id"], "pos", {"_before": (epoch_ms("ts"), 1)})
    return timed.withColumn("duration", F.coalesce(epoch_ms("ts") - F.col("_before"), F.lit(0))).drop("_before")


def step_links(log: DataFrame) -> DataFrame:
    """Add ``parent_pos`` and ``child_pos`` (null at the ends of a case)."""
    return neighbours(log, ["case_id"], "pos", {"parent_pos": ("pos", 1), "child_pos": ("pos", -1)})


def correlation_durations(log: DataFrame, activities: list[str]) -> DataFrame:
    """One wide row per case: for the first occurrence of each listed activity
    the case time at the previous event and the time since it (ms; 0 if absent)."""
    before = neighbours(log, ["case_id"], "pos", {"_before": (epoch_ms("ts"), 1)})
    wide = before.groupBy("case_id").agg(
        F.min_by(epoch_ms("ts"), "pos").alias("_start"),
        *[F.min_by(F.struct(epoch_ms("ts").alias("at"), F.col("_before").alias("prev")),
                   F.when(F.col("activity") == a, F.col("pos"))).alias(f"_e{i}")
          for i, a in enumerate(activities)])
    out = [F.col("case_id")]
    for i, a in enumerate(activities):
        out.append(F.coalesce(F.col(f"_e{i}.prev") - F.col("_start"), F.lit(0)).alias(f"{a} (case duration)"))
        out.append(F.coalesce(F.col(f"_e{i}.at") - F.col(f"_e{i}.prev"), F.lit(0)).alias(f"{a} (duration)"))
    return wide.select(*out)


def active_case_load(log: DataFrame, whole_cases: bool = False) -> DataFrame:
    """Add ``load``: open cases at each event, counted in (time, case, position)
    order; a case closes after its last event.  Cases must be sorted by time;
    events without a timestamp are left out.  ``whole_cases`` says that no case
    has more than ``hotRows`` events: then a case meets in one window."""
    timed = log.where(F.col("ts").isNotNull())
    # a case opens and closes with its first and last event that has a time
    ends = {"_start": F.min_by("ts", "pos"), "_one": F.min("pos"), "_n": F.max("pos")}
    if whole_cases:
        case = Window.partitionBy("case_id")
        events = timed.withColumns({name: value.over(case) for name, value in ends.items()})
    else:
        events = with_case_values(timed, **ends)
    first = (F.col("pos") == F.col("_one")).cast("int")
    last = (F.col("pos") == F.col("_n")).cast("int")
    events = events.select(*log.columns, "_start", (first - last).alias("_step"), last.alias("_last"))
    swept = sweep(events, [], ["ts", "_start", "case_id", "pos"], {"load": ("sum", F.col("_step"))})
    return swept.withColumn("load", F.col("load") + F.col("_last")).select(*log.columns, "load")


def running_entropy(log: DataFrame) -> DataFrame:
    """Entropy (bits) of the activity sequences seen so far, after each of the
    first 49 cases and every 10th one: ``sample_count, sample_entropy``.

    With c counts of N cases, H = log2 N - sum(c log2 c) / N; each case changes
    the sum by the step of c log2 c for its own sequence.
    """
    cases = number_cases(case_sequences(log))
    cases = cases.withColumn("_slice", slice_of("case_index"))
    counted = running(cases, SEQUENCE, ["_slice"], ["case_index"], {"_c": ("sum", F.lit(1))}).drop("_slice")
    c = F.col("_c").cast("double")
    step = c * F.log2(c) - F.when(c > 1, (c - 1) * F.log2(F.greatest(c - 1, F.lit(1.0)))).otherwise(0.0)
    summed = running_dense(counted, [], "case_index", {"_sum": ("sum", step)})
    n = F.col("case_index").cast("double")
    return (summed.where((F.col("case_index") < 50) | (F.col("case_index") % 10 == 0))
            .select(F.col("case_index").cast("bigint").alias("sample_count"),
                    (F.log2(n) - F.col("_sum") / n).alias("sample_entropy")))


# ---------------------------------------------------------------- series

def carry_forward(series: DataFrame, keys: list[str], order: str, value: str, handling: str = "last"
                  ) -> DataFrame:
    """Fill missing values of a dense series: ``last`` observation, ``mean`` of
    the key, or ``keep`` them null.  ``order`` is a dense 1-based index."""
    if handling == "keep":
        return series.withColumn("filled", F.col(value))
    if handling == "last":
        return running_dense(series, keys, order, {"filled": ("last", F.col(value))})
    if handling == "mean":
        means = series.groupBy(*keys).agg(F.avg(value).alias("_mean"))
        joined = series.join(means, keys) if keys else series.withColumn("_mean", means.scalar())
        return joined.withColumn("filled", F.coalesce(F.col(value), F.col("_mean"))).drop("_mean")
    raise ValueError(f"unknown handling {handling!r}")


HISTORY = 672  # fixed value: 24 * 28 hourly observations


def bounded_history(series: DataFrame, keys: list[str], order: str, value: str,
                    n: int = HISTORY, compatible: bool = True) -> DataFrame:
    """Count, mean and oldest value over the last ``n`` observations of a dense
    series; the compatible form keeps ``n + 1``, as the original queue does."""
    size = n + 1 if compatible else n
    # running sums, minus the running sums ``size`` observations earlier
    sums = running_dense(series, keys, order, {
        "_sum": ("sum", F.col(value)), "_count": ("sum", F.col(value).isNotNull().cast("int"))})
    back = neighbours(sums, keys, order, {"_old_sum": ("_sum", size), "_old_count": ("_count", size),
                                          "_oldest": (value, size - 1)})
    firsts = series.where(F.col(order) == 1).select(*keys, F.col(value).alias("_first"))
    joined = back.join(firsts, keys) if keys else back.withColumn("_first", firsts.scalar())
    count = F.col("_count") - F.coalesce("_old_count", F.lit(0))
    total = F.col("_sum") - F.coalesce("_old_sum", F.lit(0))
    return joined.select(
        *series.columns, count.alias("history_n"),
        F.when(count > 0, total / count).alias("history_mean"),
        F.when(F.col(order) >= size, F.col("_oldest")).otherwise(F.col("_first")).alias("history_oldest"))


SEASON = 24  # fixed value


def last_season(series: DataFrame, keys: list[str], order: str, index: str, value: str,
                season: int = SEASON) -> DataFrame:
    """Add ``seasonal``: the latest earlier non-null value with the same index
    modulo the season, else the latest earlier value."""
    phased = series.withColumn("_phase", F.pmod(F.col(index), F.lit(season))).withColumn(
        "_slice", slice_of(order))
    same = running(phased, [*keys, "_phase"], ["_slice"], [order],
                   {"_same": ("last", F.col(value))}, exclusive=True).drop("_slice", "_phase")
    prior = neighbours(same, keys, order, {"_prior": (value, 1)})
    return prior.withColumn("seasonal", F.coalesce("_same", "_prior")).drop("_same", "_prior")


def largest_keys(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The rows with the ``n`` largest order values per key.  A first round keeps
    ``n`` per salted part of a key, so one key never meets in one task whole."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(64)))
    part = Window.partitionBy(*keys, "_salt").orderBy(F.desc(order))
    top = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n)
    whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(order))
    return top.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= n).drop("_rn", "_salt")


def lookup_ranks(ranks: DataFrame, probes: DataFrame, keys: list[str], value: str, probe: str,
                 carry: list[str], strict: bool) -> DataFrame:
    """For every distinct probe, the ``carry`` columns of the largest ranked
    value <= probe (``strict``: < probe), null if there is none, and the totals
    of the key.  Ranked values and probes are swept together."""
    empty = F.lit(None)
    whole = [c for c in ranks.columns if c == "total" or c.startswith("total_")]
    marks = ranks.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_kind"), *carry, *whole)
    asks = probes.select(*keys, F.col(probe).cast("double").alias("_v")).distinct().select(
        *keys, "_v", F.lit(0 if strict else 2).alias("_kind"),
        *[empty.cast(marks.schema[c].dataType).alias(c) for c in [*carry, *whole]])
    swept = sweep(marks.unionByName(asks), keys, ["_v", "_kind"], {f"_at_{c}": ("last", F.col(c)) for c in carry},
                  overall={f"_all_{c}": ("max", F.col(c)) for c in whole})
    return swept.where(F.col("_kind") != 1).select(
        *keys, F.col("_v").alias(probe), *[F.col(f"_at_{c}").alias(c) for c in carry],
        *[F.col(f"_all_{c}").alias(c) for c in whole])


def sample_rank(ranks: DataFrame, probes: DataFrame, keys: list[str], value: str, probe: str) -> DataFrame:
    """Rank of a probe among sorted samples: index of the last sample <= probe,
    clamped to [0, n - 1]: ``keys, probe, rank, total``; keys without samples
    are left out."""
    found = lookup_ranks(ranks, probes, keys, value, probe, ["upto"], strict=False)
    return found.where(F.col("total").isNotNull()).select(
        *keys, probe, F.greatest(F.coalesce("upto", F.lit(0)) - 1, F.lit(0)).alias("rank"), "total")


RESOLUTION = 200  # fixed value


def case_time_series(log: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """Relative-time points of every case: ``case_id, t, active``.

    Each event maps to t = round(resolution * elapsed / duration).  An activity
    is active at its own point; one opened by a ``start`` lifecycle stays active
    until its next event.  Points between events carry the open set forward.
    A case without duration has the single point 0.
    """
    points, active = active_points(log, resolution)
    grid = points.select("case_id", "_end").distinct().select(
        "case_id", F.explode(F.sequence(F.lit(0), F.col("_end"))).alias("t"))
    return (grid.join(active, ["case_id", "t"], "left")
            .withColumn("active", F.coalesce("active", F.array().cast("array<string>"))))


def point_at(ms: Column, resolution: int = RESOLUTION) -> Column:
    """The point of a time of a case that begins at ``_t0`` and ends at ``_t1``."""
    span = F.col("_t1") - F.col("_t0")
    return F.when(span == 0, 0).otherwise(round_half_up(
        F.lit(float(resolution)) * (ms - F.col("_t0")) / F.greatest(span, F.lit(1)))).cast("int")


def last_point(resolution: int = RESOLUTION) -> Column:
    """The last point of the case."""
    return F.when(F.col("_t1") - F.col("_t0") == 0, 0).otherwise(resolution)


def active_points(log: DataFrame, resolution: int = RESOLUTION) -> tuple[DataFrame, DataFrame]:
    """The events at their points (``case_id, pos, activity, t, opens, _end``, where ``_end`` is the last point of the
    case), and the points of ``case_time_series`` at which an activity is active (``case_id, t, active``)."""
    ms = epoch_ms("ts")
    bounded = with_case_values(log, _t0=F.min_by(ms, "pos"), _t1=F.max_by(ms, "pos"))
    starts = (F.lower(F.coalesce(F.col("lifecycle"), F.lit("complete"))) == "start"
              if "lifecycle" in log.columns else F.lit(False))
    points = bounded.select("case_id", "pos", "activity", point_at(ms, resolution).alias("t"), starts.alias("opens"),
                            last_point(resolution).alias("_end"))
    own = points.select("case_id", "t", "activity")
    spans = own
    if "lifecycle" in log.columns:
        # per activity: an opening stays active up to the next event of the same activity
        ranked = running_in_case(points, ["activity"], {"_n": ("sum", F.lit(1))}, log=log)
        ranked = neighbours(ranked.withColumn("_n", F.col("_n").cast("bigint")), ["case_id", "activity"], "_n",
                            {"_until": ("t", -1)})
        held = ranked.where("opens").select("case_id", "activity", F.explode(
            F.sequence("t", F.coalesce("_until", "_end"))).alias("t"))
        spans = own.unionByName(held.select("case_id", "t", "activity"))
    active = spans.distinct().groupBy("case_id", "t").agg(F.array_sort(F.collect_set("activity")).alias("active"))
    return points, active
