"""Directly-follows and any-distance temporal relations between activities.

Relations between all ordered pairs (i < j) of a case are summed without
listing the pairs: with the running count n, sum S1 and sum of squares S2 of the
earlier times of activity a, the gaps from all earlier a's to an event at t add
up to n*t - S1, and their squares to n*t^2 - 2*t*S1 + S2.  Sums are decimals, so
differences of running sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.maths import UNIT_MS, epoch_ms
from caseloom.plans.lineage import stored
from caseloom.plans.slices import long_cases, neighbours, running, running_in_case, sweep, with_case_values

START = "_Start"
TIME = "decimal(15,0)"
EXACT = "decimal(38,0)"
MEETING_ROWS = 100_000  # events of a task that repeats each of them per activity of its case


def _moments(n: Column, total: Column, squares: Column, unit: str) -> tuple[Column, Column]:
    """Mean and sample deviation (0 for one sample) in a unit, from ms sums."""
    count, s, q = n.cast("double"), total.cast("double"), squares.cast("double")
    variance = F.greatest(q - s * s / count, F.lit(0.0)) / F.greatest(count - 1, F.lit(1.0))
    factor = UNIT_MS[unit]
    return s / count / factor, F.when(count > 1, F.sqrt(variance)).otherwise(0.0) / factor


def directly_follows(log: DataFrame, unit: str = "minutes") -> DataFrame:
    """``before, after, n, mean, sd`` of the gap between adjacent events; the
    ``_Start`` rows hold the time from the case start to every event."""
    links = neighbours(log, ["case_id"], "pos", {"_next": ("activity", -1), "_next_ms": (epoch_ms("ts"), -1)})
    factor = F.lit(UNIT_MS[unit])
    adjacent = links.where(F.col("_next").isNotNull()).select(
        F.col("activity").alias("before"), F.col("_next").alias("after"),
        ((F.col("_next_ms") - epoch_ms("ts")) / factor).alias("gap"))
    begun = with_case_values(log, _t0=F.min_by(epoch_ms("ts"), "pos")).select(
        F.lit(START).alias("before"), F.col("activity").alias("after"),
        ((epoch_ms("ts") - F.col("_t0")) / factor).alias("gap"))
    return adjacent.unionByName(begun).groupBy("before", "after").agg(
        F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean"),
        F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("sd"))


def relative_positions(dfg: DataFrame) -> DataFrame:
    """Mean time from start / largest such mean, and whether it is the latest."""
    starts = dfg.where(F.col("before") == START).select(F.col("after").alias("activity"), "mean")
    top = starts.agg(F.max("mean").alias("m"), F.max_by("activity", F.struct("mean", "activity")).alias("a"))
    return starts.select("activity", "mean",
                         F.try_divide(F.col("mean"), top.select("m").scalar()).alias("relative_position"),
                         (F.col("activity") == top.select("a").scalar()).alias("latest"))


def temporal_matrix(dfg: DataFrame) -> DataFrame:
    """Normalised force (mean gap) and weight (count) of every connection."""
    whole = dfg.agg(F.max("mean").alias("hi"), F.sum("mean").alias("sum"), F.max("n").alias("n"))
    divisor = F.when(F.col("before") == START, whole.select("hi").scalar()).otherwise(whole.select("sum").scalar())
    return dfg.select("before", "after", F.try_divide(F.col("mean"), divisor).alias("force"),
                      (F.col("n") / whole.select("n").scalar()).alias("weight"))


def _prefix_moments(log: DataFrame, start: bool = False) -> DataFrame:
    """Per event and activity seen earlier in the case: count, time sums,
    position sum and last position.  One row per event and *distinct* activity
    of its case, never one per pair of events.  With ``start`` every event also
    has a row with ``start`` true: the case start, seen once at time 0, right
    before the event.  ``log`` is a stored table."""
    timed = log.withColumn("_ms", epoch_ms("ts"))
    short = long_cases(log).isEmpty()
    if short:  # the events of a case meet once, for its values and for the sums
        timed = timed.repartition(max(1, -(-log.count() // MEETING_ROWS)), "case_id")
        case = Window.partitionBy("case_id")
        timed = timed.withColumns({"_t0": F.min_by("_ms", "pos").over(case), "_classes": F.collect_set("activity").over(case)})
    else:
        timed = with_case_values(timed, _t0=F.min_by("_ms", "pos"), _classes=F.collect_set("activity"))
    t = (F.col("_ms") - F.col("_t0")).cast(TIME)
    others = F.transform("_classes", lambda c: F.struct(c.alias("other"), F.lit(False).alias("start")))
    if start:
        others = F.concat(F.array(F.struct(F.lit(START).alias("other"), F.lit(True).alias("start"))), others)
    base = timed.select("case_id", "pos", "activity", t.alias("t"), F.explode(others).alias("_o")).select(
        "case_id", "pos", "activity", "t", "_o.other", "_o.start")
    here = (F.col("activity") == F.col("other")) & ~F.col("start")
    sums = {
        "n": ("sum", here.cast("int")),
        "s1": ("sum", F.when(here, F.col("t")).otherwise(0).cast(EXACT)),
        "s2": ("sum", F.when(here, F.col("t") * F.col("t")).otherwise(0).cast(EXACT)),
        "p1": ("sum", F.when(here, F.col("pos")).otherwise(0)),
        "last": ("max", F.when(here, F.col("pos"))),
    }
    if short:
        seen = running(base, ["case_id", "other", "start"], [], ["pos"], sums, exclusive=True)
    else:
        seen = running_in_case(base, ["other", "start"], sums, exclusive=True, log=log)
    if start:
        before = F.col("pos") - 1
        seen = seen.withColumns({"n": F.when(F.col("start"), 1).otherwise(F.col("n")),
                                 "p1": F.when(F.col("start"), before).otherwise(F.col("p1")),
                                 "last": F.when(F.col("start"), before).otherwise(F.col("last"))})
    return seen.where(F.col("n") > 0).drop("start")


def pairwise_gaps(log: DataFrame, unit: str = "minutes") -> DataFrame:
    """All ordered pairs i < j per case, summed per activity pair:
    ``before, after, n, mean, sd, mean_distance, n_direct``; ``_Start`` counts
    as distance 1 to every event.  The events are stored first, since they are
    read twice."""
    log = stored(log.select("case_id", "pos", "activity", "ts"))
    m = _prefix_moments(log, start=True)
    t, n = F.col("t"), F.col("n").cast("decimal(20,0)")
    both = m.groupBy(F.col("other").alias("before"), F.col("activity").alias("after")).agg(
        F.sum("n").alias("n"), F.sum((n * t - F.col("s1")).cast(EXACT)).alias("_s"),
        F.sum((n * t * t - 2 * t * F.col("s1") + F.col("s2")).cast(EXACT)).alias("_q"),
        F.sum(F.col("n") * F.col("pos") - F.col("p1")).alias("_d"),
        F.count_if(F.col("last") == F.col("pos") - 1).alias("n_direct"))
    mean, sd = _moments(F.col("n"), F.col("_s"), F.col("_q"), unit)
    return both.select("before", "after", "n", mean.alias("mean"), sd.alias("sd"),
                       (F.col("_d") / F.col("n")).alias("mean_distance"), "n_direct")


def class_ids(log: DataFrame) -> DataFrame:
    """``activity, id``: 0-based ids by first appearance in case order."""
    events = with_case_values(log, _start=F.min_by("ts", "pos"))
    first = events.groupBy("activity").agg(F.min(F.struct("_start", "case_id", "pos")).alias("_at"))
    ranked = sweep(first, [], ["_at"], {"id": ("sum", F.lit(1))})
    return ranked.select("activity", (F.col("id") - 1).cast("bigint").alias("id"))


def temporal_profile(log: DataFrame) -> DataFrame:
    """Signed distances between an event and another one, split by the set of
    activities seen strictly between, for pairs whose other id is not smaller.

    Columns ``event, other, between`` (sorted names), ``n``, ``sum_ms``,
    ``sum_sq``, ``n_negative`` and ``n_positive``.  Cases must be sorted by time.

    Going back from event j the between-set only changes at the last positions
    p1 > p2 > ... of the distinct activities, so the pairs of j fall into the
    segments [p1, j), [p2, p1), ... [1, pm).  A segment is the prefix at its end
    minus the prefix at its begin; the requests for a prefix are summed per
    (case, position, activity, set) before they meet the prefixes.
    """
    log = stored(log.select("case_id", "pos", "activity", "ts"))
    prefix = stored(_prefix_moments(log))
    by_recency = Window.partitionBy("case_id", "pos").orderBy(F.desc("last"))
    listed = F.collect_list("other").over(by_recency.rowsBetween(Window.unboundedPreceding, -1))
    segments = (prefix.withColumn("_rank", F.row_number().over(by_recency))
                .withColumn("_next", F.coalesce(F.lead("last").over(by_recency), F.lit(1).cast("bigint")))
                .withColumn("_inner", F.sort_array(F.coalesce(listed, F.array().cast("array<string>"))))
                .withColumn("_outer", F.sort_array(F.concat("_inner", F.array("other")))))
    # events of a case with the same time as j begin at position ``_tied``
    same = log.groupBy("case_id", epoch_ms("ts").alias("_ms")).agg(F.min("pos").alias("_tied"),
                                                                 F.max("pos").alias("_until"))
    ties = same.where(F.col("_until") > F.col("_tied")).select(
        "case_id", "_tied", F.explode(F.sequence("_tied", "_until")).alias("pos"))
    segments = segments.join(ties, ["case_id", "pos"], "left").withColumn(
        "_tied", F.coalesce("_tied", "pos"))
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    last, tied_from, first = F.col("last"), F.col("_tied"), F.col("_rank") == 1

    def request(at: Column, names: str, sign: Column, tied: Column) -> Column:
        return F.struct(at.alias("at"), F.col(names).alias("set"), sign.alias("sign"), tied.alias("tied"))

    asks = F.array_compact(F.array(
        request(last, "_inner", -one, zero), request(last, "_outer", one, zero),
        F.when(first, request(F.col("pos"), "_inner", one, zero)),
        F.when(last > tied_from, request(last, "_outer", zero, one)),
        F.when(last > tied_from, request(F.greatest("_next", "_tied"), "_outer", zero, -one)),
        F.when(first & (F.col("pos") > tied_from), request(F.col("pos"), "_inner", zero, one)),
        F.when(first & (F.col("pos") > tied_from), request(F.greatest("last", "_tied"), "_inner", zero, -one))))
    t = F.col("t")
    wanted = segments.select("case_id", F.col("activity").alias("after"), "t", F.explode(asks).alias("_r"))
    sign = F.col("_r.sign").cast("decimal(2,0)")
    wanted = wanted.groupBy("case_id", F.col("_r.at").alias("pos"), "after", F.col("_r.set").alias("_set")).agg(
        F.sum("_r.sign").alias("c0"), F.sum((sign * t).cast(EXACT)).alias("c1"),
        F.sum((sign * t * t).cast(EXACT)).alias("c2"), F.sum("_r.tied").alias("z"))
    states = prefix.select("case_id", "pos", F.col("other").alias("before"), "n", "s1", "s2")
    n, c0 = F.col("n").cast("decimal(20,0)"), F.col("c0").cast("decimal(20,0)")
    met = wanted.join(states, ["case_id", "pos"])
    pairs = met.groupBy("before", "after", F.col("_set").alias("between")).agg(
        F.sum(F.col("c0") * F.col("n")).alias("n"),
        F.sum((n * F.col("c1") - c0 * F.col("s1")).cast(EXACT)).alias("gap"),
        F.sum((n * F.col("c2") - 2 * F.col("s1") * F.col("c1") + c0 * F.col("s2")).cast(EXACT)).alias("sq"),
        F.sum(F.col("z") * F.col("n")).alias("tied")).where(F.col("n") > 0)
    ids = class_ids(log)
    named = (pairs.join(ids.select(F.col("activity").alias("before"), F.col("id").alias("_i")), "before")
             .join(ids.select(F.col("activity").alias("after"), F.col("id").alias("_j")), "after"))
    # backward from j: other = before; forward from i: other = after, negative distance
    sides = F.array_compact(F.array(
        F.when(F.col("_i") >= F.col("_j"), F.struct(
            F.col("after").alias("event"), F.col("before").alias("other"), F.col("gap").alias("sum_ms"),
            zero.alias("n_negative"), (F.col("n") - F.col("tied")).alias("n_positive"))),
        F.when(F.col("_j") >= F.col("_i"), F.struct(
            F.col("before").alias("event"), F.col("after").alias("other"), (-F.col("gap")).alias("sum_ms"),
            (F.col("n") - F.col("tied")).alias("n_negative"), zero.alias("n_positive")))))
    return (named.select("between", "n", "sq", F.explode(sides).alias("_s"))
            .groupBy(F.col("_s.event").alias("event"), F.col("_s.other").alias("other"), "between")
            .agg(F.sum("n").alias("n"), F.sum("_s.sum_ms").cast("double").alias("sum_ms"),
                 F.sum("sq").cast("double").alias("sum_sq"), F.sum("_s.n_negative").alias("n_negative"),
                 F.sum("_s.n_positive").alias("n_positive")))


def durations_excluding(profile: DataFrame, sequence: list[str]) -> DataFrame:
    """Per event, statistics of its distances to every *other* activity over
    samples whose between-set shares nothing with ``sequence``; seen from the
    other side the sign flips: ``event, n, sum_ms, sum_sq, n_negative``."""
    kept = profile.where((F.col("event") != F.col("other")) & ~F.arrays_overlap(
        "between", F.array(*[F.lit(s) for s in sequence]).cast("array<string>")))
    flipped = kept.select(F.col("other").alias("event"), "n", (-F.col("sum_ms")).alias("sum_ms"), "sum_sq",
                          F.col("n_positive").alias("n_negative"))
    own = kept.select("event", "n", "sum_ms", "sum_sq", "n_negative")
    return own.unionByName(flipped).groupBy("event").agg(
        F.sum("n").alias("n"), F.sum("sum_ms").alias("sum_ms"), F.sum("sum_sq").alias("sum_sq"),
        F.sum("n_negative").alias("n_negative"))


def temporal_score(mean: Column, n_negative: Column, alpha: float = 0.7) -> Column:
    """alpha / (|mean| + 1) + (1 - alpha) / ln(2 + count below zero)."""
    return F.lit(alpha) / (F.abs(mean) + 1) + F.lit(1 - alpha) / F.ln(n_negative + 2)
