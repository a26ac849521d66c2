"""Continuous forms of the batch operators (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.distributions import with_density
from caseloom.plans.models import join_model

DELAY = "1 hour"


def hourly_activity(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Tumbling hourly count and mean value per activity; append mode emits an
    hour once the watermark passes it, later rows are dropped."""
    return windowed_activity(stream, "1 hour", None, delay)


def sliding_activity(stream: DataFrame, length: str = "6 hours", step: str = "1 hour", delay: str = DELAY) -> DataFrame:
    return windowed_activity(stream, length, step, delay)


def windowed_activity(stream: DataFrame, length: str, step: str | None, delay: str) -> DataFrame:
    span = F.window("ts", length, step) if step else F.window("ts", length)
    return (stream.withWatermark("ts", delay).groupBy(span.alias("w"), "activity")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "activity", "n", "mean_value"))


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Cases as sessions: start, last event and event count of every run of
    events of a key without a pause of ``gap``."""
    return (stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
            .select(key, F.col("w.start").alias("start"), "last", "n"))


def running_normal(stream: DataFrame) -> DataFrame:
    """Normal estimator per activity, updated with every batch.  Partial sums are
    combined before the shuffle, so a frequent activity costs one row per task."""
    x = F.col("value")
    return stream.groupBy("activity").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var_pop"),
        F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var_samp"), F.count_if(x < 0).alias("n_negative"))


def outlier_flags(stream: DataFrame, dists: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Score events against static fits and cut-offs (stateless)."""
    scored = with_density(stream.withColumn("duration", F.col("value")), dists)
    flagged = join_model(scored, cutoffs, ["activity"], "left")
    return flagged.withColumn("is_outlier", F.coalesce(F.col("log_density") < F.col("cutoff"), F.lit(False)))


FORECAST_SCHEMA = "activity string, at timestamp, n bigint, naive double, drift double, history int"
FORECAST_STATE = "hours array<bigint>, counts array<bigint>"
HOUR_NS = 3_600_000_000_000


def rolling_forecast(hours: DataFrame, history: int = 672, late: int = 48) -> DataFrame:
    """After every closed hour, forecasts of the next one per activity from the
    counts of the last ``history`` hours.

    ``hours`` streams the files ``hourly_activity`` writes (``activity, at, n``),
    so the state of an activity sees one row per hour, whatever its share of the
    events.  Missing hours count as unknown.  An hour that comes in a later batch
    takes its place, and the forecasts of it and of the hours behind it are sent
    (again): the last row of an hour counts.  Hours more than ``late`` before the
    newest one come too late; the state holds the hours that forecasts need.
    """

    def forecast(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        held = dict(zip(*state.get)) if state.exists else {}
        newest, first_new, shift = max(held, default=None), None, 0
        rows = sorted((int(t.value), int(n)) for b in batches for t, n in zip(b["at"], b["n"]))
        for ns, n in rows:
            hour, shift = divmod(ns, HOUR_NS)
            if newest is None or hour > newest - late:
                held[hour] = n
                first_new = hour if first_new is None else min(first_new, hour)
        order = sorted(held)
        out, back = [], 0
        for place, hour in enumerate(order):
            while order[back] <= hour - history:
                back += 1
            if first_new is not None and hour >= first_new:
                value, span = float(held[hour]), hour - order[back]
                slope = (value - held[order[back]]) / span if span else 0.0
                out.append((key[0], pd.Timestamp(hour * HOUR_NS + shift), held[hour], value, max(0.0, value + slope),
                            place - back + 1))
        kept = [h for h in order if h > order[-1] - history - late]
        state.update((kept, [held[h] for h in kept]))
        yield pd.DataFrame(out, columns=["activity", "at", "n", "naive", "drift", "history"])

    return hours.groupBy("activity").applyInPandasWithState(
        forecast, FORECAST_SCHEMA, FORECAST_STATE, "append", "NoTimeout")


GAP_SCHEMA = "case_id string, event_id bigint, ms bigint, gap_ms bigint"
GAP_STATE = "cases array<string>, lasts array<bigint>, waiting array<string>, ids array<bigint>, times array<bigint>"


def event_gaps(stream: DataFrame, delay: str = DELAY, forget_ms: int | None = None, buckets: int = 1024) -> DataFrame:
    """Time since the previous event of the case (0 for the first), in the order
    of the log: by microsecond, then event.  Events wait until the watermark
    passes them, so late ones inside the delay are ordered; the state of a case
    is its last time and the events of the delay.

    Cases are many and short, so those of one of ``buckets`` hash values share a
    state and are ordered at once.  A case is kept for ever; with ``forget_ms``
    it is forgotten so long after its last event, and an event after that counts
    as the first of its case.
    """
    timed = stream.select("case_id", "event_id", "ts", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).alias("bucket")
                          ).withWatermark("ts", delay)

    def order(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        cases, lasts, waiting, ids, times = state.get if state.exists else ([], [], [], [], [])
        held = dict(zip(cases, lasts))
        parts = [pd.DataFrame({"case_id": pd.Series(waiting, dtype="object"), "event_id": pd.Series(ids, dtype="int64"),
                               "us": pd.Series(times, dtype="int64")})]
        if not state.hasTimedOut:
            parts += [pd.DataFrame({"case_id": b["case_id"], "event_id": b["event_id"], "us": b["ts"].astype(
                "datetime64[us, UTC]" if b["ts"].dt.tz is not None else "datetime64[us]").astype("int64")}) for b in batches]
        rows = pd.concat(parts).sort_values(["us", "event_id"], kind="stable")
        mark = state.getCurrentWatermarkMs()
        rows["ms"] = rows["us"] // 1000
        due, rest = rows[rows["ms"] < mark], rows[rows["ms"] >= mark]
        earlier = due.groupby("case_id", sort=False)["ms"].shift()
        earlier = earlier.fillna(due["case_id"].map(held) // 1000 if held else due["ms"]).fillna(due["ms"])
        out = pd.DataFrame({"case_id": due["case_id"], "event_id": due["event_id"], "ms": due["ms"],
                            "gap_ms": due["ms"] - earlier.astype("int64")})
        held.update((c, int(us)) for c, us in zip(due["case_id"], due["us"]))
        first = [int(rest["ms"].iloc[0])] if len(rest) else []
        if forget_ms is not None:
            open_cases = set(rest["case_id"])
            held = {c: us for c, us in held.items() if c in open_cases or us // 1000 + forget_ms >= mark}
            first += [us // 1000 + forget_ms for c, us in held.items() if c not in open_cases]
        if held or len(rest):
            state.update((list(held), list(held.values()), rest["case_id"].tolist(), rest["event_id"].tolist(),
                          rest["us"].tolist()))
            if first:
                state.setTimeoutTimestamp(max(min(first), mark) + 1)
        elif state.exists:
            state.remove()
        yield out

    return timed.groupBy("bucket").applyInPandasWithState(order, GAP_SCHEMA, GAP_STATE, "append", "EventTimeTimeout")
