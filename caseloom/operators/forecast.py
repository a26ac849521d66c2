"""Hourly series, forecasts, branch probabilities and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.maths import epoch_ms
from caseloom.operators.distributions import EPSILON, _params
from caseloom.operators.windows import SEASON, carry_forward
from caseloom.plans.ranks import clamped_percentile, value_ranks
from caseloom.plans.slices import sweep

HOUR_MS = 3_600_000
METHODS = ("average", "naive", "drift", "seasonal")


def time_index(millis: Column, granularity_ms: int = HOUR_MS) -> Column:
    return F.floor(millis / F.lit(granularity_ms)).cast("bigint")


def build_series(df: DataFrame, keys: list[str], agg: str = "count", missing: str = "keep",
                 granularity_ms: int = HOUR_MS, before: Column | None = None) -> DataFrame:
    """Dense series per key: ``keys, idx, place, value`` from the first to the
    last index with data; ``place`` counts from 1.

    ``count`` counts rows by their time; ``average`` averages ``duration`` (ms)
    by the *start*, end minus duration.  ``before`` keeps rows strictly earlier.
    ``missing``: ``keep`` null, ``last`` observation or ``mean`` of the key.
    """
    rows = df if before is None else df.where(F.col("ts") < before)
    ms = epoch_ms("ts")
    if agg == "average":
        start = ms - F.col("duration").cast("bigint")
        seen = rows.groupBy(*keys, time_index(start, granularity_ms).alias("idx")).agg(F.avg("duration").alias("value"))
    elif agg == "count":
        seen = rows.groupBy(*keys, time_index(ms, granularity_ms).alias("idx")).agg(
            F.count(F.lit(1)).cast("double").alias("value"))
    else:
        raise ValueError(f"unknown aggregate {agg!r}")
    spans = seen.groupBy(*keys).agg(F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    grid = spans.select(*keys, "_lo", F.explode(F.sequence("_lo", "_hi")).alias("idx"))
    dense = grid.join(seen, [*keys, "idx"], "left").select(
        *keys, "idx", (F.col("idx") - F.col("_lo") + 1).alias("place"), "value")
    if missing == "keep":
        return dense
    return carry_forward(dense, keys, "place", "value", missing).drop("value").withColumnRenamed("filled", "value")


def _point(series: DataFrame, keys: list[str], prediction: Column) -> DataFrame:
    return series.groupBy(*keys).agg(prediction.alias("prediction")).select(
        *keys, "prediction", F.col("prediction").alias("lower"), F.col("prediction").alias("upper"))


def forecast_average(series: DataFrame, keys: list[str]) -> DataFrame:
    """Mean with 5 and 95 percent sample bounds."""
    known = series.where(F.col("value").isNotNull())
    bounds = clamped_percentile(value_ranks(known, keys, "value"), keys, "value", {"lower": 5.0, "upper": 95.0})
    means = known.groupBy(*keys).agg(F.avg("value").alias("prediction"))
    return means.join(bounds.drop("total"), keys).select(*keys, "prediction", "lower", "upper")


def forecast_naive(series: DataFrame, keys: list[str]) -> DataFrame:
    return _point(series, keys, F.max_by("value", F.when(F.col("value").isNotNull(), F.col("idx"))))


def forecast_drift(series: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Line through the first and last known value, never below zero; the
    horizon runs from the last index to ``target``."""
    known = F.when(F.col("value").isNotNull(), F.col("idx"))
    ends = series.groupBy(*keys).agg(
        F.min_by("value", known).alias("_first"), F.max_by("value", known).alias("_last"),
        (F.max("idx") - F.min(known) + 1).alias("_t"), F.max("idx").alias("_end"))
    h = F.lit(target) - F.col("_end")
    line = F.col("_last") + h * (F.col("_last") - F.col("_first")) / F.greatest(F.col("_t") - 1, F.lit(1))
    return ends.withColumn("prediction", F.when(F.col("_t") > 1, F.greatest(line, F.lit(0.0))).otherwise(F.col("_last"))
                           ).select(*keys, "prediction", F.col("prediction").alias("lower"),
                                    F.col("prediction").alias("upper"))


def forecast_seasonal(series: DataFrame, keys: list[str], target: int, season: int = SEASON) -> DataFrame:
    """Latest known value of the same season phase, else the latest one."""
    known = F.when(F.col("value").isNotNull(), F.col("idx"))
    phase = F.when(F.pmod(F.col("idx"), F.lit(season)) == target % season, known)
    return _point(series, keys, F.coalesce(F.max_by("value", phase), F.max_by("value", known)))


def forecast(series: DataFrame, keys: list[str], method: str, target: int) -> DataFrame:
    if method == "average":
        return forecast_average(series, keys)
    if method == "naive":
        return forecast_naive(series, keys)
    if method == "drift":
        return forecast_drift(series, keys, target)
    if method == "seasonal":
        return forecast_seasonal(series, keys, target)
    raise ValueError(f"unknown method {method!r}")


def forecast_branch_probs(decisions: DataFrame, method: str, target: int, missing: str = "last",
                          before: Column | None = None) -> DataFrame:
    """Branch probabilities from forecast decision counts: ``state, activity,
    prediction, probability``.  ``last_observation`` uses the plain counts; the
    only option of a state has probability 1."""
    keys = ["state", "activity"]
    if method == "last_observation":
        rows = decisions if before is None else decisions.where(F.col("ts") < before)
        predicted = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("prediction"))
    else:
        series = build_series(decisions, keys, "count", missing, before=before)
        predicted = forecast(series, keys, method, target).select(*keys, "prediction")
    totals = predicted.groupBy("state").agg(F.sum("prediction").alias("_sum"), F.count(F.lit(1)).alias("_options"))
    share = F.when(F.col("_options") == 1, 1.0).otherwise(F.try_divide(F.col("prediction"), F.col("_sum")))
    return predicted.join(totals, "state").select(*keys, "prediction", share.alias("probability"))


def to_dist(predictions: DataFrame) -> DataFrame:
    """A point where the bounds agree, else a normal with half their distance
    as deviation: adds ``dist_type, params``."""
    point = F.abs(F.col("upper") - F.col("lower")) < EPSILON
    return predictions.withColumns({
        "dist_type": F.when(point, "DETERMINISTIC").otherwise("NORMAL"),
        "params": F.when(point, _params(F.col("prediction"))).otherwise(
            _params(F.col("prediction"), (F.col("upper") - F.col("lower")) / 2))})


def single_bucket(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction for keys whose data fall into one time bucket: mean with 2.5
    and 97.5 percent bounds."""
    known = samples.where(F.col("duration").isNotNull())
    bounds = clamped_percentile(value_ranks(known, keys, "duration"), keys, "duration", {"lower": 2.5, "upper": 97.5})
    return known.groupBy(*keys).agg(F.avg("duration").alias("prediction")).join(bounds.drop("total"), keys)


def calendar_features(df: DataFrame, ts: str, drop_weekends: bool = False) -> DataFrame:
    """Add ``hour`` and ``weekday`` (0 = Sunday); optionally leave weekends out."""
    marked = df.withColumns({"hour": F.hour(ts), "weekday": F.dayofweek(ts) - 1})
    return marked.where(~F.col("weekday").isin(0, 6)) if drop_weekends else marked


def rolling_fit(training: DataFrame, probes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and deviation of the training values strictly before each
    probe time: training and probes are swept together."""
    x = F.col(value).cast("double")
    left = training.select(*keys, "ts", F.lit(1).alias("_kind"), x.alias("_x"))
    extra = [c for c in probes.columns if c not in (*keys, "ts")]
    right = probes.select(*keys, "ts", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_x"),
                          F.struct(*extra).alias("_probe"))
    both = left.withColumn("_probe", F.lit(None).cast(right.schema["_probe"].dataType)).unionByName(right)
    swept = sweep(both, keys, ["ts", "_kind"], {
        "n": ("sum", F.col("_x").isNotNull().cast("bigint")), "_s": ("sum", F.coalesce("_x", F.lit(0.0))),
        "_q": ("sum", F.coalesce(F.col("_x") * F.col("_x"), F.lit(0.0)))}).where(F.col("_kind") == 0)
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    spread = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0))
    return swept.select(*keys, "ts", *[F.col(f"_probe.`{c}`").alias(c) for c in extra], "n",
                        F.when(F.col("n") > 0, F.col("_s") / n).alias("mean"),
                        F.when(F.col("n") > 1, F.sqrt(spread)).otherwise(0.0).alias("sd"))
