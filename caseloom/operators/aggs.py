"""Case and key aggregates."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.maths import (epoch_ms, nan_to_null, student_quantile_column, to_unit)
from caseloom.operators.filters import sort_cases
from caseloom.plans.ranks import clamped_percentile, value_ranks
from caseloom.plans.slices import positions


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


# ---------------------------------------------------------------- cases

def case_durations(log: DataFrame) -> DataFrame:
    """``case_id, duration``: ms from the first to the last recorded event."""
    ms = epoch_ms("ts")
    return log.groupBy("case_id").agg((F.max_by(ms, "pos") - F.min_by(ms, "pos")).alias("duration"))


def duration_stats(log: DataFrame, unit: str = "milliseconds") -> DataFrame:
    """One row of statistics of the case durations."""
    durations = case_durations(log).select(to_unit(F.col("duration"), unit).alias("d"))
    base = durations.agg(
        F.count("d").alias("n"), F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"),
        _zero(F.stddev_samp("d")).alias("sd"), _zero(F.var_samp("d")).alias("variance"), F.sum("d").alias("sum"))
    middle = clamped_percentile(value_ranks(durations, [], "d"), [], "d", {"median": 50.0}).select("median")
    return base.withColumn("median", middle.scalar())


def mean_duration(log: DataFrame) -> Column:
    """Mean case duration in ms as a scalar subquery."""
    return case_durations(log).agg(F.avg("duration")).scalar()


def case_bounds(log: DataFrame, buffer_ms: int = 10) -> DataFrame:
    ms = epoch_ms("ts")
    return log.groupBy("case_id").agg((F.min(ms) - buffer_ms).alias("lower"), (F.max(ms) + buffer_ms).alias("upper"))


def earliest(log: DataFrame) -> DataFrame:
    return log.agg(F.min(epoch_ms("ts")).alias("earliest"))


def mean_interarrival(log: DataFrame, unit: str = "hours", buffer_ms: int = 10) -> DataFrame:
    """(buffered end of the last case in start order - start of the first) / cases."""
    ms = epoch_ms("ts")
    ends = log.groupBy("case_id").agg(F.min_by("ts", "pos").alias("start"), F.max(ms).alias("last_ms"))
    total = ends.agg(F.count(F.lit(1)).alias("n"), F.min(epoch_ms("start")).alias("first"),
                     F.max_by("last_ms", F.struct("start", "case_id")).alias("last"))
    return total.select("n", (to_unit(F.col("last") + buffer_ms - F.col("first"), unit) / F.col("n"))
                        .alias("mean_interarrival"))


# ---------------------------------------------------------------- grouped helpers

def group_rows(df: DataFrame, key: Callable[[DataFrame], Column], order: list[str]) -> DataFrame:
    """Rows grouped by a key, in long form: ``key`` and the place in the group."""
    return positions(df.withColumn("key", key(df)), ["key"], order, "place")


def sum_by(df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.sum(value).alias("sum"))


def avg_by(df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.avg(value).alias("avg"))


def max_by(df: DataFrame, key: Column, value: Column, order: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.max_by(value, order).alias("value"))


def nanmean(col: Column) -> Column:
    return F.avg(nan_to_null(col))


def normal_stats(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """n, sums, mean, variances (0 for n <= 1), deviation and count below zero."""
    x = F.col(col).cast("double")
    stats = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_sq"), F.avg(x).alias("mean"),
        F.var_pop(x).alias("var_pop"), _zero(F.var_samp(x)).alias("var_samp"),
        F.count_if(x < 0).alias("n_negative"))
    return stats.withColumn("sd", F.sqrt("var_samp"))


def remove_from_stats(stats: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Take observations out again, by their sufficient statistics."""
    gone = removed.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "sum", "sum_sq", "n_negative")])
    left = stats.select(*keys, "n", "sum", "sum_sq", "n_negative").join(gone, keys, "left")
    for c in ("n", "sum", "sum_sq", "n_negative"):
        left = left.withColumn(c, F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).drop(f"_{c}")
    n = F.col("n").cast("double")
    spread = F.greatest(F.col("sum_sq") - F.col("sum") * F.col("sum") / n, F.lit(0.0))
    return (left.where("n > 0").withColumn("mean", F.col("sum") / n).withColumn("var_pop", spread / n)
            .withColumn("var_samp", F.when(n > 1, spread / F.greatest(n - 1, F.lit(1.0))).otherwise(0.0))
            .withColumn("sd", F.sqrt("var_samp")))


def mean_ci(df: DataFrame, keys: list[str], col: str, level: float = 0.99) -> DataFrame:
    """Mean, confidence-interval width and error in percent of the mean."""
    stats = df.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"),
                                  F.var_samp(col).alias("_var"))
    t = student_quantile_column(1 - (1 - level) / 2, F.col("n") - 1)
    width = t * 2.0 * F.sqrt(F.col("_var") / F.col("n"))
    stats = stats.withColumn("ci_width", width).withColumn("half_width", F.col("ci_width") / 2)
    rest = F.col("mean") - F.col("half_width")
    return stats.withColumn("error_percent", F.when(rest != 0, (F.col("mean") / rest - 1) * 100)).drop("_var")


# ---------------------------------------------------------------- evaluation

def retrieval_stats(df: DataFrame, predicted: Column, actual: Column, keys: list[str] | None = None) -> DataFrame:
    counts = df.groupBy(*(keys or [])).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return (counts.withColumn("precision", F.try_divide(tp, tp + fp))
            .withColumn("recall", F.try_divide(tp, tp + fn))
            .withColumn("accuracy", F.try_divide(tp + tn, tp + fp + tn + fn)))


def roc(df: DataFrame, score: str, label: Column, keys: list[str] | None = None) -> DataFrame:
    """One row per distinct score, ascending, with cumulative true and false
    positive rates (rows with a score up to this one are called positive)."""
    keys = keys or []
    marked = df.select(*keys, score, label.cast("bigint").alias("_hit"))
    ranked = value_ranks(marked, keys, score, {"hits": F.col("_hit")})
    hits = F.col("upto_hits").cast("double")
    misses = (F.col("total") - F.col("total_hits")).cast("double")
    return ranked.select(
        *keys, score, "n", F.col("hits"), F.try_divide(hits, F.col("total_hits").cast("double")).alias("tpr"),
        F.try_divide(F.col("upto") - hits, misses).alias("fpr"))


def forecast_eval(predictions: DataFrame, keys: list[str], predicted: str, actual: str,
                  unit: str = "days") -> DataFrame:
    """Mean error, mean squared error, mean absolute error and root of the mean
    squared error per method; inputs in ms."""
    error = to_unit(F.col(predicted) - F.col(actual), unit)
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("me"), F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def average_results(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """NaN-free averages of comparison results."""
    return df.groupBy(*keys).agg(*[nanmean(F.col(v)).alias(v) for v in values])


def subset_support(log: DataFrame, smallest: int, largest: int) -> DataFrame:
    """Cases that contain each activity subset of size ``smallest..largest``.

    Cases are reduced to distinct activity sets with counts first; the subsets
    of a set are built once per distinct set.
    """
    sets = (log.groupBy("case_id").agg(F.sort_array(F.collect_set("activity")).alias("set"))
            .groupBy("set").agg(F.count(F.lit(1)).alias("n")))
    grown = sets.select("set", "n", F.array().cast("array<string>").alias("subset"))
    out = None
    for size in range(1, largest + 1):
        grown = grown.select("set", "n", "subset", F.explode("set").alias("_next")).where(
            (F.size("subset") == 0) | (F.col("_next") > F.try_element_at("subset", F.lit(-1)))
        ).select("set", "n", F.concat("subset", F.array("_next")).alias("subset"))
        if size >= smallest:
            out = grown if out is None else out.unionByName(grown)
    if out is None:
        raise ValueError("largest must be at least 1")
    return out.groupBy("subset").agg(F.sum("n").alias("n_cases"))


def all_subsets(items: list[str], smallest: int, largest: int) -> list[tuple[str, ...]]:
    """Subsets of a parameter list, for enumerating study settings."""
    return [c for k in range(smallest, largest + 1) for c in combinations(sorted(items), k)]


def hourly(df: DataFrame, ts: str, numeric: list[str], categorical: dict[str, list[str]]) -> DataFrame:
    """Per hour: exact median of numeric columns, count per level of categorical ones.

    Medians come from distinct values and their ranks, so an hour with a third
    of all rows is still split.
    """
    hour = F.date_trunc("hour", F.col(ts)).alias("hour")
    counts = df.groupBy(hour).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c) == level).alias(f"{c}_{level}") for c, levels in categorical.items() for level in levels])
    for c in numeric:
        ranks = value_ranks(df.select(hour, F.col(c).cast("double").alias(c)), ["hour"], c)
        middle = clamped_percentile(ranks, ["hour"], c, {f"median_{c}": 50.0}).drop("total")
        counts = counts.join(middle, "hour", "left")
    return counts


def quality_distance(log_fitness: Column, precision: Column, log_distance: Column, model_distance: Column) -> Column:
    """(log distance + model distance + 1 - (fitness + precision) / 2) / 3."""
    return (log_distance + model_distance + 1 - (log_fitness + precision) / 2) / 3


def case_starts(log: DataFrame) -> DataFrame:
    return sort_cases(log).select("case_id", "start", "case_index")
