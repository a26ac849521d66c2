"""Exports: training data, duration matrix, likelihoods, predictions, entropy curve, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.windows import step_durations

# Column names and separators of the exchanged files.
TRAINING_COLUMNS = ["duration", "systemLoad", "timestamp"]
PREDICTION_COLUMNS = ["numCase", "method", "prediction", "confidence_interval", "real_duration"]
ENTROPY_COLUMNS = ["sampleCount", "sampleEntropy"]


def write_training(training: DataFrame, path: str) -> None:
    """``activity, duration, system_load, ts`` as ``;`` files, one folder per activity."""
    rows = training.select("activity", F.col("duration").alias("duration"),
                           F.col("system_load").alias("systemLoad"), F.unix_millis("ts").alias("timestamp"))
    rows.write.mode("overwrite").partitionBy("activity").option("header", True).option("sep", ";").csv(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    schema = "duration double, systemLoad bigint, timestamp bigint, activity string"
    rows = spark.read.schema(schema).option("header", True).option("sep", ";").csv(path)
    return rows.select("activity", "duration", F.col("systemLoad").alias("system_load"),
                       F.timestamp_millis("timestamp").alias("ts"))


def duration_matrix(log: DataFrame, activities: list[str]) -> DataFrame:
    """One row per case, one column per listed activity: the duration (ms) of
    its last occurrence, null where it does not occur."""
    steps = step_durations(log)
    return steps.groupBy("case_id").agg(*[
        F.max_by("duration", F.when(F.col("activity") == a, F.col("pos"))).alias(a) for a in activities])


def write_duration_matrix(matrix: DataFrame, path: str) -> None:
    renamed = matrix.withColumnRenamed("case_id", "CaseId")
    (renamed.write.mode("overwrite").option("header", True).option("sep", ";")
     .option("nullValue", "NaN").csv(path))


def write_likelihoods(scores: DataFrame, path: str, choices: DataFrame | None = None) -> None:
    """One case per row: the scores of ``case_likelihood``.  The probabilities of
    the choices (``step_choices``) go to a folder next to them, one per row."""
    scores.write.mode("overwrite").option("header", True).option("sep", ";").csv(f"{path}/cases")
    if choices is not None:
        choices.write.mode("overwrite").option("header", True).option("sep", ";").csv(f"{path}/choices")


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select(*PREDICTION_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_entropy_curve(curve: DataFrame, path: str) -> None:
    rows = curve.select(F.col("sample_count").alias("sampleCount"), F.col("sample_entropy").alias("sampleEntropy"))
    rows.write.mode("overwrite").option("header", True).csv(path)


def intervals_json(intervals: DataFrame, label: str, rate: float) -> DataFrame:
    """Anomaly intervals per activity with model label and rate as one JSON text.

    The document lists model rows (one entry per activity), not events.
    """
    per = intervals.groupBy("activity").agg(
        F.sort_array(F.collect_list(F.struct("lower", "upper"))).alias("intervals"))
    whole = per.agg(F.sort_array(F.collect_list(F.struct("activity", "intervals"))).alias("activities"))
    return whole.select(F.to_json(F.struct(F.lit(label).alias("label"), F.lit(rate).alias("rate"),
                                           "activities")).alias("json"))
