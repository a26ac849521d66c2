"""Running streams over all data that is there, into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.plans.lineage import new_folder


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def is_folder(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the table is a folder of files; the listing is Spark's, so any store will do."""
    return any(not f.endswith(f"/{name}") for f in spark.read.schema(EVENTS).parquet(f"{folder}/{name}").inputFiles())


def events_stream(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """``events`` as a stream with ``event_id, ts, case_id, activity, value``. The table is a folder of files, a single
    file, or all files of a pattern."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger)
    if "*" not in files and is_folder(spark, folder, files):
        raw = source.parquet(f"{folder}/{files}")
    else:
        raw = source.option("pathGlobFilter", files).parquet(folder)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                      F.concat_ws("|", "user_id", F.to_date("ts").cast("string")).alias("case_id"),
                      F.col("event_type").alias("activity"), "value", "user_id")


def append_to_folder(stream: DataFrame) -> str:
    """Process everything available in append mode into parquet files; their folder."""
    place = new_folder(stream.sparkSession, "stream")
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state")
             .option("path", f"{place}/rows").trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{place}/rows"


def append_to_table(stream: DataFrame) -> DataFrame:
    """``append_to_folder``, read back."""
    return stream.sparkSession.read.schema(stream.schema).parquet(append_to_folder(stream))


def updates_to_table(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process everything available in update mode; the latest row per key."""
    spark, place = stream.sparkSession, new_folder(stream.sparkSession, "stream")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/rows/{number:08d}")

    query = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state")
             .foreachBatch(save).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema(stream.withColumn("_batch", F.lit(0)).schema).option(
        "recursiveFileLookup", True).parquet(f"{place}/rows")
    rest = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_latest"))
    return latest.select(*keys, "_latest.*")
