"""Exact deduplication with keyed state on disk.

The documents are taken in as records of digest, identifier, length and content locator (where the text lies), without
their texts. A stream reads the records and keeps, per digest, one row of state in RocksDB: how often the digest came and
the record that stays so far. The state never expires, so a copy is found however late it comes, and what arrives later
is counted on from the same checkpoint. Counting combines before the shuffle, so a text that makes up a third of all rows
reaches the state as one row per task.

A digest that came more than once is a hit. The full texts of all hits are read again and grouped by digest and text, so
two different texts of one digest are never taken for copies. Hits are found in the documents through a broadcast of
their digests while those are few (``FEW_HITS``), else through a join.

Texts are equal when they are identical after deleting blanks (``[\\x20\\x09-\\x0D]``). Of equal texts the longest original
(in code points) stays, then the smallest identifier.

Defined cases: a missing text counts as the empty text, and all empty texts are copies of each other; of rows that repeat
with the same identifier the one with the largest locator stays (without files and a locator, all of them do);
identifiers are integers, a missing one loses against any other; an empty table gives no rows. Columns other than
identifier and text are not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import whole_text
from caseloom.plans.lineage import new_folder, stored

FEW_HITS = 200_000         # digests of 32 bytes; 6.4 MB
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no room is taken ahead of the rows
}
BLANKS = "\t\n\x0b\x0c\r "  # fixed values: the characters 09 to 0D and 20


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, text: str, key: str, locator: str | None) -> DataFrame:
    """``id, chars, locator, body`` of every row; the locator is file and row where the source is files, unless a column
    is named."""
    whole = whole_text(text)
    columns = [F.col(key).cast("bigint").alias("id"), F.length(whole).alias("chars"), without_blanks(whole).alias("body")]
    if locator:
        return docs.select(*columns, F.col(locator).cast("string").alias("locator"))
    try:
        return docs.select(*columns, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("locator"))
    except AnalysisException:  # rows that do not come from files
        return docs.select(*columns, F.col(key).cast("string").alias("locator"))


def records(rows: DataFrame, digest=digest_of) -> DataFrame:
    """``id, digest, chars, locator``: what the state sees of a document."""
    return rows.select("id", digest(F.col("body")).alias("digest"), "chars", "locator")


def take_in(spark: SparkSession, folder: str, state: str, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over all records in ``folder`` that ``state`` has not seen; the whole state then:
    ``digest, n, id, locator`` (of the record that stays)."""
    source = spark.readStream.schema("id bigint, digest binary, chars int, locator string")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    # ~id falls as id rises and cannot overflow
    stay = F.struct("chars", F.bitwise_not("id").alias("low"), "locator")
    seen = source.parquet(folder).groupBy("digest").agg(F.count("*").alias("n"), F.max(stay).alias("stay"))
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    try:
        for name, value in STATE_CONF.items():
            spark.conf.set(name, value)
        seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(
            availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    found = spark.read.format("statestore").load(state)
    return found.select("key.digest", F.col("value.count").alias("n"), F.bitwise_not("value.max.low").alias("id"),
                        F.col("value.max.locator").alias("locator"))


def collisions(rows: DataFrame, state: DataFrame, digest=digest_of) -> DataFrame:
    """Classes of equal text inside digests that several texts share: ``digest, body, n, stay``. The full texts of all
    rows whose digest was a hit are compared."""
    hits = stored(state.where("n > 1").select("digest"))
    few = hits.count() <= FEW_HITS
    again = rows.withColumn("digest", digest(F.col("body"))).join(F.broadcast(hits) if few else hits, "digest",
                                                                  "left_semi")
    classes = again.groupBy("digest", "body").agg(
        F.count("*").alias("n"), F.max(F.struct("chars", F.bitwise_not("id").alias("low"), "locator")).alias("stay"))
    shared = stored(classes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))
    if shared.isEmpty():
        return classes.where("false")
    return stored(classes.join(shared, "digest"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", digest=digest_of,
                files_per_batch: int | None = None, locator: str | None = None) -> DataFrame:
    """One row per document: the key, ``keep_id, group_size, kept, digest`` (of the text without blanks) and
    ``locator``."""
    spark, rows = docs.sparkSession, located(docs, text, key, locator)
    folder = new_folder(spark, "records")
    records(rows, digest).write.parquet(folder)
    state = stored(take_in(spark, folder, new_folder(spark, "state"), files_per_batch))
    split = collisions(rows, state, digest)
    seen = spark.read.schema("id bigint, digest binary, chars int, locator string").parquet(folder)
    of_digest = state.select("digest", "n", F.col("id").alias("keep"), F.col("locator").alias("keep_at"))
    found = seen.join(of_digest, "digest").select("id", "digest", "locator", "n", "keep", "keep_at")
    if not split.isEmpty():
        some = split.select("digest").distinct()
        apart = rows.withColumn("digest", digest(F.col("body"))).join(some, "digest", "left_semi").join(
            split.select("digest", "body", "n", F.bitwise_not("stay.low").alias("keep"),
                         F.col("stay.locator").alias("keep_at")), ["digest", "body"])
        found = found.join(some, "digest", "left_anti").unionByName(apart.select(found.columns))
    kept = F.col("id").eqNullSafe(F.col("keep")) & F.col("locator").eqNullSafe(F.col("keep_at"))
    return found.select(F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
                        kept.alias("kept"), "digest", "locator")
