"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.plans.lineage import stored

BATCH_CONF, DEFAULT_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
FEW_FILES = 200          # whose numbers are written into the plan; those of more are joined
FEW_ENTRIES = 1_000_000  # of some 24 bytes: what may be broadcast
VOCABULARY = "word_bpe_49k.json"


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python in batches of ``TEXT_ROWS``, unless the session says otherwise: a worker then
    holds some MB of texts at a time."""
    if spark.conf.get(BATCH_CONF, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH_CONF, TEXT_ROWS)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def default_vocabulary() -> str:
    """Path of the public tokenizer file the registered queries use."""
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def whole_text(column: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a number of its own to every row: its file's place among the files and its place in the file. Rows that do
    not come from Parquet files are written to the shared folder first. The driver sees the names of the files only."""
    try:
        place = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return with_row_ids(stored(df), name)
    files = sorted(r[0] for r in place.select("__file").distinct().collect())
    if len(files) <= FEW_FILES:
        numbers = F.create_map(*(F.lit(x) for i, f in enumerate(files) for x in (f, i << 40)))
        base = numbers[F.col("__file")] if files else F.lit(0)
        return place.withColumn(name, base + F.col("__row")).drop("__file", "__row")
    numbers = df.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], "__file string, __base bigint")
    return place.join(F.broadcast(numbers), "__file").withColumn(name, F.col("__base") + F.col("__row")).drop(
        "__file", "__row", "__base")


def join_small(big: DataFrame, table: DataFrame, on: str, entries: int, how: str = "inner") -> DataFrame:
    """Join documents with what belongs to them: by broadcast while the table has few entries, else by a shuffle."""
    return big.join(F.broadcast(table) if entries <= FEW_ENTRIES else table, on, how)
