"""The corpus pipeline: documents in, packed sequences out.

``STAGES`` lists the stages in their order; each takes (spark, docs, sf_dir) and returns the documents it keeps, the last
one the pieces of the packed sequences. ``run`` writes each stage's result to the shared folder and reads it again as the
next one's documents, so a lost executor costs no more than the stage that is running.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import exact, language, packing, simhash, suffix
from caseloom.llm.common import default_vocabulary, documents, join_small, small_batches, with_row_ids
from caseloom.plans.lineage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: texts without a letter go, and those that no language explains better than
    all others together (a score below one half)."""
    small_batches(spark)
    found = language.identify(docs.select(COLUMNS), F.lit(True))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= 0.5)).select(COLUMNS)


def keep(docs: DataFrame, stay) -> DataFrame:
    """The rows of ``docs`` that ``stay(rows)`` names by ``row_id``, through a small join from the side that is left out
    while that is few."""
    rows = with_row_ids(docs.select(COLUMNS))
    gone = stored(stay(rows))
    return join_small(rows, gone, "row_id", gone.count(), "left_anti").select(COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    small_batches(spark)

    def gone(rows: DataFrame) -> DataFrame:
        found = exact.deduplicate(rows, locator="row_id")
        return found.where(~F.col("kept")).select(F.col("locator").cast("bigint").alias("row_id"))

    return keep(docs, gone)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, the first one in the table."""
    small_batches(spark)

    def gone(rows: DataFrame) -> DataFrame:
        found = simhash.near_duplicates(rows.select(F.col("row_id").alias("doc_id"), "text"))
        return found.where("doc_id <> component_id").select(F.col("doc_id").alias("row_id"))

    return keep(docs, gone)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur more than once. Bytes of a character that a cut has broken
    go with it; documents of which nothing is left go."""
    small_batches(spark)

    @F.pandas_udf("string")
    def whole_characters(kept: pd.Series) -> pd.Series:
        return pd.Series([k.decode("utf-8", "ignore") for k in kept], dtype=object)

    found = suffix.remove_repeats(docs.select(COLUMNS))
    rest = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(whole_characters("kept"))
    return found.withColumn("text", rest).withColumn(
        "n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).where(
        (F.col("n_removed") == 0) | (F.length("text") > 0)).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens from all documents that are left, as their pieces."""
    small_batches(spark)
    return packing.with_crc(packing.pack(docs, default_vocabulary())).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language ID", known_language), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies),
          ("suffix-array dedup", without_repeats), ("packing", pack)]

# language identification and tokens cannot be expressed in SQL; tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
