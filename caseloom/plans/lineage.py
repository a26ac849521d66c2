"""Cutting lineage: checkpoints for iterative jobs, written tables for reuse."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a folder of its own only in local mode."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
            named = tempfile.mkdtemp(prefix="caseloom-checkpoint-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/caseloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows of an iteration to the checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table that several branches read to the shared folder, once, and
    read it back as parquet: columns are still pruned and its size is known."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reusable(df: DataFrame) -> DataFrame:
    """The rows themselves if they come straight from files (scan, columns, filters, unions), where each reader takes only what
    it needs; else a stored copy, so that no shuffle, join or window is computed once per reader."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = re.findall(r"^[\s:|+-]*(\w+)", plan, re.MULTILINE)
    return df if set(nodes) <= {"Project", "Filter", "Relation", "Union"} else stored(df)
