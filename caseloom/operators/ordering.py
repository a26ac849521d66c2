"""Case tables, ordering of outcomes, set operations and weighted picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.plans.fingerprint import uniform
from caseloom.plans.slices import running, with_case_values

def case_table(marked: DataFrame, step: str) -> DataFrame:
    """One row per step in case order with the figures of its case: ``case_id,
    pos, step, exceptions, log_likelihood``.  Long form, so cases may have any
    length."""
    figures = with_case_values(marked, exceptions=F.count_if("is_outlier"), log_likelihood=F.sum("log_density"))
    return figures.select("case_id", "pos", F.col(step).alias("step"), "exceptions", "log_likelihood")


def by_size_then_elements(sets: DataFrame, col: str) -> DataFrame:
    """Outcomes ordered by length, then element by element."""
    return sets.orderBy(F.size(col), F.col(col))


def compare_sets(left: Column, right: Column) -> Column:
    """-1, 0 or 1: element-by-element comparison of two sorted arrays; the
    shorter of two arrays with the same beginning comes first."""
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def union_logs(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def common_classes(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("activity").intersect(second.select("activity"))


def missing_classes(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("activity").distinct().join(second.select("activity").distinct(), "activity", "left_anti")


def weighted_pick(table: DataFrame, keys: list[str], option: str, weight: str, seed: int) -> DataFrame:
    """One option per key: the first whose cumulative weight reaches U * total."""
    marked = table.withColumn("_b", F.substring(F.col(option).cast("string"), 1, 2))
    summed = running(marked, keys, ["_b"], [option], {"_upto": ("sum", F.col(weight))}).drop("_b")
    totals = table.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    goal = uniform(seed, "pick", *keys) * F.col("_total")
    return (summed.join(totals, keys).where(F.col("_upto") >= goal).groupBy(*keys)
            .agg(F.min_by(option, F.struct("_upto", option)).alias(option)))
