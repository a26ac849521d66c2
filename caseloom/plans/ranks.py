"""Exact order statistics per key without collecting or sorting a key in one task.

Rows are first collapsed to distinct ``(key, value, n)``, with the counts
combined before the shuffle, so a value shared by a third of all rows is one
row.  The distinct values are then ranked by a sweep, which cuts keys with very
many distinct values into ranges of near equal size, however narrow they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.plans.slices import sweep


def value_ranks(df: DataFrame, keys: list[str], value: str, extra: dict[str, Column] | None = None
                ) -> DataFrame:
    """Distinct values per key with weighted ranks.

    Columns: ``keys, value, n`` (rows with this value), ``upto`` (rows with a
    value <= this one), ``total`` (rows of the key) and, per ``extra`` input,
    its running sum ``upto_<name>`` and whole sum ``total_<name>``.  The 0-based sorted samples ``upto - n .. upto - 1`` equal
    ``value``.
    """
    extra = extra or {}
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    distinct = (df.where(usable).groupBy(*keys, value)
                .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in extra.items()]))
    sums = {"upto": ("sum", F.col("n"))}
    sums.update({f"upto_{k}": ("sum", F.col(k)) for k in extra})
    overall = {"total": ("sum", F.col("n"))}
    overall.update({f"total_{k}": ("sum", F.col(k)) for k in extra})
    return sweep(distinct, keys, [value], sums, overall=overall)


def pick(value: str, index: Column, upto: str = "upto", n: str = "n") -> Column:
    """Aggregate that returns the sorted sample at a 0-based ``index``."""
    hit = (index >= F.col(upto) - F.col(n)) & (index < F.col(upto))
    return F.max(F.when(hit, F.col(value)))


def order_statistics(ranks: DataFrame, keys: list[str], value: str,
                     picks: dict[str, Column]) -> DataFrame:
    """One row per key with the samples at the given 0-based indexes.

    The index columns may use ``total``.
    """
    return ranks.groupBy(*keys).agg(
        F.max("total").alias("total"),
        *[pick(value, index).alias(name) for name, index in picks.items()])


def clamped_percentile(ranks: DataFrame, keys: list[str], value: str,
                       levels: dict[str, float]) -> DataFrame:
    """Percentiles at position p*(n+1)/100 with clamping to the extremes,
    interpolated between neighbours; levels are in (0, 100]."""
    picks, parts = {}, {}
    for name, p in levels.items():
        place = F.lit(p) * (F.col("total") + 1) / 100
        low = F.least(F.greatest(F.floor(place) - 1, F.lit(0)), F.col("total") - 1)
        high = F.least(F.greatest(F.floor(place), F.lit(0)), F.col("total") - 1)
        picks[f"_lo_{name}"], picks[f"_hi_{name}"] = low, high
        parts[name] = place
    stats = order_statistics(ranks, keys, value, picks)
    for name, place in parts.items():
        inside = (place >= 1) & (place < F.col("total"))
        weight = F.when(inside, place - F.floor(place)).otherwise(0.0)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        stats = stats.withColumn(name, lo + weight * (hi - lo))
    return stats.drop(*picks)
