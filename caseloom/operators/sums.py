"""Distributions of sums of two durations, on cells that follow the quantiles.

A cell is a span of values with its share of the mass, as a whole number. The cells of a parametric fit end at its quantiles
for levels whose log-odds are equally far apart, so they are narrow where the mass is and reach into the tails however heavy
they are, and their masses are exact. Histograms and kernels enter through bins and slots, gathered at the same levels.
The products of the cells of two fits, gathered in turn, are the cells of the sum; each product lies at another place
of its two cells, so that together they fill them evenly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.maths import normal_quantile
from caseloom.operators.distributions import EPSILON, GRID_KINDS, KERNEL, SPREAD, quantile
from caseloom.plans.slices import sweep

CELLS = 400          # of one fit
SUM_CELLS = 1000     # of a sum
ODDS = 13.8          # log-odds of the outermost levels: all but 1e-6 of the mass at either end
WHOLE = 1 << 20      # what the masses of the cells of a fit add up to, about
NODES = 16           # parts into which the bell of a kernel slot is cut
TURN = (0.6180339887498949, 0.7548776662466927)  # steps that fill a unit of length evenly


def levels(n: int = CELLS) -> list[tuple[int, float, float, int]]:
    """``(k, u, z, mass)``: the ends of the cells, their standard normal quantiles, and the mass up to the next end."""
    ends = [1 / (1 + math.exp(ODDS - 2 * ODDS * k / n)) for k in range(n + 1)]
    return [(k, u, normal_quantile(u), round((ends[k + 1] - u) * WHOLE) if k < n else 0) for k, u in enumerate(ends)]


def level_of(share: Column, n: int) -> Column:
    """The cell of a share of the mass."""
    inside = F.least(F.greatest(share, F.lit(1e-12)), F.lit(1 - 1e-12))
    place = F.floor((F.ln(inside / (F.lit(1.0) - inside)) + ODDS) / (2 * ODDS) * n)
    return F.least(F.greatest(place, F.lit(0)), F.lit(n - 1)).cast("int")


def gathered(points: DataFrame, keys: list[str], n: int = CELLS) -> DataFrame:
    """``keys, k, low, high, centre, mass``: points (``value, tie, mass``) in at most ``n`` cells by level."""
    order = sweep(points, keys, ["value", "tie"], {"_upto": ("sum", F.col("mass"))}, overall={"_all": ("sum", F.col("mass"))})
    share = (F.col("_upto") - F.col("mass") / 2) / F.col("_all")
    return order.where(F.col("mass") > 0).groupBy(*keys, level_of(share, n).alias("k")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("mass").alias("mass"))


def family_cells(fits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, k, low, high, mass`` of parametric fits (``keys, dist_type, params``)."""
    point = F.col("dist_type").isin("DETERMINISTIC", "IMMEDIATE")
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(u).alias("u"), F.lit(z).alias("z"),
                                        F.lit(m).cast("bigint").alias("mass")) for k, u, z, m in levels())))
    rows = fits.select(*keys, "dist_type", "params", ends.alias("e")).select(
        *keys, F.col("e.k").alias("k"), F.when(point & (F.col("e.k") == 0), WHOLE).when(~point, F.col("e.mass")).otherwise(
            F.lit(0)).cast("bigint").alias("mass"), quantile(F.col("dist_type"), F.col("params"), F.col("e.u"), F.col("e.z")).cast("float").cast("double").alias("at"))
    # (single precision: the last bits of a fit must not change the order of the products)
    # a window over the few ends of one fit
    cells = rows.withColumn("_next", F.lead("at").over(Window.partitionBy(*keys).orderBy("k")))
    return cells.where(F.col("mass") > 0).select(*keys, "k", F.col("at").alias("low"), F.col("_next").alias("high"), "mass")


def measured_cells(points: DataFrame, keys: list[str], width: float = 0.0) -> DataFrame:
    """``keys, k, low, high, mass`` of measured values (``keys, value, n``: a count or weight), each ``width`` wide."""
    weighed = points.select(*keys, "value", F.lit(0).alias("tie"), F.col("n").cast("bigint").alias("mass"))
    cells = gathered(weighed, keys)
    total = F.sum("mass").over(Window.partitionBy(*keys))
    return cells.select(*keys, "k", (F.col("low") - width / 2).alias("low"), (F.col("high") + width / 2).alias("high"), F.greatest(F.round(F.col("mass") / total * WHOLE), F.lit(1)).cast(
        "bigint").alias("mass"))


def kernel_cells(bands: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, k, low, high, mass`` of kernel fits: gathered slots, each with the bell of the bandwidth."""
    slotted = measured_cells(slots.select(*keys, F.col("centre").alias("value"), F.col("weight").alias("n")), keys)
    nodes = F.explode(F.array(*(F.lit(normal_quantile((i + 0.5) / NODES)) for i in range(NODES))))
    spread = slotted.join(bands.select(*keys, "h"), keys).select(
        *keys, ((F.col("low") + F.col("high")) / 2).alias("centre"), "h", "mass", nodes.alias("z"))
    return measured_cells(spread.select(*keys, (F.col("centre") + F.col("h") * F.col("z")).alias("value"),
                                        F.col("mass").alias("n")), keys)


def fit_cells(dists: DataFrame, bins: DataFrame | None = None, kernels: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``activity, k, low, high, mass`` of the fits of all families (``activity, dist_type, params``). Histogram fits need
    their ``bins`` (from ``histogram``), kernel fits their ``kernels`` (from ``kernel_model``)."""
    kind = F.col("dist_type")
    cells = family_cells(dists.where(kind.isin(GRID_KINDS)), ["activity"])

    def of(name: str) -> DataFrame:
        return dists.where(kind == name).select("activity")

    if bins is not None:
        cells = cells.union(measured_cells(bins.join(of("HISTOGRAM"), "activity", "left_semi").select(
            "activity", "value", "n"), ["activity"], _width(bins)))
    if kernels is not None:
        bands, slots = (t.join(of(KERNEL), "activity", "left_semi") for t in kernels)
        cells = cells.union(kernel_cells(bands, slots, ["activity"]))
    return cells


def _width(bins: DataFrame) -> float:
    """The bin width of a histogram table; 0 if it is empty."""
    row = bins.where("density > 0").select(F.col("probability") / F.col("density")).first()
    return float(row[0]) if row else 0.0


def sum_cells(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, k, low, high, mass, p``: the cells of the sum of two independent durations given by their cells, ``high``
    being where the next one begins, with the share of the mass whose density is no higher."""
    left = first.select(*keys, F.col("k").alias("i"), F.struct("low", "high").alias("a"), F.col("mass").alias("ma"),
                        F.pmod("k", F.lit(SPREAD)).alias("_part"))
    right = second.select(*keys, F.col("k").alias("j"), F.struct("low", "high").alias("b"), F.col("mass").alias("mb"),
                          F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))

    def inside(cell: str, other: str, turn: float) -> Column:
        return F.col(f"{cell}.low") + (F.col(f"{cell}.high") - F.col(f"{cell}.low")) * ((F.col(other) * turn) % 1)

    products = left.join(right, [*keys, "_part"]).select(
        *keys, (inside("a", "j", TURN[0]) + inside("b", "i", TURN[1])).alias("value"), F.struct("i", "j").alias("tie"), (F.col("ma") * F.col("mb")).alias("mass"))
    cells = gathered(products, keys, SUM_CELLS)
    # windows over the cells of one sum
    by_key = Window.partitionBy(*keys)
    cells = cells.withColumn("high", F.coalesce(F.lead("low").over(by_key.orderBy("k")), F.col("high")))
    width = F.col("high") - F.col("low")
    thick = F.when(width > 0, F.col("mass") / width).otherwise(float("inf"))
    lighter = by_key.orderBy("_density").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("_density", thick).select(
        *keys, "k", "low", "high", "mass", (F.sum("mass").over(lighter) / F.sum("mass").over(by_key)).alias("p"))


def at_totals(rows: DataFrame, cells: DataFrame, keys: list[str], total: str, order: list[str]) -> DataFrame:
    """Rows with ``p_grid``: the share told by the cell their total lies in, 0 outside the grid, null without one.
    ``order`` makes the rows unique."""
    last = cells.groupBy(*keys).agg(F.max("high").alias("high"))
    marks = cells.select(*keys, F.when(F.col("k") == F.min("k").over(Window.partitionBy(*keys)), F.col("low") - EPSILON).otherwise(
        F.col("low")).alias("_v"), F.lit(1).alias("_kind"), F.col("p").alias("_p"))
    ends = last.select(*keys, (F.col("high") + EPSILON).alias("_v"), F.lit(3).alias("_kind"), F.lit(0.0).alias("_p"))
    starts = last.select(*keys, F.lit(float("-inf")).alias("_v"), F.lit(1).alias("_kind"), F.lit(0.0).alias("_p"))
    given = [c for c in rows.columns if c not in keys]
    asks = rows.select(*keys, F.col(total).cast("double").alias("_v"), F.lit(2).alias("_kind"), F.lit(None).cast("double").alias("_p"),
                       F.struct(*given).alias("_row"), F.struct(*order).alias("_tie"))
    told = marks.union(ends).union(starts).withColumns({
        "_row": F.lit(None).cast(asks.schema["_row"].dataType), "_tie": F.lit(None).cast(asks.schema["_tie"].dataType)})
    swept = sweep(told.unionByName(asks), keys, ["_v", "_kind", "_tie"], {"_at": ("last", F.col("_p"))})
    return swept.where(F.col("_kind") == 2).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in given],
                                                   F.col("_at").alias("p_grid"))
