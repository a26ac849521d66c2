"""Case likelihood, outliers, measurement-error tests and anomalous intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.maths import epoch_ms, normal_cdf, normal_pdf, normal_quantile
from caseloom.functions.special import bisect, let
from caseloom.operators import sums
from caseloom.operators.distributions import (EPSILON, GRID_KINDS, INFINITY, KERNEL, convolve, density, discretize,
                                              kde, log_density, packed_kernels)
from caseloom.plans.fingerprint import gaussian, uniform
from caseloom.plans.lineage import stored
from caseloom.plans.models import join_model, split_join
from caseloom.plans.ranks import order_statistics, value_ranks
from caseloom.plans.slices import neighbours, running, with_case_values

OUTLIER_RATE = 0.01  # fixed value


# ---------------------------------------------------------------- likelihood

def case_likelihood(scored: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """Per case: sum of log-densities of timed steps, case duration, number of
    uncertain choices and the log of their joint probability.

    ``scored`` comes from ``with_density``; ``choices`` from ``step_choices``.
    """
    timed = F.col("dist_type") != "IMMEDIATE"
    ms = epoch_ms("ts")
    scores = scored.groupBy("case_id").agg(
        F.coalesce(F.sum(F.when(timed, F.col("log_density"))), F.lit(0.0)).alias("log_likelihood"),
        (F.max_by(ms, "pos") - F.min_by(ms, "pos")).alias("case_duration"), F.max("pos").alias("n_events"))
    if choices is None:
        return scores
    made = choices.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_choices"),
                                          F.sum(F.ln("probability")).alias("choice_log_probability"))
    return scores.join(made, "case_id", "left").withColumns({
        "n_choices": F.coalesce("n_choices", F.lit(0)),
        "choice_log_probability": F.coalesce("choice_log_probability", F.lit(0.0))})


def step_choices(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Choice probabilities below 1 of the immediate steps (``case_id, pos,
    activity, probability``); scored steps carry ``state``."""
    fired = scored.where(F.col("dist_type") == "IMMEDIATE").select("case_id", "pos", "state", "activity")
    return join_model(fired, weights.select("state", "activity", "probability"),
                      ["state", "activity"]).where(F.col("probability") < 1).drop("state")


def ll_cutoffs(scored: DataFrame, rate: float = OUTLIER_RATE) -> DataFrame:
    """``activity, cutoff``: the log-density at the outlier rate.

    With i = rate * N the value is (1 - r) * v[ceil i] + r * v[floor i], where r
    is the fraction of i; the weights are those of the original rule.
    """
    if not 0 <= rate < 1:
        raise ValueError("the outlier rate must be in [0, 1)")
    timed = scored.where(F.col("dist_type") != "IMMEDIATE")
    place = F.col("total") * F.lit(rate)
    top = F.col("total") - 1
    found = order_statistics(value_ranks(timed, ["activity"], "log_density"), ["activity"], "log_density", {
        "_up": F.least(F.ceil(place), top), "_down": F.floor(place)})
    rest = place - F.floor(place)
    return found.select("activity", F.when(rest == 0, F.col("_up")).otherwise(
        (F.lit(1.0) - rest) * F.col("_up") + rest * F.col("_down")).alias("cutoff"))


def mark_outliers(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add ``is_outlier``: log-density below the cut-off of the activity."""
    joined = join_model(scored, cutoffs, ["activity"], "left")
    return joined.withColumn("is_outlier", F.coalesce(F.col("log_density") < F.col("cutoff"), F.lit(False)))


def outliers(marked: DataFrame) -> DataFrame:
    return marked.where("is_outlier")


def regular_steps(marked: DataFrame) -> DataFrame:
    return marked.where(~F.col("is_outlier"))


def outlier_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("case_id").agg(F.count_if("is_outlier").alias("n_outliers"))


def marked_cases(marked: DataFrame, *more: Column) -> DataFrame:
    """``case_likelihood`` and ``outlier_counts`` of marked steps in one pass,
    with any other aggregates."""
    timed = F.col("dist_type") != "IMMEDIATE"
    ms = epoch_ms("ts")
    return marked.groupBy("case_id").agg(
        F.coalesce(F.sum(F.when(timed, F.col("log_density"))), F.lit(0.0)).alias("log_likelihood"),
        (F.max_by(ms, "pos") - F.min_by(ms, "pos")).alias("case_duration"), F.max("pos").alias("n_events"),
        F.count_if("is_outlier").alias("n_outliers"), *more)


def rank_cases(cases: DataFrame, top: int | None = None) -> DataFrame:
    """Cases by outlier count (descending), then log-likelihood (ascending)."""
    ranked = cases.orderBy(F.desc("n_outliers"), F.asc("log_likelihood"), "case_id")
    return ranked if top is None else ranked.limit(top)


# ---------------------------------------------------------------- p-values

def _closed_p(dist_type: Column, params: Column, x: Column) -> Column:
    mean, sd = (F.try_element_at(params, F.lit(i)) for i in (1, 2))
    below = normal_cdf((x - mean) / sd)
    return (F.when(dist_type == "IMMEDIATE", F.when(x == 0, 1.0).otherwise(0.0))
            .when(dist_type == "NORMAL", F.when(x > mean, F.lit(1.0) - below).otherwise(below) * 2)
            .when(dist_type == "EXPONENTIAL", F.when(x > 0, F.exp(-x / mean)).otherwise(1.0)))


def p_values(scored: DataFrame) -> DataFrame:
    """Add ``p_value``: closed forms for immediate, normal and exponential
    durations; else the share of the observed log-densities of the activity
    that are not higher; 0 where the density is 0."""
    closed = F.col("dist_type").isin("IMMEDIATE", "NORMAL", "EXPONENTIAL")
    done = scored.where(closed).withColumn("p_value", _closed_p(
        F.col("dist_type"), F.col("params"), F.col("duration").cast("double")))
    other = scored.where(~closed)
    ranks = value_ranks(other, ["activity"], "log_density")
    shares = ranks.select("activity", "log_density", "n", (F.col("upto") / F.col("total")).alias("_share"))
    seen = split_join(other, shares, ["activity", "log_density"], "n").drop("n")
    share = F.when(F.col("log_density") == -INFINITY, 0.0).otherwise(F.col("_share"))
    return done.unionByName(seen.withColumn("p_value", share).drop("_share"))


def grid_p_values(bins: DataFrame, keys: list[str]) -> DataFrame:
    """p-value per grid bin: mass of the bins that are not more probable.  The
    window holds the grid of one model row, whose length the grid bounds."""
    by_mass = Window.partitionBy(*keys).orderBy("probability").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    return bins.withColumn("p", F.sum("probability").over(by_mass)).select(*keys, "bin", "p")


def error_test(scored: DataFrame, dists: DataFrame, binwidth: float | None = None, bins: DataFrame | None = None,
               kernels: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Is a step likelier a measurement error than a true outlier?

    With a following step y, compare p(y) with p(x + y) under the distribution
    of the sum: an error when the sum is likelier.  Without one, p(x) < 0.05.
    Adds ``p_value, p_child, p_sum, is_error``.  Sums of two normals are normal;
    other sums use the cells of ``sum_cells`` per pair of adjacent activities,
    or a convolved grid if a bin width is given.  Histogram fits need their
    ``bins`` and kernel fits their ``kernels``.
    """
    own = p_values(scored).select("case_id", "pos", "activity", "duration", "p_value", "dist_type", "params")
    linked = neighbours(own, ["case_id"], "pos", {
        "child": ("activity", -1), "child_duration": ("duration", -1), "p_child": ("p_value", -1),
        "_child_type": ("dist_type", -1), "_child_params": ("params", -1)})
    total = (F.col("duration") + F.col("child_duration")).cast("double")
    # only pairs that are not both normal need a grid
    both = neighbours(scored.select("case_id", "pos", "activity", "dist_type"), ["case_id"], "pos",
                      {"child": ("activity", -1), "_child_type": ("dist_type", -1)})
    normal = (F.col("dist_type") == "NORMAL") & (F.col("_child_type") == "NORMAL")
    pairs = stored(both.where(F.col("child").isNotNull() & ~normal).select("activity", "child").distinct())
    if pairs.isEmpty():
        joined = linked.withColumn("_p_grid", F.lit(None).cast("double"))
    elif binwidth is not None:
        joined = _on_even_grid(linked, total, dists, pairs, float(binwidth))
    else:
        cells = stored(sums.fit_cells(dists.select("activity", "dist_type", "params"), bins, kernels))
        without = pairs.select("activity").union(pairs.select("child")).join(cells, "activity", "left_anti").first()
        if without:
            raise ValueError(f"no cells for the fit of {without['activity']!r}: pass its bins or kernels")
        first = pairs.join(cells, "activity")
        second = pairs.join(cells.withColumnRenamed("activity", "child"), "child")
        both_keys = ["activity", "child"]
        grid = stored(sums.sum_cells(first, second, both_keys))
        linked = stored(linked.withColumn("_total", total))
        asked = linked.where(F.col("child").isNotNull() & ~normal)
        rest = linked.where(F.col("child").isNull() | normal)
        found = sums.at_totals(asked, grid, both_keys, "_total", ["case_id", "pos"])
        joined = found.withColumnRenamed("p_grid", "_p_grid").unionByName(
            rest.withColumn("_p_grid", F.lit(None).cast("double")))

    def at(params: str, i: int) -> Column:
        return F.try_element_at(F.col(params), F.lit(i))

    mean = at("params", 1) + at("_child_params", 1)
    sd = F.sqrt(at("params", 2) * at("params", 2) + at("_child_params", 2) * at("_child_params", 2))
    z = F.abs((total - mean) / F.when(sd > 0, sd))
    p_sum = F.when(F.col("child").isNotNull(), F.when(normal, (F.lit(1.0) - normal_cdf(z)) * 2)
                   .otherwise(F.coalesce("_p_grid", F.lit(0.0))))
    flagged = joined.withColumn("p_sum", p_sum)
    is_error = F.when(F.col("child").isNotNull(), F.col("p_sum") > F.col("p_child")).otherwise(F.col("p_value") < 0.05)
    return flagged.select("case_id", "pos", "activity", "duration", "p_value", "p_child", "p_sum",
                          F.coalesce(is_error, F.lit(False)).alias("is_error"))


def _on_even_grid(linked: DataFrame, total: Column, dists: DataFrame, pairs: DataFrame, width: float) -> DataFrame:
    """Steps with ``_p_grid`` from a convolved grid of parametric fits with bins of one width."""
    fits = dists.select("activity", "dist_type", "params")
    sides = pairs.join(fits, "activity").join(fits.select(
        F.col("activity").alias("child"), F.col("dist_type").alias("_ct"), F.col("params").alias("_cp")), "child")
    without = sides.where(~F.col("dist_type").isin(GRID_KINDS) | ~F.col("_ct").isin(GRID_KINDS)).first()
    if without:
        raise ValueError(f"no even grid for the sum of {without['dist_type']} and {without['_ct']}")
    both_keys = ("activity", "child")
    own_bins = discretize(sides, width, both_keys)
    child_bins = discretize(sides.select("activity", "child", F.col("_ct").alias("dist_type"), F.col("_cp").alias("params")),
                            width, both_keys)
    grid = grid_p_values(convolve(own_bins, child_bins, list(both_keys)), list(both_keys))
    grid = stored(grid.select("activity", "child", F.col("bin").alias("_bin"), F.col("p").alias("_p_grid")))
    placed = linked.withColumn("_bin", F.floor(total / F.lit(width) - 0.5).cast("bigint"))
    return join_model(placed, grid, ["activity", "child", "_bin"], "left")


# ---------------------------------------------------------------- error posterior

QUADRATURE = 64


def _normal_nodes(n: int = QUADRATURE) -> list[float]:
    return [normal_quantile((k + 0.5) / n) for k in range(n)]


def _mean_over(nodes: list[float], value) -> Column:
    grid = F.array(*[F.lit(z) for z in nodes])
    return F.aggregate(grid, F.lit(0.0), lambda acc, z: acc + value(z)) / len(nodes)


def _score(f: Column, f_err: Column, rate: float) -> Column:
    whole = f * (1 - rate) + f_err * rate
    return F.when(whole > 0, f_err * rate / F.when(whole > 0, whole)).otherwise(1.0)


def error_scores(scored: DataFrame, error_sd: float, rate: float) -> DataFrame:
    """Posterior that a step (x), its child (y) or both carry a timing error
    N(0, error_sd): ``*_density, *_error_density, *_score`` for xy, x and y;
    1 where there is no child.  The pair is judged along x + y = const.

    Normal steps use closed forms; other families average over quantile nodes.
    """
    linked = neighbours(scored, ["case_id"], "pos", {
        "_y": ("duration", -1), "_ty": ("dist_type", -1), "_py": ("params", -1)})
    x, y = F.col("duration").cast("double"), F.col("_y").cast("double")
    tx, px, ty, py = F.col("dist_type"), F.col("params"), F.col("_ty"), F.col("_py")

    def at(params: Column, i: int) -> Column:
        return F.try_element_at(params, F.lit(i))

    nodes = _normal_nodes()

    def blurred(kind: Column, params: Column, v: Column) -> Column:
        a, b = at(params, 1), at(params, 2)
        wide = F.sqrt(b * b + error_sd * error_sd)
        return F.when(kind == "NORMAL", normal_pdf(v, a, wide)).otherwise(
            _mean_over(nodes, lambda z: density(kind, params, v - z * error_sd)))

    # distribution of x given x + y
    s = x + y
    va, vb = at(px, 2) * at(px, 2), at(py, 2) * at(py, 2)
    centre = at(px, 1) + (s - at(px, 1) - at(py, 1)) * va / (va + vb)
    spread = va * vb / (va + vb)
    both_normal = (tx == "NORMAL") & (ty == "NORMAL")

    def quantile(kind: Column, params: Column, z: Column) -> Column:
        a, b = at(params, 1), at(params, 2)
        p = normal_cdf(z)
        return (F.when(kind == "NORMAL", a + b * z)
                .when(kind == "EXPONENTIAL", -a * F.ln(F.greatest(F.lit(1.0) - p, F.lit(1e-15))))
                .when(kind == "LOGNORMAL", F.exp(a + b * z)).when(kind == "UNIFORM", a + (b - a) * p)
                .otherwise(F.coalesce(a, F.lit(0.0))))

    def along(u: Column) -> Column:
        return F.coalesce(density(tx, px, u) * density(ty, py, s - u), F.lit(0.0))

    # gamma and beta steps have no closed quantiles: their sums are averaged over the places that x can take
    span = F.greatest(F.when(tx == "BETA", F.least(s, F.lit(1.0))).otherwise(s), F.lit(0.0))
    mass = F.when(tx.isin("GAMMA", "BETA"), _mean_over(nodes, lambda z: along(span * normal_cdf(z))) * span).otherwise(
        _mean_over(nodes, lambda z: F.coalesce(density(ty, py, s - quantile(tx, px, z)), F.lit(0.0))))

    xy = F.when(both_normal, normal_pdf(x, centre, F.sqrt(spread))).otherwise(
        F.when(mass > 0, along(x) / F.when(mass > 0, mass)).otherwise(0.0))
    xy_err = F.when(both_normal, normal_pdf(x, centre, F.sqrt(spread + error_sd * error_sd))).otherwise(
        F.when(mass > 0, _mean_over(nodes, lambda z: along(x - z * error_sd)) / F.when(mass > 0, mass)).otherwise(0.0))
    has_child = F.col("_y").isNotNull()
    values = linked.select(
        *scored.columns, has_child.alias("_c"),
        F.when(has_child, xy).alias("xy_density"), F.when(has_child, xy_err).alias("xy_error_density"),
        density(tx, px, x).alias("x_density"), blurred(tx, px, x).alias("x_error_density"),
        F.when(has_child, density(ty, py, y)).alias("y_density"),
        F.when(has_child, blurred(ty, py, y)).alias("y_error_density"))
    out = {}
    for name in ("xy", "x", "y"):
        f, e = F.col(f"{name}_density"), F.col(f"{name}_error_density")
        there = F.lit(True) if name == "x" else F.col("_c")
        out[f"{name}_score"] = F.when(there, _score(f, e, rate)).otherwise(1.0)
    scoredv = values.withColumns(out)
    return scoredv.withColumns({
        c: F.when(F.col("_c"), F.col(c)).otherwise(1.0)
        for c in ("xy_density", "xy_error_density", "y_density", "y_error_density")}).drop("_c")


# ---------------------------------------------------------------- intervals

def _special_intervals(kind: Column, params: Column, c: Column, outside, everything: Column) -> Column:
    """Intervals of gamma and beta fits, whose edges are found by bisection."""
    a, b = (F.try_element_at(params, F.lit(i)) for i in (1, 2))

    def likely(x: Column) -> Column:
        return log_density(kind, params, x) >= c

    # gamma and beta densities rise to their mode and fall behind it; a beta density may fall to its least point instead
    top = F.when(kind == "GAMMA", F.greatest((a - 1) * b, F.lit(0.0))).when(a <= 1, 0.0).when(b <= 1, 1.0).otherwise(
        (a - 1) / F.when(a + b != 2, a + b - 2).otherwise(1.0))
    end = F.when(kind == "BETA", 1.0).otherwise(a * b * 1e3 + top)
    inner = F.least(F.greatest(top, end * 1e-15), end * (1 - 1e-15))
    hump = F.when(likely(inner), outside(
        F.when(top <= 0, 0.0).otherwise(bisect(F.lit(0.0), inner, lambda x: ~likely(x))),
        F.when((kind == "BETA") & (top >= 1), 1.0).otherwise(bisect(inner, end, likely)))).otherwise(everything)
    least = (F.lit(1.0) - a) / F.when(a + b != 2, F.lit(2.0) - a - b).otherwise(1.0)
    hollow = F.when(likely(least), outside(F.lit(0.0), F.lit(1.0))).otherwise(F.concat(
        outside(F.lit(0.0), F.lit(1.0)), F.array(F.struct(
            bisect(F.lit(0.0), least, likely).alias("lower"), bisect(least, F.lit(1.0), lambda x: ~likely(x)).alias("upper")))))
    return F.when((kind == "BETA") & (a < 1) & (b < 1), hollow).otherwise(hump)


def anomaly_intervals(dists: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Duration intervals below the cut-off, per activity of a parametric
    family: ``activity, lower, upper`` (open ends are infinite)."""
    c = F.col("cutoff")
    a, b = (F.try_element_at("params", F.lit(i)) for i in (1, 2))
    lowest, highest = F.lit(-INFINITY), F.lit(INFINITY)
    shift = math.log(math.sqrt(2 * math.pi))

    def outside(low: Column, high: Column) -> Column:
        return F.array(F.struct(lowest.alias("lower"), low.alias("upper")),
                       F.struct(high.alias("lower"), highest.alias("upper")))

    everything = F.array(F.struct(lowest.alias("lower"), highest.alias("upper")))
    reach = (c + F.ln(b) + shift) * -2
    normal = F.when(reach >= 0, outside(a - b * F.sqrt(F.abs(reach)), a + b * F.sqrt(F.abs(reach)))).otherwise(everything)
    edge = -a * (c + F.ln(a))
    exponential = F.when(edge > 0, outside(F.lit(0.0), edge)).otherwise(everything)
    v = b * b
    disc = v * v - a * v * 2 - v * 2 * (F.ln(b) + shift + c)
    lognormal = F.when(disc >= 0, outside(F.exp(a - v - F.sqrt(F.abs(disc))), F.exp(a - v + F.sqrt(F.abs(disc))))
                       ).otherwise(everything)
    value = F.coalesce(a, F.lit(0.0))
    kind = F.col("dist_type")
    found = (F.when(kind.isin("IMMEDIATE", "DETERMINISTIC"), outside(value - EPSILON, value + EPSILON))
             .when(kind == "UNIFORM", outside(a, b)).when(kind == "NORMAL", normal)
             .when(kind == "EXPONENTIAL", exponential).when(kind == "LOGNORMAL", lognormal))
    special = kind.isin("GAMMA", "BETA")
    if not dists.where(special).isEmpty():  # long expressions, only where they are needed
        found = found.when(special, _special_intervals(kind, F.col("params"), c, outside, everything))
    return (dists.join(cutoffs, "activity", "left").select("activity", F.explode(found).alias("i"))
            .select("activity", "i.lower", "i.upper"))


def histogram_intervals(bins: DataFrame, cutoffs: DataFrame, binwidth: float) -> DataFrame:
    """Intervals outside the bins whose log-density reaches the cut-off; the
    whole line for an activity without such a bin."""
    judged = bins.join(cutoffs, "activity")
    kept = judged.where(F.ln("density") >= F.col("cutoff")).select("activity", "bin")
    # runs of adjacent bins: bin minus rank is constant within a run
    kept = kept.withColumn("_block", F.floor(F.col("bin") / 100_000))
    ranked = running(kept, ["activity"], ["_block"], ["bin"], {"_rank": ("sum", F.lit(1))})
    runs = ranked.groupBy("activity", (F.col("bin") - F.col("_rank")).alias("_run")).agg(
        F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    half = binwidth / 2
    inside = runs.select("activity", (F.col("_lo") * binwidth - half).alias("_from"),
                         (F.col("_hi") * binwidth + half).alias("_to"))
    return _outside(judged.select("activity").distinct(), inside)


def _outside(activities: DataFrame, inside: DataFrame) -> DataFrame:
    """What the disjoint spans ``activity, _from, _to`` leave of the whole line,
    for every activity; an activity without spans keeps all of it."""
    w = Window.partitionBy("activity").orderBy("_from")
    gaps = inside.select("activity", F.coalesce(F.lag("_to").over(w), F.lit(-INFINITY)).alias("lower"),
                         F.col("_from").alias("upper"))
    tails = activities.join(inside.groupBy("activity").agg(F.max("_to").alias("_to")), "activity", "left").select(
        "activity", F.coalesce("_to", F.lit(-INFINITY)).alias("lower"), F.lit(INFINITY).alias("upper"))
    return gaps.unionByName(tails)


def kernel_intervals(bands: DataFrame, slots: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Intervals where the kernel log-density is below the cut-off; the whole
    line where it never reaches the cut-off.

    A kernel sum has its modes at slots or between them, never beyond, and turns
    at most once from a slot to the middle between it and the next one.  So the
    density is told at all slots, at the middles and beyond the ends, an edge
    lies between two of these points on different sides of the cut-off, and is
    found there by bisection, however narrow the mode.
    """
    packed = packed_kernels(bands, slots, ["activity"]).join(cutoffs, "activity")
    at = F.transform("slots", lambda s: s["centre"])
    # this far beyond the outermost slots the density is below the cut-off
    depth = F.greatest(-F.col("cutoff") - F.ln(F.col("_h") * math.sqrt(2 * math.pi)), F.lit(0.0)) * 2
    reach = F.col("_h") * (F.sqrt(F.least(depth, F.lit(1e12))) + 1)
    probes = F.concat(F.array(F.array_min("c") - reach), F.flatten(F.transform("c", lambda x, i: F.when(
        i == 0, F.array(x)).otherwise(F.array((x + F.get("c", i - 1)) / 2, x)))), F.array(F.array_max("c") + reach))
    # in two steps, so that no task sees all probes of an activity times its slots at once
    points = packed.withColumn("c", at).select(*packed.columns, F.posexplode(probes).alias("i", "x"))

    def above(x: Column) -> Column:
        return _kernel_log_density(x) >= F.col("cutoff")

    seen = stored(points.select("activity", "i", "x", above(F.col("x")).alias("up")))
    order = Window.partitionBy("activity").orderBy("i")
    turns = seen.withColumns({"_x0": F.lag("x").over(order), "_up0": F.lag("up").over(order)}).where("up <> _up0")
    edges = turns.join(packed, "activity").select("activity", F.col("up").alias("_rises"), bisect(
        F.col("_x0"), F.col("x"), lambda v: above(v) != F.col("up")).alias("x"))
    ends = edges.select("activity", "x", "_rises", F.lead("x").over(Window.partitionBy("activity").orderBy("x")).alias("_next"))
    inside = ends.where("_rises").select("activity", F.col("x").alias("_from"), F.col("_next").alias("_to"))
    return _outside(packed.select("activity"), inside)


def _kernel_log_density(x: Column) -> Column:
    """Log-density of the packed kernel of a row, told from its largest term, so it never vanishes."""
    def term(s: Column) -> Column:
        return -0.5 * ((x - s["centre"]) / F.col("_h")) * ((x - s["centre"]) / F.col("_h"))

    def whole(top: Column) -> Column:
        total = F.aggregate("slots", F.lit(0.0), lambda acc, s: acc + F.exp(term(s) - top) * s["weight"])
        return top + F.ln(total) - F.ln(F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))

    return let(whole, F.array_max(F.transform("slots", term)))


def all_anomaly_intervals(dists: DataFrame, cutoffs: DataFrame, bins: DataFrame, binwidth: float, bands: DataFrame,
                          slots: DataFrame) -> DataFrame:
    """Intervals below the cut-off for the activities of all families:
    histograms from ``bins``, kernels from ``bands`` and ``slots``."""
    def of(kind: str) -> DataFrame:
        return cutoffs.join(dists.where(F.col("dist_type") == kind).select("activity"), "activity", "left_semi")

    closed = anomaly_intervals(dists.where(~F.col("dist_type").isin("HISTOGRAM", KERNEL)), cutoffs)
    return closed.unionByName(histogram_intervals(bins, of("HISTOGRAM"), binwidth)).unionByName(
        kernel_intervals(bands, slots, of(KERNEL)))


# ---------------------------------------------------------------- baselines and evaluation

def z_outliers(scored: DataFrame, threshold: float = 3.0) -> DataFrame:
    """|x - mean| / sd > threshold for normal activities."""
    mean, sd = (F.try_element_at("params", F.lit(i)) for i in (1, 2))
    z = F.abs(F.col("duration") - mean) / F.when(sd > 0, sd)
    return scored.where(F.col("dist_type") == "NORMAL").withColumns({
        "z": z, "is_z_outlier": F.coalesce(z > threshold, F.lit(False))})


def neighbor_error(flags: DataFrame, flag: str = "is_error") -> DataFrame:
    """Add ``neighbor_is_error``: the step before or after is an error."""
    near = neighbours(flags, ["case_id"], "pos", {"_before": (flag, 1), "_after": (flag, -1)})
    return near.withColumn("neighbor_is_error", F.coalesce("_before", F.lit(False)) | F.coalesce(
        "_after", F.lit(False))).drop("_before", "_after")


def inject_errors(steps: DataFrame, rate: float, seed: int) -> DataFrame:
    """Move steps by N(0, case duration / 6) with chance ``rate``; the following
    step loses what a step gains.  ``label`` is NONE, TIME_ERROR, or
    STRUCTURAL_ERROR where a duration turns negative.  First steps stay."""
    ms = epoch_ms("ts")
    timed = with_case_values(steps, _t0=F.min_by(ms, "pos"), _t1=F.max_by(ms, "pos"))
    hit = (F.col("pos") > 1) & (uniform(seed, "hit", "case_id", "pos") <= rate)
    size = gaussian(seed, "size", "case_id", "pos") * (F.col("_t1") - F.col("_t0")) / 6.0
    drawn = timed.withColumn("error", F.when(hit, size).otherwise(0.0))
    near = neighbours(drawn, ["case_id"], "pos", {"_lost": ("error", 1), "_child": ("duration", -1)})
    moved = F.col("duration") + F.col("error") - F.coalesce("_lost", F.lit(0.0))
    broken = (moved < 0) | F.coalesce(F.col("_child") - F.col("error") < 0, F.lit(False))
    label = F.when(F.col("error") == 0, "NONE").when(broken, "STRUCTURAL_ERROR").otherwise("TIME_ERROR")
    return near.withColumns({"label": label, "observed": moved}).select(*steps.columns, "error", "observed", "label")
