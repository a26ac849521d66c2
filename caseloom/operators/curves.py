"""Similarity join of case time series by dynamic time warping (Manhattan distance of activity sets).

Equal curves are collapsed first. Warping moves along a run of equal points at no cost, so two curves whose sequences of
distinct neighbouring sets agree have distance 0; such curves form a *shape*. Since every warping path over the points is
also one over the runs, the distance of two shapes is a lower bound for all their curves, and far fewer shapes are
compared than curves.

Shapes are joined on an exact lower bound of their own: along a warping path both curves are stretched to the same length,
which leaves the number of runs of each activity as it is, and a difference at one point and activity changes that number by
one at most. So the distance is at least the L1 distance of the run counts, and shapes within ``threshold`` share a bag of
run counts from which both remove no more than ``threshold`` runs altogether. Each shape emits these bags (about
activities ** threshold of them) and meets the others in plain joins. For a threshold of 1 they meet on their order, too:
at most one step of the path costs anything, so no more than one run of either shape has no equal one, and what is left
without it (equal neighbours in one) is the same sequence; only such pairs are looked up in their bags. Shapes that stay within the threshold bring their
curves together. A run longer than the threshold has a point that costs nothing on any path within it, and such a point
stands for any number of them: so lengths count up to ``threshold + 1`` only, and curves that agree in them form a *class*.
Classes are compared point by point, once for all pairs of their curves; both comparisons give up a pair once no path can
stay within the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.maths import epoch_ms
from caseloom.operators.windows import active_points, last_point, point_at
from caseloom.plans.lineage import stored
from caseloom.plans.slices import long_cases

PIECE = 256  # pairs compared at once
MANY_SETS = 2048  # different sets of some pairs whose differences are told at once
PAIRS = "left string, right string, distance bigint"


def case_curves(series: DataFrame) -> DataFrame:
    """``case_id, sets, lengths``: the runs of equal points of every case time series."""
    point = F.struct("t", F.array_sort(F.coalesce("active", F.array().cast("array<string>"))).alias("active"))
    listed = series.groupBy("case_id").agg(F.sort_array(F.collect_list(point)).alias("p"))
    starts = F.expr("filter(p, (x, i) -> i = 0 OR x.active <> p[i - 1].active)")
    cut = listed.select("case_id", "p", F.expr("filter(sequence(0, size(p) - 1), i -> i = 0 OR p[i].active <> p[i - 1].active)")
                        .alias("s"), starts.alias("r"))
    return cut.select("case_id", F.col("r.active").alias("sets"),
                      F.expr("transform(s, (x, i) -> coalesce(get(s, i + 1), size(p)) - x)").alias("lengths"))


def log_curves(log: DataFrame) -> DataFrame:
    """``case_curves`` of the ``case_time_series`` of a log, without its points at which nothing is active.

    A case of one slice brings its events together once and is told from them; longer ones (and spans of a lifecycle)
    take their points from ``active_points``."""
    if "lifecycle" in log.columns:
        return curves_of_points(*active_points(log))
    longer = stored(long_cases(log))
    if longer.isEmpty():
        return case_events(log)
    apart = F.broadcast(longer)
    return case_events(log.join(apart, "case_id", "left_anti")).union(
        curves_of_points(*active_points(log.join(apart, "case_id", "left_semi"))))


def case_events(log: DataFrame) -> DataFrame:
    """``curves_of_points`` of cases whose events are gathered one by one."""
    event = F.struct(epoch_ms("ts").alias("ms"), "activity")
    cases = log.where(F.col("case_id").isNotNull() & F.col("pos").isNotNull()).groupBy("case_id").agg(
        F.min_by(epoch_ms("ts"), "pos").alias("_t0"), F.max_by(epoch_ms("ts"), "pos").alias("_t1"),
        F.collect_list(event).alias("e"))
    point = F.transform("e", lambda e: F.struct(point_at(e["ms"]).alias("t"), e["activity"].alias("a")))
    placed = cases.select("case_id", last_point().alias("_end"), F.array_sort(F.array_distinct(point)).alias("e"))
    times = placed.select("case_id", "_end", "e", F.expr("array_distinct(filter(e.t, t -> t IS NOT NULL))").alias("times"))
    return _curves(times.select("case_id", "_end", F.expr("""transform(times, t -> named_struct('t', t, 'active',
        transform(filter(e, x -> x.t = t AND x.a IS NOT NULL), x -> x.a)))""").alias("p")))


def curves_of_points(points: DataFrame, active: DataFrame) -> DataFrame:
    """The curves of ``active_points``."""
    ends = points.groupBy("case_id").agg(F.max("_end").alias("_end"))
    return _curves(active.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("t", "active"))).alias("p")).join(
        ends, "case_id").select("case_id", "_end", "p"))


def _curves(listed: DataFrame) -> DataFrame:
    """Runs of the points ``p`` (in order) of cases that end at ``_end``."""
    inside = listed.select("case_id", "_end", F.expr("filter(p, x -> x.t BETWEEN 0 AND _end)").alias("p"))
    # an empty run begins at 0, or behind a point, unless an active point is there
    none = "named_struct('t', {}, 'active', CAST(array() AS array<string>))"
    filled = inside.select("case_id", "_end", F.expr(f"""concat(
        CASE WHEN coalesce(get(p, 0).t, -1) = 0 THEN array() ELSE array({none.format('0')}) END,
        flatten(transform(p, (x, i) -> CASE WHEN coalesce(get(p, i + 1).t, _end + 1) = x.t + 1 THEN array(x)
            ELSE array(x, {none.format('x.t + 1')}) END)))""").alias("p"))
    runs = filled.select("case_id", "_end", F.expr("filter(p, (x, i) -> i = 0 OR x.active <> p[i - 1].active)").alias("r"))
    return runs.select("case_id", F.col("r.active").alias("sets"), F.expr(
        "transform(r, (x, i) -> coalesce(get(r, i + 1).t, _end + 1) - x.t)").alias("lengths"))


def distinct_curves(cases: DataFrame) -> DataFrame:
    """``curve`` (its smallest case), ``shape`` (smallest case of its shape), ``n`` (cases), ``sets, lengths``."""
    curves = stored(cases.groupBy("sets", "lengths").agg(F.min("case_id").alias("curve"), F.count(F.lit(1)).alias("n")))
    shapes = stored(curves.groupBy("sets").agg(F.min("curve").alias("shape")))
    return stored(curves.join(shapes, "sets").select("curve", "shape", "n", "sets", "lengths"))


def run_counts(sets: Column) -> Column:
    """The bag of runs: every activity once per run of it."""
    return F.array_sort(F.flatten(F.transform(sets, lambda s, i: F.when(i == 0, s).otherwise(
        F.array_except(s, F.get(sets, i - 1))))))


def smaller_bags(shapes: DataFrame, threshold: int) -> DataFrame:
    """``shape, bag, gone``: the bags that are left without up to ``threshold`` of the runs."""
    step = shapes.select("shape", run_counts(F.col("sets")).alias("bag"), F.lit(0).alias("gone"))
    out = step
    for _ in range(threshold):
        rest = F.expr("array_distinct(transform(sequence(0, size(bag) - 1), i -> "
                      "concat(slice(bag, 1, i), slice(bag, i + 2, size(bag)))))")
        step = step.where(F.size("bag") > 0).select("shape", F.explode(rest).alias("bag"), (F.col("gone") + 1).alias("gone"))
        step = step.distinct()
        out = out.union(step)
    return out


def _warped(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``left, right`` with their runs ``sets, lengths`` and ``sets2, lengths2`` within the threshold."""
    def differences(sets):
        """Activities in which any two of some sets differ."""
        names = {a: i for i, a in enumerate({a for s in sets for a in s})}
        held = np.zeros((len(sets), len(names)), dtype=np.float32)
        for i, s in enumerate(sets):
            held[i, [names[a] for a in s]] = 1
        size = held.sum(axis=1)
        return (size[:, None] + size - 2 * (held @ held.T)).astype(np.int32)

    def distances(cost):
        """Warping distances of many pairs of equally long curves; -1 beyond the threshold."""
        found, alive = np.full(len(cost), -1, dtype=np.int64), np.arange(len(cost))
        best = np.cumsum(cost[:, 0], axis=1)
        for i in range(1, cost.shape[1]):
            prefix = np.cumsum(cost[alive, i], axis=1)
            arrive = best.copy()
            arrive[:, 1:] = np.minimum(best[:, 1:], best[:, :-1]) - prefix[:, :-1]
            best = np.minimum.accumulate(arrive, axis=1) + prefix
            near = best.min(axis=1) <= threshold
            if not near.all():
                alive, best = alive[near], best[near]
                if not len(alive):
                    return found
        near = best[:, -1] <= threshold
        found[alive[near]] = best[near, -1]
        return found

    def costs(part, runs):
        """Differences at all points of the curves of some pairs."""
        number: dict[frozenset, int] = {}
        one, two = (np.stack([np.repeat([number.setdefault(frozenset(s), len(number)) for s in sets[k]], lengths[k])
                              for k in part]) for sets, lengths in (runs[:2], runs[2:]))
        if len(number) > MANY_SETS and len(part) > 1:
            return np.concatenate([costs(part[k: k + 1], runs) for k in range(len(part))])
        return differences(list(number))[one[:, :, None], two[:, None, :]]

    def compare(batches):
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            left, right = columns["left"], columns["right"]
            runs = [columns[c].to_pylist() for c in ("sets", "lengths", "sets2", "lengths2")]
            sizes: dict[tuple, list[int]] = {}
            for k, (n, m) in enumerate(zip(runs[1], runs[3])):
                sizes.setdefault((sum(n), sum(m)), []).append(k)
            for some in sizes.values():
                for low in range(0, len(some), PIECE):
                    part = np.array(some[low: low + PIECE])
                    found = distances(costs(part, runs))
                    at = pa.array(part[found >= 0])
                    yield pa.RecordBatch.from_arrays([left.take(at), right.take(at), pa.array(found[found >= 0])],
                                                     ["left", "right", "distance"])

    # few bytes but much work per row: the pairs are spread over a stated number of tasks, which is not made smaller for
    # their bytes; by a hash, as pairs that are already dealt by their names would not be dealt again
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, F.xxhash64("left", "right")).mapInArrow(compare, PAIRS)


def shorter_sequences(shapes: DataFrame) -> DataFrame:
    """``shape, print``: hashes of the sequence of runs, whole and without each one of them."""
    rest = """concat(array(sets), transform(sequence(0, size(sets) - 1), i -> CASE
        WHEN i > 0 AND i < size(sets) - 1 AND get(sets, i - 1) = get(sets, i + 1) THEN concat(slice(sets, 1, i), slice(sets, i + 3, size(sets)))
        ELSE concat(slice(sets, 1, i), slice(sets, i + 2, size(sets))) END))"""
    prints = F.transform(F.expr(rest), lambda s: F.xxhash64(F.transform(s, lambda x: F.struct(F.size(x).alias("n"), x.alias("x")))))
    return shapes.select("shape", F.explode(F.array_distinct(prints)).alias("print"))


def met_in_order(shapes: DataFrame) -> DataFrame:
    """``left, right`` of different shapes that may have distance 1."""
    prints = stored(shorter_sequences(shapes))
    met = prints.withColumnRenamed("shape", "left").join(prints.withColumnRenamed("shape", "right"), "print").where(
        F.col("left") < F.col("right")).select("left", "right").distinct()
    # the bag with its copies numbered: a set, of which the two differ in one
    bag = run_counts(F.col("sets"))
    numbered = F.transform(bag, lambda a, i: F.struct(a.alias("a"), (i - F.array_position(bag, a)).alias("k")))
    bags = shapes.select("shape", numbered.alias("bag"))
    ends = met.join(bags.toDF("left", "x"), "left").join(bags.toDF("right", "y"), "right")
    return ends.where(F.size(F.array_except("x", "y")) + F.size(F.array_except("y", "x")) <= 1).select("left", "right")


def met_in_bags(shapes: DataFrame, threshold: int) -> DataFrame:
    """``left, right`` of different shapes that may have a distance within the threshold."""
    bags = stored(smaller_bags(shapes, threshold))
    other = bags.select(F.col("shape").alias("right"), "bag", F.col("gone").alias("gone2"))
    return bags.withColumnRenamed("shape", "left").join(other, "bag").where(
        (F.col("left") < F.col("right")) & (F.col("gone") + F.col("gone2") <= threshold)).select("left", "right").distinct()


def near_shapes(shapes: DataFrame, threshold: int) -> DataFrame:
    """``left, right, distance`` of different shapes within the threshold, each pair once."""
    met = met_in_order(shapes) if threshold == 1 else met_in_bags(shapes, threshold)
    ones = shapes.select("shape", "sets", F.transform("sets", lambda s: F.lit(1)).alias("lengths"))
    pairs = met.join(ones.toDF("left", "sets", "lengths"), "left").join(ones.toDF("right", "sets2", "lengths2"), "right")
    return _warped(pairs, threshold)


def similar_curves(series: DataFrame, threshold: int) -> DataFrame:
    """All pairs of distinct curves of ``case_time_series`` within a whole warping distance:
    ``left, right, n_left, n_right, distance``, where a curve is named by its smallest case and n counts its cases.

    Pairs at distance 0 are not listed two by two: every curve has one row with the first curve of its shape (itself, if
    it is that). All others have ``left < right`` and a distance from 1 to ``threshold``.
    """
    return _similar(case_curves(series), threshold)


def similar_cases(log: DataFrame, threshold: int) -> DataFrame:
    """``similar_curves`` of the time series of a log."""
    return _similar(log_curves(log), threshold)


def _similar(cases: DataFrame, threshold: int) -> DataFrame:
    short = F.transform("lengths", lambda x: F.least(x, F.lit(threshold + 1))).alias("short")
    curves = distinct_curves(cases).withColumn("short", short)
    classes = stored(curves.groupBy("shape", "sets", "short").agg(F.min("curve").alias("class")))
    curves = stored(curves.join(classes.select("shape", "short", "class"), ["shape", "short"]).select(
        "curve", "shape", "class", "n"))
    shapes = classes.groupBy("shape").agg(F.first("sets").alias("sets"))
    found = stored(near_shapes(stored(shapes), threshold).select("left", "right"))
    ends = found.join(classes.select(F.col("shape").alias("left"), F.col("class").alias("a"), "sets", F.col("short").alias(
        "lengths")), "left")
    ends = ends.join(classes.select(F.col("shape").alias("right"), F.col("class").alias("b"), F.col("sets").alias("sets2"),
                                    F.col("short").alias("lengths2")), "right")
    near = stored(_warped(ends.select(F.col("a").alias("left"), F.col("b").alias("right"), "sets", "lengths", "sets2",
                                      "lengths2"), threshold))
    one, two = (curves.select(F.col("class").alias(c), F.struct("curve", "n").alias(k)) for c, k in (("left", "x"), ("right", "y")))
    pairs = near.join(one, "left").join(two, "right").select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "distance")
    firsts = curves.where("curve = shape").select("shape", F.struct("curve", "n").alias("x"))
    same = curves.join(firsts, "shape").select("x", F.struct("curve", "n").alias("y"), F.lit(0).cast("bigint").alias("distance"))
    return pairs.union(same).select(F.col("x.curve").alias("left"), F.col("y.curve").alias("right"), F.col("x.n").alias("n_left"),
                                    F.col("y.n").alias("n_right"), "distance")
