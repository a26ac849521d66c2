"""Label mapping, activity intervals, as-of lookups, movements, similarity joins, competitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.maths import epoch_ms
from caseloom.functions.names import ITERATION_MARK, label_base
from caseloom.plans.lineage import stored
from caseloom.plans.models import join_model
from caseloom.plans.slices import neighbours, positions, running_in_case, sweep

DUMMY = "DUMMY"


def map_labels(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Model labels to event classes: an exact match wins, else the class whose
    base name (or base plus ``+complete``) equals the label's base, the smallest
    name first.  ``label, activity, event_class`` (activity null and class DUMMY
    where nothing fits)."""
    names = classes.select("activity").distinct()
    wanted = labels.select("label").distinct()
    exact = wanted.join(names, wanted["label"] == names["activity"]).select("label", F.col("activity").alias("_exact"))
    base = label_base(F.col("activity"))
    spelled = names.select(F.explode(F.array(base, F.concat(base, F.lit("+complete")))).alias("_base"), "activity")
    rooted = wanted.withColumn("_base", F.substring_index("label", ITERATION_MARK, 1))
    loose = rooted.join(spelled, "_base").groupBy("label").agg(F.min("activity").alias("_loose"))
    return (wanted.join(exact, "label", "left").join(loose, "label", "left")
            .select("label", F.coalesce("_exact", "_loose").alias("activity"))
            .withColumn("event_class", F.coalesce("activity", F.lit(DUMMY))))


def to_intervals(log: DataFrame) -> DataFrame:
    """Pair start and complete events of the same (case, activity, instance):
    the last open start wins; a complete without start has length zero.
    ``case_id, activity, instance, start, end, pos`` (pos of the complete)."""
    base = log.select("case_id", "activity", F.coalesce("instance", F.lit("")).alias("instance"), "pos", "ts",
                      F.lower("lifecycle").alias("lifecycle"))
    keys = ["case_id", "activity", "instance"]
    done = (F.col("lifecycle") == "complete")
    rounds = running_in_case(base, keys[1:], {"_round": ("sum", done.cast("int"))}, exclusive=True, log=log)
    return rounds.groupBy(*keys, "_round").agg(
        F.max(F.when(done, F.col("ts"))).alias("end"), F.max(F.when(done, F.col("pos"))).alias("pos"),
        F.max_by("ts", F.when(F.col("lifecycle") == "start", F.col("pos"))).alias("_start")
    ).where(F.col("pos").isNotNull()).select(
        *keys, F.coalesce("_start", "end").alias("start"), "end", "pos")


def last_observation(training: DataFrame, probes: DataFrame, keys: list[str], value: str, order: list[str],
                     inclusive: bool = False) -> DataFrame:
    """As-of lookup: add ``observed``, the latest training value strictly before
    (``inclusive``: up to) the probe time ``ts``.  ``order`` breaks ties among
    training rows.

    Training rows and probes are swept together, so a key with a third of all
    rows, or of a single time, is spread over many tasks.
    """
    tie = F.struct(*[F.col(c) for c in order])
    empty = F.lit(None)
    left = training.select(*keys, "ts", F.lit(1).alias("_kind"), tie.alias("_tie"), F.col(value).alias("_value"))
    extra = [c for c in probes.columns if c not in (*keys, "ts")]
    right = probes.select(*keys, "ts", F.lit(2 if inclusive else 0).alias("_kind"), F.struct(*extra).alias("_probe"))
    both = left.withColumn("_probe", empty.cast(right.schema["_probe"].dataType)).unionByName(
        right.withColumns({"_tie": empty.cast(left.schema["_tie"].dataType),
                           "_value": empty.cast(left.schema["_value"].dataType)}))
    swept = sweep(both, keys, ["ts", "_kind", "_tie"], {"observed": ("last", F.col("_value"))})
    return swept.where(F.col("_kind") != 1).select(*keys, "ts", *[F.col(f"_probe.`{c}`").alias(c) for c in extra],
                                                   "observed")


def resource_movements(intervals: DataFrame, distances: DataFrame, speeds: DataFrame,
                       single: Column | None = None) -> DataFrame:
    """Travel between the locations of consecutive activities of a resource.

    ``intervals``: resource, location, start, end (and a unique ``id``);
    ``distances``: origin, target, distance; ``speeds``: resource, speed (metres
    per second).  ``travel_ms`` is 0 after an activity that a single event
    stands for: where ``single`` holds of its interval (default: its start is
    its end); ``idle`` marks records with travel.
    """
    intervals = intervals.withColumn("_single", F.col("start") == F.col("end") if single is None else single)
    placed = positions(intervals, ["resource"], ["start", "id"], "_place")
    linked = neighbours(placed, ["resource"], "_place", {
        "origin": ("location", 1), "_alone": ("_single", 1), "_end": ("end", 1)})
    moves = linked.where(F.col("_end").isNotNull()).select(
        "resource", "id", "origin", F.col("location").alias("target"), "_alone", "_end", "start")
    far = join_model(moves, distances.select("origin", "target", "distance"), ["origin", "target"], "left")
    fast = join_model(far, speeds, ["resource"])
    travel = F.floor(F.coalesce("distance", F.lit(0.0)) / F.col("speed") * 1000).cast("bigint")
    travel = F.when(F.col("_alone"), 0).otherwise(travel).cast("bigint")
    return fast.select("resource", "id", "origin", "target", epoch_ms("_end").alias("from_ms"),
                       travel.alias("travel_ms"), (epoch_ms("start") - epoch_ms("_end")).alias("gap_ms"),
                       (travel > 0).alias("idle"))


# ---------------------------------------------------------------- similarity of cases

def case_jaccard(log: DataFrame, min_similarity: float) -> DataFrame:
    """Pairs of distinct activity sets with Jaccard similarity at least
    ``min_similarity``: ``left, right, n_left, n_right, similarity`` (n = cases
    with the set); a set is paired with itself too.

    Two sets that similar share one of the first |s| - ceil(t|s|) + 1 activities
    in ascending frequency order, so only those are joined on and common
    activities rarely meet.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be in (0, 1]")
    sets = stored(log.groupBy("case_id").agg(F.sort_array(F.collect_set("activity")).alias("items"))
                  .groupBy("items").agg(F.count(F.lit(1)).alias("n")))
    frequency = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    ordered = (sets.select("items", "n", F.explode("items").alias("item")).join(frequency, "item")
               .groupBy("items", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "item"))).alias("rare")))
    size = F.size("items")
    keep = size - F.ceil(size * F.lit(min_similarity) - 1e-9) + 1
    keyed = ordered.select("items", "n", F.explode(F.slice("rare", F.lit(1), keep.cast("int"))).alias("r"))
    left = keyed.select(F.col("r.item").alias("item"), F.col("items").alias("left"), F.col("n").alias("n_left"))
    right = keyed.select(F.col("r.item").alias("item"), F.col("items").alias("right"), F.col("n").alias("n_right"))
    close = F.least(F.size("left"), F.size("right")) >= F.greatest(F.size("left"), F.size("right")) * min_similarity - 1e-9
    pairs = left.join(right, "item").where((F.col("left") <= F.col("right")) & close).drop("item").distinct()
    similarity = F.size(F.array_intersect("left", "right")) / F.greatest(F.size(F.array_union("left", "right")), F.lit(1))
    return pairs.withColumn("similarity", similarity).where(F.col("similarity") >= min_similarity - 1e-9)


PARTS = 64  # tasks that share the products of two families


def cross_union(first: DataFrame, second: DataFrame, col: str = "items") -> DataFrame:
    """Distinct unions of a set of the first family with one of the second; an
    empty family is neutral.  Both families are made distinct first; every part
    of the first meets a copy of the second, so no family has to be small."""
    ours = stored(first.select(F.sort_array(F.array_distinct(col)).alias(col)).distinct())
    theirs = stored(second.select(F.sort_array(F.array_distinct(col)).alias("_other")).distinct())
    if theirs.isEmpty():
        return ours
    if ours.isEmpty():
        return theirs.select(F.col("_other").alias(col))
    parts = ours.withColumn("_part", F.pmod(F.xxhash64(col), F.lit(PARTS)))
    copies = theirs.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    return parts.join(copies, "_part").select(F.sort_array(F.array_union(col, "_other")).alias(col)).distinct()


# ---------------------------------------------------------------- competitors, weights, censoring

def with_state(log: DataFrame) -> DataFrame:
    """Add ``state`` (the previous activity, ``_Start`` for the first) and
    ``elapsed`` (ms in that state)."""
    from caseloom.operators.temporal import START
    seen = neighbours(log, ["case_id"], "pos", {"state": ("activity", 1), "_ms": (epoch_ms("ts"), 1)})
    return seen.withColumns({"state": F.coalesce("state", F.lit(START)),
                             "elapsed": F.coalesce(epoch_ms("ts") - F.col("_ms"), F.lit(0))}).drop("_ms")


def successors(steps: DataFrame) -> DataFrame:
    """``state, activity, n``: what fired in each state."""
    return steps.groupBy("state", "activity").agg(F.count(F.lit(1)).alias("n"))


def competitors(steps: DataFrame, moves: DataFrame) -> DataFrame:
    """Activities that could have fired in the state of a step but did not:
    one row per step and competitor (``competitor``)."""
    options = moves.select("state", F.col("activity").alias("competitor"))
    return join_model(steps, options, ["state"]).where(F.col("competitor") != F.col("activity"))


def branch_weights(moves: DataFrame, immediate: DataFrame | None = None) -> DataFrame:
    """``state, activity, n, weight, probability``: the weight of an activity is
    1 + its firings; probabilities are shares among the options of a state.

    Under a race policy pass the ``immediate`` activities: states in which none
    of them fired do not count into the weights.
    """
    counted = moves
    if immediate is not None:
        fast = moves.join(immediate.select("activity").distinct(), "activity", "left_semi").select("state").distinct()
        counted = moves.join(fast, "state", "left_semi")
    fired = counted.groupBy("activity").agg(F.sum("n").alias("_n"))
    weighed = moves.join(fired, "activity", "left").withColumn(
        "weight", F.lit(1.0) + F.coalesce("_n", F.lit(0)))
    totals = weighed.groupBy("state").agg(F.sum("weight").alias("_total"))
    return weighed.join(totals, "state").select("state", "activity", "n", "weight",
                                                (F.col("weight") / F.col("_total")).alias("probability"))


POLICIES = ("global_preselection", "race_resampling", "race_enabling_memory", "race_age_memory")


def _ages(steps: DataFrame, moves: DataFrame, policy: str) -> DataFrame:
    """Per step and enabled activity: the time it has been enabled up to and
    including this step, since it last fired (or, with enabling memory, was
    disabled)."""
    options = moves.select("state", F.col("activity").alias("option"))
    enabled = join_model(steps, options, ["state"])
    after = moves.select(F.col("state").alias("activity"), F.col("activity").alias("option"), F.lit(True).alias("_still"))
    enabled = join_model(enabled, after, ["activity", "option"], "left")
    fires = F.col("option") == F.col("activity")
    lost = ~fires & F.col("_still").isNull()
    resets = (fires | lost) if policy == "race_enabling_memory" else fires
    base = enabled.select("case_id", "pos", "activity", "state", "option", "elapsed", fires.alias("fires"),
                          lost.alias("disabled"), resets.cast("int").alias("_reset"))
    islands = running_in_case(base, ["option"], {"_island": ("sum", F.col("_reset"))}, exclusive=True, log=steps)
    return running_in_case(islands, ["option", "_island"], {"age": ("sum", F.col("elapsed"))}, log=steps)


def censored_durations(steps: DataFrame, moves: DataFrame, policy: str = "race_resampling") -> DataFrame:
    """Right-censored samples ``case_id, pos, activity, duration`` (ms > 0) of
    activities that were enabled but lost: the time in the state under race
    resampling; the accumulated time at disabling under enabling memory; none
    under age memory, where time carries over, and under preselection."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "race_resampling":
        lost = competitors(steps.where(F.col("elapsed") > 0), moves)
        return lost.select("case_id", "pos", F.col("competitor").alias("activity"), F.col("elapsed").alias("duration"))
    ages = _ages(steps, moves, policy).where(F.col("disabled") & (F.col("age") > 0))
    found = ages.select("case_id", "pos", F.col("option").alias("activity"), F.col("age").alias("duration"))
    return found if policy == "race_enabling_memory" else found.where(F.lit(False))


def firing_durations(steps: DataFrame, moves: DataFrame, policy: str = "race_resampling") -> DataFrame:
    """Duration samples of the fired activities under an execution policy:
    memory policies add the time the activity was enabled before."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    if policy in ("race_resampling", "global_preselection"):
        return steps.select("case_id", "pos", "activity", F.col("elapsed").alias("duration"))
    return _ages(steps, moves, policy).where("fires").select(
        "case_id", "pos", "activity", F.col("age").alias("duration"))
