"""Entropy, automata, n-grams, precision, generalisation, fitness and size measures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.filters import case_sequences
from caseloom.operators.joins import map_labels
from caseloom.operators.temporal import START
from caseloom.plans.fingerprint import element_hashes
from caseloom.plans.models import join_model
from caseloom.plans.slices import neighbours, running_dense

OUTCOME = ["n_elements", "out_a", "out_b"]


def _outcomes(elements: DataFrame, a: Column, b: Column) -> DataFrame:
    return elements.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_elements"), F.bit_xor(a).alias("out_a"), F.bit_xor(b).alias("out_b"))


def list_outcomes(log: DataFrame) -> DataFrame:
    """Cases as activity sequences."""
    return case_sequences(log).select("case_id", F.col("n_events").alias("n_elements"),
                                      F.col("seq_a").alias("out_a"), F.col("seq_b").alias("out_b"))


def bag_outcomes(log: DataFrame) -> DataFrame:
    """Cases as activities with their number of occurrences."""
    counts = log.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("_n"))
    return _outcomes(counts, *element_hashes("activity", "_n"))


def set_outcomes(log: DataFrame) -> DataFrame:
    """Cases as sets of activities."""
    return _outcomes(log.select("case_id", "activity").distinct(), *element_hashes("activity"))


# abstraction levels in increasing order of abstraction
LEVELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "list": list_outcomes, "bag": bag_outcomes, "set": set_outcomes}


def outcome_counts(log: DataFrame, level: str) -> DataFrame:
    """Distinct outcomes with their number of cases (fingerprint columns, ``n``)."""
    return LEVELS[level](log).groupBy(*OUTCOME).agg(F.count(F.lit(1)).alias("n"))


def log_entropy(log: DataFrame, level: str = "list") -> DataFrame:
    """Entropy in bits of the outcome distribution: H = log2 N - sum(n log2 n) / N."""
    counts = outcome_counts(log, level)
    n = F.col("n").cast("double")
    return counts.agg(F.count(F.lit(1)).alias("n_outcomes"), (
        F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"))


def table_entropy(table: DataFrame, probability: str, keys: list[str] | None = None) -> DataFrame:
    """Natural-log entropy of a probability table."""
    p = F.col(probability)
    return table.groupBy(*(keys or [])).agg(F.sum(F.when(p > 0, -p * F.ln(F.greatest(p, F.lit(1e-300)))).otherwise(0.0)).alias("entropy"))


def quantile_entropy(log: DataFrame, q: float = 0.9, level: str = "list") -> DataFrame:
    """Entropy over the most probable outcomes until their mass reaches ``q``
    (probabilities among the kept ones): ``n_outcomes, mass, entropy``.

    Outcomes with equal counts are interchangeable, so the running mass is
    taken over the distinct counts; there are at most sqrt(2 * cases) of them.
    """
    levels = outcome_counts(log, level).groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    total = levels.agg(F.sum(F.col("n") * F.col("m"))).scalar()
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    held = levels.withColumn("_before", F.coalesce(F.sum(F.col("n") * F.col("m")).over(before), F.lit(0)))
    room = F.ceil((F.lit(q) * total - F.col("_before")) / F.col("n") - 1e-9)
    kept = held.withColumn("_kept", F.greatest(F.least(room, F.col("m")), F.lit(0)))
    size, n = F.col("_kept").cast("double"), F.col("n").cast("double")
    mass = F.sum(size * n)
    return kept.agg(F.sum("_kept").cast("bigint").alias("n_outcomes"), (mass / F.max(total)).alias("mass"),
                    (F.log2(mass) - F.sum(size * n * F.log2(n)) / mass).alias("entropy"))


# ---------------------------------------------------------------- automata

STATE = ["depth", "state_a", "state_b"]


def _prefix_steps(log: DataFrame) -> DataFrame:
    """Events with the fingerprint of the sequence up to and including them and
    the next activity (null at the end)."""
    a, b = element_hashes("pos", "activity")
    walked = running_dense(log.select("case_id", "pos", "activity"), ["case_id"], "pos",
                           {"state_a": ("xor", a), "state_b": ("xor", b)})
    return neighbours(walked, ["case_id"], "pos", {"next": ("activity", -1)}).withColumnRenamed("pos", "depth")


def prefix_automaton(log: DataFrame) -> DataFrame:
    """Prefix states of the log: ``depth, state_a, state_b, activity`` (the last
    one), ``n`` visits, ``n_ends`` and the sorted ``outgoing`` activities.  The
    start is the state of depth 0."""
    steps = _prefix_steps(log)
    edges = steps.groupBy(*STATE, "activity", "next").agg(F.count(F.lit(1)).alias("n"))
    firsts = log.where(F.col("pos") == 1).groupBy(F.col("activity").alias("next")).agg(F.count(F.lit(1)).alias("n"))
    root = firsts.select(F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("state_a"),
                         F.lit(0).cast("bigint").alias("state_b"), F.lit(START).alias("activity"), "next", "n")
    return edges.unionByName(root).groupBy(*STATE, "activity").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("next").isNull(), F.col("n"))), F.lit(0)).alias("n_ends"),
        F.sort_array(F.collect_set("next")).alias("outgoing"))


def suffix_states(log: DataFrame) -> DataFrame:
    """Distinct remaining sequences after an event: ``length, state_a, state_b``
    and the number ``n`` of events they follow; traces share them."""
    lengths = log.groupBy("case_id").agg(F.max("pos").alias("n_events"))
    from caseloom.plans.slices import attach_cases
    events = attach_cases(log.select("case_id", "pos", "activity"), lengths, "n_events")
    left = F.col("n_events") - F.col("pos")
    a, b = element_hashes(left, F.col("activity"))
    back = events.withColumns({"_place": left + 1})
    walked = running_dense(back, ["case_id"], "_place", {"state_a": ("xor", a), "state_b": ("xor", b)}, exclusive=True)
    return walked.groupBy(left.alias("length"), "state_a", "state_b").agg(F.count(F.lit(1)).alias("n"))


def ngram_transitions(log: DataFrame, k: int) -> DataFrame:
    """Counts of moves between windows of the last ``k`` activities:
    ``before, after, n`` (names joined by ','; '' before the case start)."""
    lags = {f"_l{i}": ("activity", i) for i in range(1, k + 1)}
    seen = neighbours(log.select("case_id", "pos", "activity"), ["case_id"], "pos", lags)
    names = [F.coalesce(F.col(f"_l{i}"), F.lit("")) for i in range(k, 0, -1)]
    return seen.groupBy(F.concat_ws(",", *names).alias("before"),
                        F.concat_ws(",", *names[1:], F.col("activity")).alias("after")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- model quality

def precision_generalization(log: DataFrame, model: DataFrame) -> DataFrame:
    """Escaping-edge precision and generalisation against a model given as
    allowed moves (``state, activity``; the state is the last activity).

    Log contexts are prefixes; generalisation pools the contexts of a model state.
    """
    steps = _prefix_steps(log).select(*STATE, F.col("activity").alias("state"), F.col("next"))
    first = log.where(F.col("pos") == 1).select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("state_a"),
        F.lit(0).cast("bigint").alias("state_b"), F.lit(START).alias("state"), F.col("activity").alias("next"))
    moves = steps.unionByName(first).where(F.col("next").isNotNull()).groupBy(*STATE, "state", "next").agg(
        F.count(F.lit(1)).alias("f"))
    contexts = moves.groupBy(*STATE, "state").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("in_log"))
    allowed = model.select("state", "activity").distinct().groupBy("state").agg(F.count(F.lit(1)).alias("in_model"))
    per_state = moves.groupBy("state", "next").agg(F.sum("f").alias("f")).groupBy("state").agg(
        F.sum("f").alias("f"), F.count(F.lit(1)).alias("k"))
    joined = contexts.join(allowed, "state", "left")
    precise = joined.agg((F.sum(F.when(F.col("in_model") > 0, F.col("f") * F.col("in_log") / F.col("in_model")))
                          / F.sum("f")).alias("precision"))
    k, n = F.col("k").cast("double"), F.col("f").cast("double")
    new = F.when(n >= k + 2, k * (k + 1) / F.greatest(n * (n - 1), F.lit(1.0))).otherwise(1.0)
    general = per_state.agg((F.lit(1.0) - F.sum(n * new) / F.sum(n)).alias("generalization"))
    return precise.withColumn("generalization", general.scalar())


def label_fitness(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean over cases of the share of events whose class maps to a label."""
    mapping = map_labels(log.select("activity").distinct(), labels)
    known = mapping.where(F.col("activity").isNotNull()).select("activity").distinct().withColumn("_hit", F.lit(1.0))
    hits = join_model(log.select("case_id", "activity"), known, ["activity"], "left")
    shares = hits.groupBy("case_id").agg((F.sum(F.coalesce("_hit", F.lit(0.0))) / F.count(F.lit(1))).alias("share"))
    return shares.agg(F.count(F.lit(1)).alias("n_cases"), F.avg("share").alias("fitness"))


def dfg_size(log: DataFrame) -> DataFrame:
    """Activities plus directly-follows edges."""
    edges = neighbours(log.select("case_id", "pos", "activity"), ["case_id"], "pos", {"next": ("activity", -1)})
    pairs = edges.groupBy("activity", "next").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.countDistinct("activity").alias("nodes"), F.count_if(F.col("next").isNotNull()).alias("edges")
                     ).withColumn("size", F.col("nodes") + F.col("edges"))


# ---------------------------------------------------------------- measure grid

PROVIDERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "entropy": lambda log, level: log_entropy(log, level).select("entropy"),
    "quantile_entropy": lambda log, level: quantile_entropy(log, 0.9, level).select("entropy"),
    "outcomes": lambda log, level: log_entropy(log, level).select(F.col("n_outcomes").cast("double").alias("n")),
}


def measures(log: DataFrame, levels: list[str] | None = None, providers: list[str] | None = None) -> DataFrame:
    """Long table ``measure, level, value`` over the grid of providers and levels."""
    rows = []
    for provider in providers or list(PROVIDERS):
        for level in levels or list(LEVELS):
            value = PROVIDERS[provider](log, level)
            rows.append(value.select(F.lit(provider).alias("measure"), F.lit(level).alias("level"),
                                     F.col(value.columns[0]).alias("value")))
    return reduce(DataFrame.unionByName, rows)
