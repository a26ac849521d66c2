"""Remaining case time: baselines, state models, deadline risk, evaluation."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.maths import epoch_ms, normal_cdf, normal_pdf
from caseloom.functions.special import beta_cdf, gamma_cdf
from caseloom.operators.aggs import case_durations, forecast_eval
from caseloom.operators.filters import number_cases
from caseloom.operators.joins import last_observation
from caseloom.operators.windows import lookup_ranks, sample_rank
from caseloom.plans.fingerprint import element_hashes
from caseloom.plans.lineage import reusable, stored
from caseloom.plans.models import join_model, split_join
from caseloom.plans.ranks import value_ranks
from caseloom.plans.slices import attach_cases, positions, running_dense, running_in_case, with_case_values

STATES = ("last", "set", "list", "bag")
MEETING_ROWS = 100_000  # events of a task that copies each of them to the subsets that hold it


def with_prefix_state(log: DataFrame, state: str) -> DataFrame:
    """Add ``state``: a key of the prefix up to and including each event, taken
    as last activity, set, list or bag of its activities.  Sets, lists and bags
    are running xor fingerprints; no prefix is ever built."""
    if state == "last":
        return log.withColumn("state", F.col("activity"))
    if state == "list":
        a, b = element_hashes("pos", "activity")
    elif state in ("set", "bag"):
        nth = running_in_case(log, ["activity"], {"_nth": ("sum", F.lit(1).cast("bigint"))})
        now, before = (element_hashes(F.col("activity"), n) for n in (F.col("_nth"), F.col("_nth") - 1))
        none = F.lit(0).cast("bigint")
        if state == "set":
            a, b = (F.when(F.col("_nth") == 1, h).otherwise(none) for h in element_hashes("activity"))
        else:
            # the count of one activity moves on: its old element leaves, the new one enters
            a, b = (h.bitwiseXOR(F.when(F.col("_nth") > 1, o).otherwise(none)) for h, o in zip(now, before))
        log = nth
    else:
        raise ValueError(f"unknown state {state!r}")
    walked = running_dense(log, ["case_id"], "pos", {"_a": ("xor", a), "_b": ("xor", b)})
    return walked.withColumn("state", F.concat_ws(":", F.hex("_a"), F.hex("_b"))).drop("_a", "_b", "_nth")


def remaining_times(log: DataFrame) -> DataFrame:
    """Add ``remaining`` (ms to the case end) and ``elapsed`` (ms from its start)."""
    ms = epoch_ms("ts")
    timed = with_case_values(log, _t0=F.min_by(ms, "pos"), _t1=F.max_by(ms, "pos"))
    return timed.withColumns({"remaining": F.col("_t1") - ms, "elapsed": ms - F.col("_t0")}).drop("_t0", "_t1")


def remaining_naive(mean: Column, elapsed: Column) -> Column:
    """max(mean case duration - elapsed, 0)."""
    return F.greatest(mean - elapsed, F.lit(0.0))


def state_model(train: DataFrame, state: str) -> DataFrame:
    """``state, n, mean_remaining`` (ms) over the training prefixes."""
    return with_prefix_state(remaining_times(train), state).groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), F.avg("remaining").alias("mean_remaining"))


def remaining_by_state(train: DataFrame, test: DataFrame, state: str) -> DataFrame:
    """Test events with ``predicted``: the mean remaining time of training
    prefixes in the same state, or the naive rule for unseen states."""
    model = stored(state_model(train, state))
    mean = case_durations(train).agg(F.avg("duration")).scalar()
    events = with_prefix_state(remaining_times(test), state)
    joined = split_join(events, model, ["state"], "n", "left")
    return joined.withColumn("predicted", F.coalesce("mean_remaining", remaining_naive(mean, F.col("elapsed")))
                             ).drop("mean_remaining", "n")


def conditional_duration(train: DataFrame, probes: DataFrame, keys: list[str], duration: str = "duration",
                         elapsed: str = "elapsed") -> DataFrame:
    """Mean of the training durations not below the elapsed time; the elapsed
    time itself where none is left: ``keys, elapsed, n_left, expected``."""
    sums = conditional_sums(train, probes, keys, duration, elapsed)
    left = F.coalesce("n_left", F.lit(0))
    return sums.select(*keys, elapsed, left.alias("n_left"), F.when(
        left > 0, F.col("s_left") / F.greatest(left, F.lit(1))).otherwise(F.col(elapsed)).alias("expected"))


TAIL = 1e-6  # mass of a tail whose mean is still told from the distribution function


def conditional_expectation(dist_type: Column, params: Column, elapsed: Column, special: bool = False) -> Column:
    """Expected duration given it exceeds the elapsed time: exponential durations
    forget, uniform ones start at the elapsed time, normal, log-normal, gamma and
    beta ones have the mean of their tail.  The elapsed time itself where nothing is left
    of the tail; histogram and kernel fits go through ``conditional_table``, and
    gamma and beta fits need ``special``, since their expressions are long."""
    a, b = (F.try_element_at(params, F.lit(i)) for i in (1, 2))
    uniform = F.when(elapsed < b, (F.greatest(a, elapsed) + b) / 2).otherwise(elapsed)
    point = F.greatest(a, elapsed)
    z = (elapsed - a) / b
    left = F.lit(1.0) - normal_cdf(z)
    normal = F.when(left > TAIL, a + b * normal_pdf(z, F.lit(0.0), F.lit(1.0)) / left).otherwise(elapsed)
    y = (F.ln(F.greatest(elapsed, F.lit(1e-300))) - a) / b
    rest = F.lit(1.0) - normal_cdf(y)
    mean = F.exp(a + b * b / 2)
    lognormal = F.when(elapsed <= 0, mean).when(rest > TAIL, mean * normal_cdf(b - y) / rest).otherwise(elapsed)
    plain = (F.when(dist_type == "EXPONENTIAL", a + elapsed).when(dist_type == "UNIFORM", uniform)
             .when(dist_type == "NORMAL", normal).when(dist_type == "LOGNORMAL", lognormal)
             .when(dist_type == "DETERMINISTIC", point).when(dist_type == "IMMEDIATE", elapsed))
    if not special:
        return plain

    def of_tail(whole: Column, more: Column, less: Column) -> Column:
        return F.when(elapsed <= 0, whole).when(less < 1 - TAIL, whole * (F.lit(1.0) - more) / (F.lit(1.0) - less)).otherwise(elapsed)

    gamma = of_tail(a * b, gamma_cdf(a + 1, elapsed / b), gamma_cdf(a, elapsed / b))
    beta = of_tail(a / (a + b), beta_cdf(a + 1, b, elapsed), beta_cdf(a, b, elapsed))
    return plain.when(dist_type == "GAMMA", gamma).when(dist_type == "BETA", beta)


def conditional_table(parts: DataFrame, probes: DataFrame, keys: list[str], elapsed: str = "elapsed") -> DataFrame:
    """The same for tables of bins or kernel slots (``keys, value, weight``): the
    mean of the parts not below the elapsed time, which a part stands for as a
    whole: ``keys, elapsed, expected``."""
    v, k = F.col("value"), F.col("weight")
    asked = probes.select(*keys, F.col(elapsed).cast("double").alias(elapsed)).distinct()
    packed = stored(parts.groupBy(*keys).agg(F.collect_list(F.struct(v.cast("double").alias("value"), k.cast(
        "double").alias("weight"))).alias("_parts")))  # one row per fit, as many parts as its grid
    met = join_model(asked, packed, keys, "left")
    left = F.filter("_parts", lambda p: p["value"] >= F.col(elapsed))
    mass = F.aggregate(left, F.lit(0.0), lambda n, p: n + p["weight"])
    total = F.aggregate(left, F.lit(0.0), lambda n, p: n + p["weight"] * p["value"])
    return met.withColumns({"_mass": F.coalesce(mass, F.lit(0.0)), "_sum": total}).select(
        *keys, elapsed, F.when(F.col("_mass") > 0, F.col("_sum") / F.col("_mass")).otherwise(F.col(elapsed)).alias(
            "expected"))


def deadline_risk(train: DataFrame, probes: DataFrame, state: str, budget: str) -> DataFrame:
    """Probability to miss a deadline ``budget`` ms away: 1 - (rank + 0.5)/(n + 1)
    of the budget among the remaining times seen in the same state."""
    seen = with_prefix_state(remaining_times(train), state).select("state", F.col("remaining").cast("double").alias("r"))
    asked = probes.select("state", F.col(budget).cast("double").alias(budget)).distinct()
    ranked = sample_rank(value_ranks(seen, ["state"], "r"), asked, ["state"], "r", budget)
    return ranked.select("state", budget, "total",
                         (F.lit(1.0) - (F.col("rank") + 0.5) / (F.col("total") + 1)).alias("risk"))


def monitoring_points(log: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Probe times start + i * (2 * mean duration / n), i < n, of every case with
    at least two events while it is running: ``case_id, i, at_ms, elapsed,
    remaining`` (ms)."""
    keys = keys or []
    ms = epoch_ms("ts")
    cases = log.groupBy(*keys, "case_id").agg(F.min_by(ms, "pos").alias("_t0"), F.max_by(ms, "pos").alias("_t1"),
                                              F.max("pos").alias("_n"))
    return _points(cases, n, keys)


def _points(cases: DataFrame, n: int, keys: list[str], *more: str) -> DataFrame:
    """``monitoring_points`` of a table of cases with ``_t0, _t1, _n``, and ``more`` of its columns."""
    spread = cases.withColumn("_d", F.col("_t1") - F.col("_t0"))
    if keys:
        spread = spread.join(spread.groupBy(*keys).agg(F.avg("_d").alias("_mean")), keys)
    else:
        spread = spread.withColumn("_mean", spread.agg(F.avg("_d")).scalar())
    period = F.floor(F.col("_mean") * 2 / n).cast("bigint")
    grid = spread.where("_n >= 2").select(*keys, "case_id", *more, "_t0", "_t1", period.alias("_p"),
                                          F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    at = F.col("_t0") + F.col("i") * F.col("_p")
    return grid.where(F.col("_t1") - at >= 0).select(
        *keys, "case_id", "i", at.alias("at_ms"), (at - F.col("_t0")).alias("elapsed"), (F.col("_t1") - at).alias("remaining"),
        *more)


def compare_predictors(log: DataFrame, k: int, n: int, study: str | None = None) -> DataFrame:
    """k-fold comparison of naive, state and conditional remaining-time
    predictions on the monitoring grid: errors per method in hours.

    Folds are a column.  What a fold learns from the others is the total minus
    its own part, so all folds run in one pass.  With a ``study`` column every
    study is evaluated on its own.
    """
    keys = [study] if study else []
    base = ["case_id", "pos", "activity", "ts", *keys]
    log, ms = reusable(log.select(*base)), epoch_ms("ts")
    # one row per case, with all that is asked of its ends
    ends = number_cases(log.groupBy("case_id", *keys).agg(
        F.min_by("ts", "pos").alias("start"), F.max("pos").alias("n_events"), F.min_by(ms, "pos").alias("_t0"),
        F.max_by(ms, "pos").alias("_t1")))
    cases = stored(ends.withColumn("fold", ((F.col("case_index") - 1) % k).cast("int")).drop("start", "case_index"))
    folded = stored(attach_cases(log, cases.drop(*keys), "n_events").select(
        *base, "fold", (F.col("_t1") - ms).alias("remaining")))
    probes = stored(_points(cases.withColumnRenamed("n_events", "_n"), n, keys, "fold"))

    durations = cases.select(*keys, "fold", (F.col("_t1") - F.col("_t0")).alias("duration"))
    fold_sums = durations.groupBy(*keys, "fold").agg(F.sum("duration").alias("_fs"), F.count(F.lit(1)).alias("_fn"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # k rows per study
    sums = fold_sums.withColumns({"_s": F.sum("_fs").over(whole), "_n": F.sum("_fn").over(whole)})
    means = sums.select(*keys, "fold", F.try_divide(F.col("_s") - F.col("_fs"), F.col("_n") - F.col("_fn")).alias("mean"))

    # state of a case at a probe: the last activity up to then
    asked = probes.select("case_id", F.timestamp_millis("at_ms").alias("ts"), "i", "fold", "elapsed", "remaining", *keys)
    at_state = last_observation(folded.select("case_id", F.timestamp_millis(epoch_ms("ts")).alias("ts"), "activity", "pos"),
                                asked, ["case_id"], "activity", ["pos"], inclusive=True)
    at_state = at_state.withColumnRenamed("observed", "state")

    seen = folded.groupBy(*keys, F.col("activity").alias("state"), "fold").agg(
        F.sum("remaining").alias("_fs"), F.count(F.lit(1)).alias("_fn"))
    whole = seen.groupBy(*keys, "state").agg(F.sum("_fs").alias("_s"), F.sum("_fn").alias("_n"))
    grid = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    model = grid.join(seen, [*keys, "state", "fold"], "left").select(
        *keys, "state", "fold", F.try_divide(F.col("_s") - F.coalesce("_fs", F.lit(0)),
                                             F.col("_n") - F.coalesce("_fn", F.lit(0))).alias("mean_remaining"))
    small = [*keys, "fold"]
    scored = join_model(join_model(at_state, stored(means), small), stored(model), [*small, "state"], "left")

    # conditional mean: all durations not below the elapsed time minus those of the fold
    asked_elapsed = probes.select(*keys, "fold", F.col("elapsed").cast("double").alias("elapsed"))
    own = conditional_sums(durations, asked_elapsed, [*keys, "fold"])
    total = conditional_sums(durations, asked_elapsed.drop("fold"), keys)
    both = own.select(*small, "elapsed", F.col("n_left").alias("_fn"), F.col("s_left").alias("_fs")).join(
        total, [*keys, "elapsed"])
    left = F.col("n_left") - F.col("_fn")
    expected = both.select(*small, "elapsed", F.when(left > 0, (F.col("s_left") - F.col("_fs")) / F.greatest(
        left, F.lit(1))).otherwise(F.col("elapsed")).alias("expected"))
    weights = asked_elapsed.groupBy(*small, "elapsed").agg(F.count(F.lit(1)).alias("_w"))
    scored = scored.withColumn("elapsed", F.col("elapsed").cast("double"))
    scored = split_join(scored, expected.join(weights, [*small, "elapsed"]), [*small, "elapsed"], "_w")

    naive = remaining_naive(F.col("mean"), F.col("elapsed"))
    predictions = scored.select(*keys, "remaining", F.explode(F.array(
        F.struct(F.lit("naive").alias("method"), naive.alias("predicted")),
        F.struct(F.lit("state").alias("method"), F.coalesce("mean_remaining", naive).alias("predicted")),
        F.struct(F.lit("conditional").alias("method"), (F.col("expected") - F.col("elapsed")).alias("predicted")))).alias("p")
    ).select(*keys, "p.method", "p.predicted", "remaining")
    return forecast_eval(predictions, [*keys, "method"], "predicted", "remaining", "hours")


def conditional_sums(train: DataFrame, probes: DataFrame, keys: list[str], duration: str = "duration",
                     elapsed: str = "elapsed") -> DataFrame:
    """Number and sum of the durations not below each elapsed time."""
    ranks = value_ranks(train, keys, duration, {"s": F.col(duration).cast("double")})
    below = lookup_ranks(ranks, probes, keys, duration, elapsed, ["upto", "upto_s"], strict=True)
    return below.select(*keys, elapsed, (F.col("total") - F.coalesce("upto", F.lit(0))).alias("n_left"),
                        (F.col("total_s") - F.coalesce("upto_s", F.lit(0.0))).alias("s_left"))


def subset_study(log: DataFrame, mandatory: list[str], optional: list[str], size: int, folds: int, points: int) -> DataFrame:
    """Prediction errors when only the mandatory activities and ``size`` of the
    optional ones are observed, for every such choice: errors per subset and
    method.  Each event is copied to the subsets that contain it; folds follow
    the order of the projected cases."""
    subsets = [tuple(sorted([*mandatory, *c])) for c in combinations(sorted(optional), size)]
    holding = {a: [",".join(s) for s in subsets if a in s] for s in subsets for a in s}
    tagged = reduce(lambda col, a: col.when(F.col("activity") == a, F.array(*[F.lit(s) for s in holding[a]])),
                    sorted(holding), F.when(F.lit(False), F.array(F.lit("")))) if holding else None
    if tagged is None:
        raise ValueError("no subsets to study")
    log = reusable(log.select("case_id", "pos", "activity", "ts"))
    dealt = log.repartition(max(1, -(-log.count() // MEETING_ROWS)), "case_id")  # copies are made where their case is numbered
    copies = dealt.withColumnRenamed("pos", "_was").withColumn("subset", F.explode(tagged))
    dense = positions(copies, ["case_id", "subset"], ["_was"], "pos", log.select("case_id", F.lit("").alias("subset")))
    named = dense.withColumn("case_id", F.concat_ws("#", "subset", "case_id"))
    return compare_predictors(stored(named.select("case_id", "pos", "activity", "ts", "subset")), folds, points, "subset")
