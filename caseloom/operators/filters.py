"""Renaming, filtering, ordering, splitting and perturbing event logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import names
from caseloom.functions.maths import epoch_ms
from caseloom.plans.fingerprint import element_hashes, uniform
from caseloom.plans.models import join_model, stored
from caseloom.plans.slices import (attach_cases, positions, running_dense, running_in_case, slice_of, sweep,
                                   with_case_values)

# ---------------------------------------------------------------- renaming

def rename(log: DataFrame, fn: Callable[[Column, Column], Column]) -> DataFrame:
    """Rename activities with a function of (name, lifecycle)."""
    lifecycle = F.col("lifecycle") if "lifecycle" in log.columns else F.lit(None).cast("string")
    return log.withColumn("activity", fn(F.col("activity"), lifecycle))


def flatten_lifecycle(log: DataFrame) -> DataFrame:
    return rename(log, names.with_lifecycle)


def escape_underscores(log: DataFrame) -> DataFrame:
    return rename(log, lambda name, _: names.escape_underscores(name))


def unescape_underscores(log: DataFrame) -> DataFrame:
    return rename(log, lambda name, _: names.unescape_underscores(name))


def hash_underscores(log: DataFrame) -> DataFrame:
    return rename(log, lambda name, _: names.hash_underscores(name))


def base_activity(log: DataFrame) -> DataFrame:
    return rename(log, lambda name, _: names.base_name(name))


def unroll_loops(log: DataFrame) -> DataFrame:
    """The 2nd, 3rd ... occurrence of a name in a case becomes ``name_2``, ``name_3`` ..."""
    seen = running_in_case(log, ["activity"], {"_seen": ("sum", F.lit(1))})
    return seen.withColumn("activity", F.when(
        F.col("_seen") > 1, F.concat("activity", F.lit("_"), F.col("_seen").cast("string"))
    ).otherwise(F.col("activity"))).select(*log.columns)


def chained_classes(log: DataFrame) -> DataFrame:
    """Numbered classes ``base_k`` whose whole chain exists: (activity, base).

    k >= 2 needs base_(k-1) ... base_2 and one of base_0/base_2 next to base_1;
    k in {0, 1} needs a neighbour; k < 0 never qualifies.
    """
    classes = log.select("activity").distinct()
    pattern = r"^(.*)_([+-]?[0-9]{1,9})$"
    numbered = classes.select(
        "activity", F.regexp_extract("activity", pattern, 1).alias("base"),
        F.regexp_extract("activity", pattern, 2).alias("_k")
    ).where(F.col("_k") != "").withColumn("k", F.col("_k").cast("int"))
    # only canonical spellings (no sign, no leading zero) act as chain links
    links = (numbered.where(F.col("_k") == F.col("k").cast("string"))
             .select("base", F.col("k").cast("bigint").alias("link")))
    near = links.where(F.col("link").between(-1, 2)).groupBy("base").agg(
        *[F.max(F.col("link") == n).alias(f"_has{i}") for i, n in enumerate([-1, 0, 1, 2])])
    # a run 1..link is complete exactly when link is its own rank
    runs = positions(links.where(F.col("link") >= 1), ["base"], ["link"], "_rank")
    runs = runs.select("base", (F.col("link") + 1).alias("k"), (F.col("_rank") == F.col("link")).alias("_run"))
    beside_one = F.col("_has1") | F.col("_has3")
    return (numbered.withColumn("k", F.col("k").cast("bigint")).join(near, "base", "left")
            .join(runs, ["base", "k"], "left")
            .where(F.when(F.col("k") >= 2, F.col("_run") & beside_one)
                   .when(F.col("k") == 1, beside_one)
                   .when(F.col("k") == 0, F.col("_has0") | F.col("_has2"))
                   .otherwise(F.lit(False)))
            .select("activity", "base"))


def reduplicate(log: DataFrame) -> DataFrame:
    """Undo numbering: rename ``base_k`` to ``base`` where the chain exists."""
    renames = stored(chained_classes(log))
    return (join_model(log, renames, ["activity"], "left")
            .withColumn("activity", F.coalesce("base", "activity")).select(*log.columns))


# ---------------------------------------------------------------- ordering

def reorder_by_time(log: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Renumber each case by (timestamp, recorded position).  ``counted`` as in ``sweep``."""
    kept = log.withColumnRenamed("pos", "_was")
    return positions(kept, ["case_id"], ["ts", "_was"], "pos", counted).select(*log.columns)


def sort_cases(log: DataFrame) -> DataFrame:
    """One row per case with its start, number of events and 1-based place in
    start-time order (ties by case id): ``case_id, start, n_events, case_index``."""
    return number_cases(log.groupBy("case_id").agg(F.min_by("ts", "pos").alias("start"),
                                                   F.max("pos").alias("n_events")))


def number_cases(cases: DataFrame) -> DataFrame:
    """Add ``case_index`` to a table with one row per case and its ``start``."""
    return sweep(cases, [], ["start", "case_id"], {"case_index": ("sum", F.lit(1))})


def filter_classes(log: DataFrame, classes: list[str]) -> DataFrame:
    """Events of the listed activities, renumbered from 1 without gaps."""
    kept = log.where(F.col("activity").isin(classes)).withColumnRenamed("pos", "_was")
    return positions(kept, ["case_id"], ["_was"], "pos").select(*log.columns)


def kfold(log: DataFrame, k: int, fold: int, in_fold: bool = True) -> DataFrame:
    """Events of the cases whose 0-based index modulo ``k`` is (not) ``fold``."""
    hit = (F.col("case_index") - 1) % k == fold
    cases = sort_cases(log).where(hit if in_fold else ~hit).select("case_id", "n_events")
    return attach_cases(log, cases, "n_events").select(*log.columns)


def ratio_split(log: DataFrame, ratio: float) -> DataFrame:
    """Add ``part``: 1 for cases with index/number of cases <= ratio, else 2."""
    cases = sort_cases(log)
    total = log.select("case_id").distinct().agg(F.count(F.lit(1))).scalar()
    cases = cases.select("case_id", "n_events", F.when(
        (F.col("case_index") - 1) / total <= ratio, 1).otherwise(2).alias("part"))
    return attach_cases(log, cases, "n_events").select(*log.columns, "part")


def prefix_until(log: DataFrame, until: Column | str) -> DataFrame:
    """Events before the first one later than ``until`` (a constant or a
    per-event column); cases starting later disappear."""
    limit = F.col(until) if isinstance(until, str) else until
    late = running_dense(log, ["case_id"], "pos", {"_late": ("max", (F.col("ts") > limit).cast("int"))})
    return late.where(F.col("_late") == 0).drop("_late")


def starting_after(log: DataFrame, until: Column) -> DataFrame:
    """Number of cases ``prefix_until`` drops because they start too late."""
    return log.where((F.col("pos") == 1) & (F.col("ts") > until)).agg(
        F.count(F.lit(1)).alias("dropped_cases"))


def training_up_to(training: DataFrame, until: Column) -> DataFrame:
    """Training rows strictly before a point in time."""
    return training.where(F.col("ts") < until)


# ---------------------------------------------------------------- classes and variants

def event_classes(log: DataFrame) -> DataFrame:
    return log.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


def classes_by_count(log: DataFrame) -> DataFrame:
    """Classes grouped by their number of events (the arrays hold class names only)."""
    return event_classes(log).groupBy("n").agg(F.sort_array(F.collect_set("activity")).alias("classes"))


def case_sequences(log: DataFrame) -> DataFrame:
    """One row per case with the fingerprint of its activity sequence (and its
    ``start``, where the log has timestamps)."""
    a, b = element_hashes("pos", "activity")
    start = [F.min_by("ts", "pos").alias("start")] if "ts" in log.columns else []
    return log.groupBy("case_id").agg(F.max("pos").alias("n_events"), F.bit_xor(a).alias("seq_a"),
                                      F.bit_xor(b).alias("seq_b"), *start)


SEQUENCE = ["n_events", "seq_a", "seq_b"]


def variants(log: DataFrame) -> DataFrame:
    """Distinct activity sequences: fingerprint columns, ``n_cases`` and one
    representative ``case_id``."""
    return case_sequences(log).groupBy(*SEQUENCE).agg(
        F.count(F.lit(1)).alias("n_cases"), F.min("case_id").alias("case_id"))


def variant_texts(log: DataFrame) -> DataFrame:
    """Variants as text: ``n_cases, n_events, chunk, text`` (see ``trace_text``)."""
    found = variants(log)
    events = attach_cases(log, found.select("case_id", "n_events", "n_cases"), "n_events")
    return trace_text(events, extra=["n_cases", "n_events"]).drop("case_id")


def most_frequent_variant(log: DataFrame, all_cases: bool = False) -> DataFrame:
    """The most frequent sequence: the trace that brings it to its full count,
    or all its cases.  Between equally frequent ones the first to get there wins."""
    cases = case_sequences(log)
    top = (cases.groupBy(*SEQUENCE).agg(F.count(F.lit(1)).alias("_n"),
                                        F.max(F.struct("start", "case_id")).alias("_reached"))
           .orderBy(F.desc("_n"), "_reached").limit(1))
    if all_cases:
        keep = cases.join(F.broadcast(top.select(*SEQUENCE)), SEQUENCE).select("case_id", "n_events")
    else:
        keep = top.select(F.col("_reached.case_id").alias("case_id"), "n_events")
    return attach_cases(log, keep, "n_events").select(*log.columns)


TEXT_CHUNK = 10_000


def trace_text(log: DataFrame, bare: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Events of a case joined by ``, ``; one row per case and chunk of
    ``TEXT_CHUNK`` events, so no single array grows with the case.

    The long form adds ``+lifecycle by resource in location(time)``.
    """
    word = F.col("activity")
    if not bare:
        have = set(log.columns)
        if "lifecycle" in have:
            word = F.concat(word, F.coalesce(F.concat(F.lit("+"), "lifecycle"), F.lit("")))
        if "resource" in have:
            word = F.concat(word, F.coalesce(F.concat(F.lit(" by "), "resource"), F.lit("")))
        if "location" in have:
            word = F.concat(word, F.coalesce(F.concat(F.lit(" in "), "location"), F.lit("")))
        when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
        word = F.concat(word, F.coalesce(F.concat(F.lit("("), when, F.lit(")")), F.lit("")))
    chunk = F.expr(f"(pos - 1) div {TEXT_CHUNK}")
    listed = F.array_sort(F.collect_list(F.struct("pos", word.alias("word"))))
    return (log.groupBy("case_id", *(extra or []), chunk.alias("chunk"))
            .agg(F.array_join(F.transform(listed, lambda e: e["word"]), ", ").alias("text")))


def check_boundaries(log: DataFrame) -> DataFrame:
    """Cases whose first or last activity differs from those of the first case."""
    cases = log.groupBy("case_id").agg(
        F.min_by("ts", "pos").alias("_start"), F.min_by("activity", "pos").alias("first_activity"),
        F.max_by("activity", "pos").alias("last_activity"))
    expected = cases.agg(F.min_by(F.struct("first_activity", "last_activity"),
                                  F.struct("_start", "case_id")).alias("e"))
    first = expected.select(F.col("e.first_activity")).scalar()
    last = expected.select(F.col("e.last_activity")).scalar()
    return cases.where((F.col("first_activity") != first) | (F.col("last_activity") != last)).drop("_start")


# ---------------------------------------------------------------- noise

BUFFER_MS = 10


def add_noise(log: DataFrame, add: float, remove: float, seed: int) -> DataFrame:
    """Remove each event with chance ``remove`` and duplicate it with chance
    ``add``; a duplicate gets a random time in the buffered bounds of the case.
    A case never becomes empty.  All chances depend on (case, pos, seed) only."""
    drawn = (log.withColumn("_keep", uniform(seed, "keep", "case_id", "pos") >= remove)
             .withColumn("_spare", uniform(seed, "spare", "case_id", "pos")))
    marked = with_case_values(
        drawn, _any=F.max("_keep"), _pick=F.min_by("pos", F.struct("_spare", "pos")),
        _lo=F.min(epoch_ms("ts")) - BUFFER_MS, _hi=F.max(epoch_ms("ts")) + BUFFER_MS)
    twice = uniform(seed, "twice", "case_id", "pos") < add
    keep = F.col("_keep") | (~F.col("_any") & (F.col("pos") == F.col("_pick")))
    at = F.col("_lo") + F.floor(uniform(seed, "at", "case_id", "pos") * (F.col("_hi") - F.col("_lo")))
    copies = F.array_compact(F.array(
        F.when(keep, F.struct(F.lit(0).alias("copy"), F.col("ts").alias("ts"))),
        F.when(twice, F.struct(F.lit(1).alias("copy"), F.timestamp_millis(at).alias("ts")))))
    rows = (marked.withColumn("_c", F.explode(copies)).withColumn("ts", F.col("_c.ts"))
            .withColumn("_copy", F.col("_c.copy")).withColumnRenamed("pos", "_was"))
    return positions(rows, ["case_id"], ["ts", "_copy", "_was"], "pos").select(*log.columns)


def accurate_noise(log: DataFrame, noise: float, deletion_ratio: float, seed: int) -> DataFrame:
    """Affect an exact expected share of the events of every case: part of them
    is deleted, the others each cause one inserted event with a random class of
    the log at case start + U * mean case duration.  At least one event stays."""
    durations = log.groupBy("case_id").agg(
        (F.max_by(epoch_ms("ts"), "pos") - F.min_by(epoch_ms("ts"), "pos")).alias("d"))
    mean_duration = durations.agg(F.avg("d")).scalar()

    def rounded(share: Column, salt: str) -> Column:
        whole = F.floor(share)
        return whole + F.when(uniform(seed, salt, "case_id") < share - whole, 1).otherwise(0)

    cases = log.groupBy("case_id").agg(
        F.max("pos").alias("n_events"), F.min_by(epoch_ms("ts"), "pos").alias("_start"))
    cases = cases.withColumn("_affected", rounded(F.col("n_events") * F.lit(noise), "affected"))
    cases = cases.withColumn("_deleted", rounded(F.col("_affected") * F.lit(deletion_ratio), "deleted"))
    shuffled = positions(log.withColumn("_draw", uniform(seed, "draw", "case_id", "pos")),
                         ["case_id"], ["_draw", "pos"], "_rank")
    marked = attach_cases(shuffled, cases, "n_events")
    deleted = F.col("_rank") <= F.col("_deleted")
    # deleting everything puts the last deleted event back
    spared = (F.col("_deleted") >= F.col("n_events")) & (F.col("_rank") == F.col("n_events"))
    inserted = ~deleted & (F.col("_rank") <= F.col("_affected"))
    at = F.col("_start") + F.floor(uniform(seed, "at", "case_id", "pos") * mean_duration)
    copies = F.array_compact(F.array(
        F.when(~deleted | spared, F.struct(F.lit(0).alias("copy"), F.col("ts").alias("ts"))),
        F.when(inserted, F.struct(F.lit(1).alias("copy"),
                                  F.timestamp_millis(at.cast("bigint")).alias("ts")))))
    rows = (marked.withColumn("_c", F.explode(copies)).withColumn("ts", F.col("_c.ts"))
            .withColumn("_copy", F.col("_c.copy")).withColumnRenamed("pos", "_was"))
    classes = log.select("activity").distinct()
    numbered = sweep(classes, [], ["activity"], {"_class": ("sum", F.lit(1))}).select(
        "_class", F.col("activity").alias("_name"))
    n_classes = log.agg(F.countDistinct("activity")).scalar()
    rows = rows.withColumn("_class", F.when(F.col("_copy") == 1, 1 + F.floor(
        uniform(seed, "class", "case_id", "_was") * n_classes)))
    # only inserted rows have a class; the others do not meet on the missing one
    new = join_model(rows.where("_copy = 1"), stored(numbered), ["_class"], "left").withColumn(
        "activity", F.coalesce("_name", "activity")).drop("_name")
    rows = rows.where("_copy = 0").unionByName(new.select(*rows.columns))
    return positions(rows, ["case_id"], ["ts", "_copy", "_was"], "pos").select(*log.columns)
