"""Hard negatives by inner product, with length buckets and pruning by coordinates.

Vectors have integer components. For every anchor two searches are made: its best ``positives`` other rows of the same
label, and for each of them the best ``negatives`` rows of another label whose score is at least a stated share of the
positive's score and at most that score.

*Buckets.* Rows are put into buckets by their length (borders from a mergeable quantile sketch over all rows), and a bucket
into blocks of about ``BLOCK`` rows by hash. Against a bucket whose greatest length is l, an anchor of length a needs a
cosine of at least t = threshold / (a * l): where t is above 1 the bucket is passed by, before anything is sent there.
A block holds its directions sorted by every coordinate. If the anchor's direction has value cos(p) at a coordinate, rows
with a cosine of at least t = cos(w) have values between cos(p + w) and cos(p - w) there. The anchor's ``FOCUS``
coordinates of largest magnitude give such ranges; the rows of the shortest one that lie in all the others as well are the
candidates, and these are verified exactly, in integers. Where the ranges leave more than ``DENSE`` of the rows the whole
block is verified in one product instead.

*Thresholds.* The search goes over nested hash samples of the rows, ``STEPS``, the last one all of them: what an anchor has
found so far is a lower bound for its next search, so the whole table meets sharp thresholds. Samples settle no result.

Only anchors whose blocks they meet are sent to a block, and in a task there is one block and some hundred anchors. An
anchor returns no more than its best few rows from a block, so one label or length that a third of all rows have is no
burden.

Defined cases: rows with a missing label, vector or identifier, or with missing or non-finite components, take no part;
vectors of different lengths never meet; rows that repeat are rows of their own (an anchor is never its own positive, ties
go to the smaller identifier); an anchor without positives, or a positive without negatives, gives no rows; an empty table
gives no rows. Scores beyond 64 bits are an error. Columns other than these three are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.blocks import against_blocks, as_bytes, dealt, finite, matrix
from caseloom.llm.common import with_row_ids
from caseloom.plans.lineage import stored

POSITIVES = NEGATIVES = 5
SHARE = (80, 100)       # of the positive's score, in hundredths: a negative's least and greatest score
BUCKETS = 16
BLOCK = 4096
FOCUS = 5
DENSE = 0.3
STEPS = (64, 8, 1)      # one row in so many
SLACK = 1e-9
FOUND = "anchor bigint, goal int, id bigint, row bigint, score bigint"


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers held as doubles, exact in 64 bits."""
    most = (float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) or 1.0) * max(x.shape[1], 1)
    if most < 2.0 ** 53:  # every partial sum is exact
        return (x @ y.T).astype(np.int64)
    if most < 2.0 ** 63:
        return x.astype(np.int64) @ y.astype(np.int64).T
    whole = np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape) @ np.array(
        [[int(v) for v in r] for r in y], dtype=object).reshape(y.shape).T
    return np.array(whole.tolist(), dtype=np.int64).reshape(len(x), len(y))


class Block:
    """The rows of a block with their directions in the order of every coordinate."""

    def __init__(self, table: pa.Table):
        self.ids, self.rows, self.labels = (table.column(c).to_numpy() for c in ("id", "row", "label"))
        self.x = matrix(table.column("vec"))
        size = np.sqrt((self.x * self.x).sum(axis=1))
        self.longest = float(size.max())
        self.way = self.x / np.where(size > 0, size, 1.0)[:, None]
        self.order = np.argsort(self.way, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.way, self.order, axis=0)

    def candidates(self, x: np.ndarray, least: float) -> np.ndarray | None:
        """Rows that may have a score of ``least`` or more with an anchor; None stands for all."""
        size = float(np.sqrt(x @ x))
        if least <= 0 or not size or not self.longest:
            return None if least <= 0 else np.empty(0, np.int64)
        cosine = least / size / self.longest
        if cosine > 1 + SLACK:
            return np.empty(0, np.int64)
        way, width = x / size, np.arccos(min(cosine, 1.0))
        focus = np.argsort(-np.abs(way), kind="stable")[:FOCUS]
        turn = np.arccos(np.clip(way[focus], -1.0, 1.0))
        low = np.cos(np.minimum(turn + width, np.pi)) - SLACK
        high = np.cos(np.maximum(turn - width, 0.0)) + SLACK
        cuts = [(np.searchsorted(self.sorted[:, f], a, "left"), np.searchsorted(self.sorted[:, f], b, "right"))
                for f, a, b in zip(focus, low, high)]
        best = int(np.argmin([b - a for a, b in cuts]))
        a, b = cuts[best]
        if b - a > DENSE * len(self.ids):
            return None
        rows = self.order[a:b, focus[best]]
        inside = ((self.way[rows][:, focus] >= low) & (self.way[rows][:, focus] <= high)).all(axis=1)
        return rows[inside]

    def scores(self, x: np.ndarray, least: np.ndarray):
        """Place of the anchor, row, score of all that may reach the anchors' thresholds."""
        every, parts = [], []
        for i in range(len(x)):
            rows = self.candidates(x[i], float(least[i]))
            if rows is None:
                every.append(i)
            elif len(rows):
                parts.append((np.full(len(rows), i), rows, products(x[i:i + 1], self.x[rows])[0]))
        if every:
            every = np.array(every)
            score = products(x[every], self.x)
            i, j = np.nonzero(score >= least[every][:, None])
            parts.append((every[i], j, score[i, j]))
        return tuple(np.concatenate(c) for c in zip(*parts)) if parts else None


def first_rows(anchor, goal, score, ids, rows, k: int) -> np.ndarray:
    """Places of the ``k`` best of every anchor and goal."""
    order = np.lexsort((rows, ids, -score, goal, anchor))
    new = np.r_[True, (np.diff(anchor[order]) != 0) | (np.diff(goal[order]) != 0)]
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


def searched(rows: DataFrame, goals: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of every anchor and goal. ``goals`` has one row per anchor and length: ``anchor, id, label, dim,
    size, vec, low, high``, where the arrays hold every goal's least and greatest score; rows of the anchor's label
    (``same``) or of others."""
    # per length of vectors, its few buckets
    lists = rows.groupBy("dim", "bucket").agg(F.max("size").alias("longest"), (F.max("slice") + 1).alias("slices"))
    lists = lists.groupBy("dim").agg(F.collect_list(F.struct("bucket", "longest", "slices")).alias("buckets"))
    at = F.xxhash64("dim", "bucket", "slice")
    least = F.array_min("low")
    asked = goals.join(lists, "dim").withColumn("b", F.explode("buckets")).where(
        (least <= 0) | (least <= F.col("size") * F.col("b.longest") * (1 + SLACK))).select(
        "*", F.col("b.bucket").alias("bucket"), F.explode(F.expr("sequence(0L, b.slices - 1)")).alias("slice")).select(
        at.alias("at"), "anchor", "id", "label", "vec", "low", "high")
    held = rows.select(at.alias("at"), "id", "row", "label", "vec")

    def compare(batches):
        last, block = None, None
        for number, table, piece in dealt(batches):
            if number != last:
                last, block = number, Block(table)
            col = {c: piece.column(i) for i, c in enumerate(piece.schema.names)}
            low, high = (col[c].to_pylist() for c in ("low", "high"))
            x = matrix(col["vec"])
            found = block.scores(x, np.array([min(v) for v in low], dtype=np.float64))
            if found is None:
                continue
            i, j, score = found
            anchors, own, labels = (col[c].to_numpy(zero_copy_only=False) for c in ("anchor", "id", "label"))
            fit = (block.labels[j] == labels[i]) == same
            if same:
                fit &= block.rows[j] != anchors[i]
            i, j, score = i[fit], j[fit], score[fit]
            wide = max(map(len, low))
            lows = np.array([v + [1] * (wide - len(v)) for v in low], dtype=np.int64)
            highs = np.array([v + [0] * (wide - len(v)) for v in high], dtype=np.int64)
            parts = [(i[ok], np.full(int(ok.sum()), goal), j[ok], score[ok]) for goal in range(wide)
                     if (ok := (score >= lows[i, goal]) & (score <= highs[i, goal])).any()]
            if not parts:
                continue
            i, goal, j, score = (np.concatenate(c) for c in zip(*parts))
            keep = first_rows(i, goal, score, block.ids[j], block.rows[j], k)
            i, goal, j, score = i[keep], goal[keep], j[keep], score[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors[i]), pa.array(goal.astype(np.int32)), pa.array(block.ids[j]), pa.array(block.rows[j]),
                 pa.array(score)], ["anchor", "goal", "id", "row", "score"])

    found = against_blocks(held, asked).mapInArrow(compare, FOUND)
    order = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sharpened(rows: DataFrame, goals: DataFrame, same: bool, k: int) -> DataFrame:
    """``searched`` over all rows, with thresholds found in samples of them."""
    for step in STEPS:
        part = rows if step == 1 else rows.where(F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(step)) == 0)
        found = stored(searched(part, goals, same, k))
        if step > 1:
            full = found.where(F.col("rank") == k).groupBy("anchor").agg(
                F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("sharp"))
            raised = F.expr("transform(low, (x, goal) -> greatest(x, coalesce(sharp[goal], x)))")
            goals = stored(goals.join(full, "anchor", "left").withColumn("low", raised).drop("sharp"))
    return found


def with_buckets(rows: DataFrame) -> DataFrame:
    """Rows with ``bucket`` by length, the longest first, and ``slice``."""
    borders = rows.agg(F.percentile_approx("size", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("b")).first().b
    place = F.lit(0)
    for border in sorted(set(borders or [])):
        place = place + (F.col("size") <= border).cast("int")
    bucketed = stored(rows.withColumn("bucket", place))
    parts = bucketed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    return stored(bucketed.join(parts, ["dim", "bucket"]).withColumn(
        "slice", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts"))


def hard_negatives(df: DataFrame, anchors, positives: int = POSITIVES, negatives: int = NEGATIVES, share=SHARE,
                   key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` holds
    (a condition on ``id``). Components of ``vector`` are whole numbers."""
    good = df.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                     F.col(vector).cast("array<double>").alias("x"))
    good = with_row_ids(stored(good.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite("x"))), "row")
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda total, c: total + c * c))
    rows = with_buckets(as_bytes(good.select("row", "id", "label", F.size("x").alias("dim"), size.alias("size"), "x")))
    asked = stored(rows.where(anchors).select(F.col("row").alias("anchor"), "id", "label", "dim", "size", "vec"))
    lowest, highest = (F.lit(v).cast("bigint") for v in (-(1 << 63), (1 << 63) - 1))
    best = sharpened(rows, asked.withColumns({"low": F.array(lowest), "high": F.array(highest)}), True, positives)
    # 100 * s >= share * p means s >= ceil(share * p / 100); a negative p leaves no scores in between
    low, high = (F.expr(f"({v} - pmod({v}, 100)) div 100") for v in (f"({share[0]} * score + 99)", f"({share[1]} * score)"))
    bounds = stored(best.select(
        "anchor", (F.col("rank") - 1).alias("goal"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        low.alias("low"), high.alias("high")).withColumn(
        "low", F.when(F.col("low") <= F.col("high"), F.col("low")).otherwise(highest)))
    listed = bounds.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("goal", "low", "high"))).alias("g"))
    goals = stored(asked.join(listed, "anchor").withColumns({"low": F.col("g.low"), "high": F.col("g.high")}).drop("g"))
    found = sharpened(rows, goals, False, negatives)
    named = found.select("anchor", "goal", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asked.select("anchor", F.col("id").alias("anchor_id"))
    return named.join(bounds, ["anchor", "goal"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
