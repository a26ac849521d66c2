"""Nearest vectors by inner product, with vantage-point trees per shard.

The trees hold directions, with the angle as their metric, and every leaf the greatest length of its vectors. A vector of a
leaf can only beat the k-th best found so far if its angle to the query is at most that at which the leaf's greatest length
gives that score. The triangle inequality bounds the angle from below by the angles of the query and of the leaf's members
to the vantage points above the leaf: a leaf is passed by when that bound exceeds the angle times ``relax``. With 1 the
search is exact; below 1 less is visited and something may be missed (``recall`` measures how much).

*Shards.* A tree over a bounded sample (``SAMPLE`` vectors by hash order, whose vantage points travel to all tasks) deals
every vector to a shard by its direction; shards of more than ``SHARD`` rows are split by hash. Ranges of the angles to the
vantage points and the greatest length are taken from all rows. A query asks its own shard first, and then, with the score
found, those others that the same bound leaves. In a task there is one shard with its tree, and some hundred queries at a
time. Vectors of a length that the sample does not have form a shard of their own.

Of equal vectors only the first ``k + 1`` identifiers can be among the nearest, the others are left out by a window that
limits every partition before the shuffle; so a vector that a third of all rows repeat is no burden.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
identifier; vectors of different lengths never meet; rows that repeat count once; an empty table gives no rows; ties go to
the smaller identifier; a score that overflows is infinite. Columns other than identifier and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.blocks import against_blocks, as_bytes, dealt, exact_products, finite, matrix
from caseloom.plans.lineage import stored

K = 20
RELAX = 1.0
SAMPLE = 16_384
SHARD = 8192
LEAF = 256        # rows of a leaf in a shard's tree
LEAST = 32        # sample vectors of a shard
SLACK = 1e-6      # rounding of an angle
FOUND = "query_id bigint, q bigint, vec_id bigint, score double"


def polar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths."""
    top = np.abs(x).max(axis=1)
    y = x / top[:, None]
    size = np.sqrt((y * y).sum(axis=1))
    with np.errstate(over="ignore"):
        return y / size[:, None], np.minimum(size * top, np.finfo(np.float64).max)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class Tree:
    """A vantage-point tree over directions: the vantage points, for every inner node its point, radius and children
    (leaf ``i`` is ``-1 - i``), and for every leaf its members and the range of their angles to the points above."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.points, self.nodes, self.leaves, self.paths = [], [], [], []
        self.root = self._grow(x, np.arange(len(x)), [], leaf)
        self.points = np.array(self.points).reshape(len(self.points), x.shape[1])

    def _grow(self, x: np.ndarray, rows: np.ndarray, path: list[tuple], leaf: int) -> int:
        if len(rows) > leaf:
            # the row furthest from the first one sees the others from outside
            point = x[rows[int(np.argmin(x[rows] @ x[rows[0]]))]]
            away = angles(x[rows], point[None])[:, 0]
            radius = float(np.median(away))
            inner = away <= radius
            if inner.all():
                inner = away < radius
            if inner.any() and not inner.all():
                number, node = len(self.points), len(self.nodes)
                self.points.append(point)
                self.nodes.append(None)
                sides = [self._grow(x, rows[side], [*path, (number, away[side].min(), away[side].max())], leaf)
                         for side in (inner, ~inner)]
                self.nodes[node] = (number, float(away[inner].max()), *sides)
                return node
        self.leaves.append(rows)
        self.paths.append(path)
        return -len(self.leaves)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf each direction belongs to."""
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[inner]):
                here = inner[at[inner] == node]
                point, radius, near, far = self.nodes[node]
                at[here] = np.where(angles(x[here], self.points[point][None])[:, 0] <= radius, near, far)
        return -1 - at


def lower_bounds(away: np.ndarray, path: list[tuple]) -> np.ndarray:
    """The least angle of queries to rows whose angles to the vantage points lie in the ranges of ``path``."""
    low = np.zeros(len(away))
    for point, least, most in path:
        low = np.maximum(low, np.maximum(least - away[:, point], away[:, point] - most))
    return low


def reach(score: np.ndarray, size: np.ndarray, longest: float) -> np.ndarray:
    """The angle within which a vector of a length can have such a score."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        ratio = score / size / longest
    wide = ~np.isfinite(ratio) | (np.abs(score) < 1e-290)
    # a negative score may be beaten at any angle by a short vector
    return np.where(wide | (ratio < 0), np.inf, np.arccos(np.clip(ratio, -1.0, 1.0)))


class Shard:
    """Rows of one shard with their tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.way, self.size = polar(x)
        self.tree = Tree(self.way, LEAF)
        self.longest = [self.size[rows].max() for rows in self.tree.leaves]

    def search(self, own: np.ndarray, x: np.ndarray, bar: np.ndarray, k: int, relax: float):
        """The best ``k`` rows of every query that reach its bar: place of the query, identifier, score."""
        way, size = polar(x)
        away = angles(way, self.tree.points)
        low = np.stack([lower_bounds(away, path) for path in self.tree.paths], axis=1)
        home = low.argmin(axis=1)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        bar = bar.copy()
        for first in (True, False):
            for leaf, rows in enumerate(self.tree.leaves):
                asks = home == leaf if first else (home != leaf) & (
                    low[:, leaf] <= relax * reach(bar, size, self.longest[leaf]) + SLACK)
                some = np.flatnonzero(asks)
                if len(some):
                    best = self._visit(some, rows, own, x, way, size, bar, best, k, self.longest[leaf])
        return best

    def _visit(self, some, rows, own, x, way, size, bar, best, k, longest):
        near = (way[some] @ self.way[rows].T) * self.size[rows]
        with np.errstate(over="ignore", invalid="ignore"):
            least = bar[some] / size[some]
        if len(rows) > k + 1:
            least = np.maximum(least, np.partition(near, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1])
        i, j = np.nonzero((near >= (least - 1e-12 * longest)[:, None]) & (self.ids[rows][None, :] != own[some][:, None]))
        i, j = some[i], rows[j]
        score = exact_products(x, i, self.x, j)
        score[np.isnan(score)] = -np.inf
        keep = score >= bar[i]
        if not keep.any():
            return best
        q, ids, score = (np.r_[a, b] for a, b in zip(best, (i[keep], self.ids[j[keep]], score[keep])))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        full = place == k - 1
        bar[q[full]] = np.maximum(bar[q[full]], score[full])
        return q[place < k], ids[place < k], score[place < k]


def shards_of(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Rows (``vec, dim`` and others) with the ``leaf`` of their direction and the ``away`` to the vantage points above."""
    names = rows.columns
    schema = rows.select("*", F.lit(0).alias("leaf"), F.lit(0.0).alias("size"),
                         F.array(F.lit(0.0)).alias("away")).schema

    def place(batches):
        for batch in batches:
            dims = batch.column(names.index("dim")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                way, size = polar(matrix(part.column(names.index("vec"))))
                leaf, away = np.full(len(way), -1), [[]] * len(way)
                if int(dim) in trees:
                    tree = trees[int(dim)]
                    leaf = tree.descend(way)
                    every = angles(way, tree.points)
                    away = [every[i, [p[0] for p in tree.paths[n]]] for i, n in enumerate(leaf.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(leaf, pa.int32()), pa.array(size), pa.array(away, pa.list_(pa.float64()))],
                    [*names, "leaf", "size", "away"])

    return rows.mapInArrow(place, schema)


def summaries(placed: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Per shard: rows, greatest length and the ranges of the angles to the vantage points above."""
    deep = max((len(p) for t in trees.values() for p in t.paths), default=0)
    ranges = [f(F.get("away", F.lit(i))).alias(f"{name}{i}") for i in range(deep) for name, f in (("lo", F.min), ("hi", F.max))]
    found = placed.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.max("size").alias("longest"), *ranges)
    return found.select("dim", "leaf", "n", "longest", F.array(*(f"lo{i}" for i in range(deep))).cast("array<double>").alias("lo"),
                        F.array(*(f"hi{i}" for i in range(deep))).cast("array<double>").alias("hi"))


def further(queries: DataFrame, trees: dict[int, Tree], shards: dict[int, list], relax: float) -> DataFrame:
    """Queries with every ``leaf`` other than their own that may hold something better than their ``bar``."""
    def route(batches):
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                if int(dim) not in trees:
                    continue
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                at = {name: i for i, name in enumerate(part.schema.names)}
                way, size = polar(matrix(part.column(at["vec"])))
                home, bar = (part.column(at[c]).to_numpy(zero_copy_only=False) for c in ("leaf", "bar"))
                away = angles(way, trees[int(dim)].points)
                for leaf, longest, path in shards[int(dim)]:
                    some = np.flatnonzero((home != leaf) & (
                        lower_bounds(away, path) <= relax * reach(bar, size, longest) + SLACK))
                    if len(some):
                        sent = part.take(pa.array(some))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), leaf, np.int32)) if c == "leaf" else sent.column(i) for c, i in at.items()],
                            list(at))

    return queries.mapInArrow(route, queries.schema)


def searched(rows: DataFrame, sizes: DataFrame, queries: DataFrame, k: int, relax: float) -> DataFrame:
    """What queries (``id, q, vec, dim, leaf, bar``) find in their shards."""
    parts = sizes.select("dim", "leaf", F.ceil(F.col("n") / SHARD).alias("parts"))

    def at(part: Column) -> Column:
        return F.xxhash64("dim", "leaf", part)

    blocks = rows.join(parts, ["dim", "leaf"]).select(
        at(F.pmod(F.xxhash64("id", "vec"), F.col("parts"))).alias("at"), "id", "vec", F.lit(0).cast("bigint").alias("q"),
        F.lit(0.0).alias("bar"))
    asked = queries.join(parts, ["dim", "leaf"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select(
        at(F.col("part")).alias("at"), "id", "vec", "q", "bar")

    def compare(batches):
        last, shard = None, None
        for number, table, piece in dealt(batches):
            if number != last:
                last, shard = number, Shard(table.column("id").to_numpy(), matrix(table.column("vec")))
            own, bar, name = (piece.column(piece.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                              for c in ("id", "bar", "q"))
            i, ids, score = shard.search(own, matrix(piece.column(piece.schema.get_field_index("vec"))), bar, k, relax)
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(name[i]), pa.array(ids), pa.array(score)],
                                             ["query_id", "q", "vec_id", "score"])

    return against_blocks(blocks, asked).mapInArrow(compare, FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(df: DataFrame, asks: Column, k: int = K, relax: float = RELAX, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for every row where ``asks`` holds."""
    usable = df.where(F.col(key).isNotNull() & finite(vector)).where(F.exists(F.col(vector), lambda c: c != 0))
    usable = usable.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"),
                           F.size(vector).alias("dim"), asks.alias("asks"))
    queries = as_bytes(usable.where("asks").select("id", "x", "dim").distinct().withColumn("q", F.xxhash64("id", "x")))
    rows = usable.select("id", "x", "dim").distinct()
    # ties between equal vectors go to the first identifiers, and one may be the query's own
    copies = Window.partitionBy("x").orderBy("id")
    kept = as_bytes(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "dim", "x"))
    kept = stored(kept)
    sample: dict[int, list] = {}
    for dim, vec in kept.orderBy(F.xxhash64("vec"), "id").select("dim", "vec").limit(SAMPLE).collect():
        sample.setdefault(dim, []).append(vec)
    total = kept.count()
    # shards near their full size while the sample is fine enough for that
    leaf = max(LEAST, -(-SHARD * min(SAMPLE, total) // max(total, 1)))
    trees = {dim: Tree(polar(np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1))[0], leaf) for dim, vecs in sample.items()}
    placed = stored(shards_of(kept, trees))
    sizes = stored(summaries(placed, trees))
    known: dict[int, list] = {}
    for s in sizes.where("leaf >= 0").collect():  # at most SAMPLE / LEAST shards
        path = trees[s.dim].paths[s.leaf]
        known.setdefault(s.dim, []).append((s.leaf, s.longest, [(p[0], s.lo[i], s.hi[i]) for i, p in enumerate(path)]))
    rows = placed.select("id", "dim", "leaf", "vec")
    asked = stored(shards_of(queries, trees).select("id", "q", "dim", "leaf", "vec"))
    found = stored(first_of(searched(rows, sizes, asked.withColumn("bar", F.lit(float("-inf"))), k, relax), k))
    bars = found.groupBy(F.col("query_id").alias("id"), "q").agg(
        F.when(F.count("*") == k, F.min("score")).otherwise(float("-inf")).alias("bar"))
    others = asked.join(bars, ["id", "q"], "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    more = searched(rows, sizes, further(others, trees, known, relax), k, relax)
    return first_of(found.select("query_id", "q", "vec_id", "score").union(more), k).select(
        "query_id", "rank", "vec_id", "score")
