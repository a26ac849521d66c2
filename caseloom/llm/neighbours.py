"""Near-duplicate embeddings by NN-descent.

Equal vectors are collapsed. A first neighbour graph comes from sorting the vectors by the signs of random projections,
several times, and comparing each with the next few. Then it is refined: whoever are neighbours of one vector are likely
to be neighbours of each other, so all neighbours and reverse neighbours that meet at a vector are compared, and each
keeps the best it has found. A list has ``LIST`` entries; one that is full of links (cosine of ``THRESHOLD`` or more) is
saturated and is enlarged, up to ``DENSE`` links. Reverse neighbours of a popular vector are dealt out in blocks.

*Dense vectors*, those with ``DENSE`` links or more, are counted exactly without listing pairs, since their lists are
full. Those that are connected form a cluster, one without dense neighbours a cluster of its own; its members are put into
blocks by their angle to one of them, the pivot. The pivots are compared with each other; two clusters that are further
apart than the widest angles of both and that of the threshold have no links. Of the blocks of a cluster or of two others,
two whose angles (and that between the pivots) add up to no more than that of the threshold are linked as a whole, two
that are too far apart are not at all, and only the rest is compared, block by block. One link of two linked blocks joins
their clusters.

*Audit.* A stated set of ``AUDIT`` vectors is compared with all vectors, in blocks. While less than ``RECALL`` of their
links were found, the lists grow and the refinement goes on, ``AUDITS`` times at most; the recall is part of the result.
Found pairs below the threshold are never linked.

Defined cases: vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing, nor
do vectors of different lengths; rows that repeat are linked as any equal vectors; an empty table gives no rows. Columns
other than identifier and vector are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import with_row_ids
from caseloom.llm.components import components
from caseloom.plans.lineage import stored

THRESHOLD = 0.9
LIST = 10
DENSE = 40
TABLES = 5        # sortings by random projections
NEXT = 6          # rows a row is compared with in each
SIGNS = 62        # projections of one sorting
ROUNDS = 4
BLOCK = 2048      # vectors compared in one piece
DEGREES = 0.5     # width of the blocks of a dense cluster
SMALL = 256       # members of a cluster that are one block
SLACK = 1e-7      # rounding of an angle
AUDIT = 256
RECALL = 0.98
AUDITS = 3
EDGES = "u bigint, v bigint, sim double"


def unit(vectors: list[bytes]) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def edge_batch(u, v, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)),
                                       pa.array(np.asarray(sim, np.float64))], ["u", "v", "sim"])


def valid(vector: str):
    """Whether a vector can be compared."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda c: c != 0), F.lit(False))


def packed(rows: DataFrame) -> DataFrame:
    """Vectors as bytes of doubles."""
    def pack(batches):
        for batch in batches:
            values = batch.column("x")
            body = [np.array(v.values, dtype=np.float64).tobytes() for v in values]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "m", "dim")),
                                              pa.array(body, pa.binary())], ["node", "m", "dim", "vec"])

    return rows.select("node", "m", "dim", "x").mapInArrow(pack, "node bigint, m bigint, dim int, vec binary")


def groups_of(batches, columns: int):
    """Rows of sorted batches by equal first column: (key, lists of the other columns)."""
    key, held = None, [[] for _ in range(columns - 1)]
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        rest = [batch.column(i) for i in range(1, columns)]
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if keys[a] != key:
                if held[0]:
                    yield key, held
                key, held = keys[a], [[] for _ in range(columns - 1)]
            for one, column in zip(held, rest):
                one.extend(column.slice(a, b - a).to_pylist())
    if held[0]:
        yield key, held


def first_graph(vectors: DataFrame, tables: int, seed: int) -> DataFrame:
    """Edges between rows that stand close in some order by the signs of random projections."""
    def sign(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            body = batch.column(2).to_pylist()
            for dim in np.unique(dims):
                here = np.flatnonzero(dims == dim)
                x = unit([body[i] for i in here])
                for table in range(tables):
                    planes = np.random.default_rng([seed, table, int(dim)]).standard_normal((int(dim), SIGNS))
                    bits = (x @ planes > 0).astype(np.int64)
                    key = bits @ (1 << np.arange(SIGNS, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(here), table, np.int32)), pa.array(key), batch.column(0).take(pa.array(here)),
                         batch.column(1).take(pa.array(here)), batch.column(2).take(pa.array(here))],
                        ["t", "key", "node", "dim", "vec"])

    def compare(batches):
        last = None
        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in range(4)]
            if last:
                rows = [x + y for x, y in zip(last, rows)]
            last = [x[-NEXT:] for x in rows]
            table, node, dim, body = rows
            edges = np.flatnonzero(np.r_[True, np.diff(dim) != 0, True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                x, ids, tables_ = unit(body[a:b]), np.array(node[a:b]), np.array(table[a:b])
                for step in range(1, min(NEXT, b - a - 1) + 1):
                    sim, same = (x[step:] * x[:-step]).sum(axis=1), tables_[step:] == tables_[:-step]
                    u, v = ids[:-step][same], ids[step:][same]
                    yield edge_batch(np.r_[u, v], np.r_[v, u], np.r_[sim[same], sim[same]])

    signed = vectors.select("node", "dim", "vec").mapInArrow(
        sign, "t int, key bigint, node bigint, dim int, vec binary")
    dealt = signed.repartitionByRange("t", "dim", "key", "node").sortWithinPartitions("dim", "t", "key", "node")
    return dealt.select("t", "node", "dim", "vec").mapInArrow(compare, EDGES)


def best(edges: DataFrame, size: int, dense: int) -> DataFrame:
    """The lists: the best ``size`` entries of every vector, more while they are links."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    ranked = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("k", F.row_number().over(order))
    return ranked.where(F.col("k") <= dense).where((F.col("k") <= size) | (F.col("sim") >= THRESHOLD))


def refined(lists: DataFrame, vectors: DataFrame, size: int, dense: int) -> DataFrame:
    """Edges between vectors that meet at a common neighbour, where they are better than what both have."""
    ends = lists.groupBy("u").agg(F.count("*").alias("n"), F.min(F.when(F.col("k") == size, F.col("sim"))).alias("kth"),
                                  F.count_if(F.col("sim") >= THRESHOLD).alias("links"))
    # a list of enough links takes no more; others take links and what is better than their last entry
    bar = F.when(F.col("links") >= dense, 2.0).otherwise(F.least(F.coalesce("kth", F.lit(-2.0)), F.lit(THRESHOLD)))
    member = vectors.join(ends.select(F.col("u").alias("node"), bar.alias("bar")), "node", "left").select(
        "node", F.coalesce("bar", F.lit(-2.0)).alias("bar"), "dim", "vec")
    parts = lists.groupBy(F.col("v").alias("c")).agg(F.ceil(F.count("*") / (2 * dense)).alias("parts"))
    reverse = lists.select(F.col("v").alias("c"), F.col("u").alias("node")).join(parts, "c").select(
        "c", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node")
    forward = lists.select(F.col("u").alias("c"), F.col("v").alias("node")).union(
        lists.select("u", "u").distinct().toDF("c", "node"))
    forward = forward.join(parts, "c", "left").select(
        "c", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "node")
    meeting = forward.union(reverse).distinct().join(member, "node").select(
        F.xxhash64("c", "part").alias("at"), "node", "bar", "vec")

    def compare(batches):
        out, n = [], 0
        for _, (ids, bars, body) in groups_of(batches, 4):
            ids, bars = np.array(ids, np.int64), np.array(bars)
            x = unit(body)
            sim = np.clip(x @ x.T, -1.0, 1.0)
            np.fill_diagonal(sim, -3.0)
            u, v = np.nonzero(sim >= bars[:, None])
            out.append((ids[u], ids[v], sim[u, v]))
            n += len(u)
            if n > 100_000:
                yield edge_batch(*map(np.concatenate, zip(*out)))
                out, n = [], 0
        if out:
            yield edge_batch(*map(np.concatenate, zip(*out)))

    return meeting.repartition("at").sortWithinPartitions("at", "node").mapInArrow(compare, EDGES)


def by_length(vectors: DataFrame) -> list[int]:
    return [r[0] for r in vectors.select("dim").distinct().collect()]


def near_clusters(turned: DataFrame, vectors: DataFrame) -> DataFrame:
    """``cluster, cluster2, between``: each cluster with itself and, both ways, with those that it may have links with,
    and the angle between their pivots."""
    limit = math.acos(THRESHOLD)
    pivots = stored(turned.groupBy("cluster").agg(F.max("angle").alias("reach")).join(
        vectors.select(F.col("node").alias("cluster"), "dim", "vec"), "cluster"))
    parts = -(-pivots.count() // BLOCK)
    dealt = pivots.withColumn("p", F.pmod(F.xxhash64("cluster"), F.lit(parts))).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    at = (F.col("dim").cast("bigint") * parts + F.least("p", "q")) * parts + F.greatest("p", "q")
    side = F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1)

    def compare(batches):
        for _, (side, ids, reach, body) in groups_of(batches, 5):
            side, ids, reach, x = np.array(side), np.array(ids, np.int64), np.array(reach), unit(body)
            one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            for low in range(0, len(one), 256):
                some = one[low: low + 256]
                angle = np.arccos(np.clip(x[some] @ x[two].T, -1.0, 1.0))
                same = ids[some][:, None] == ids[two][None, :]
                angle[same] = 0.0
                i, j = np.nonzero(same | (angle - reach[some][:, None] - reach[two][None, :] <= limit + SLACK))
                u, v, between = ids[some][i], ids[two][j], angle[i, j]
                yield edge_batch(u, v, between)
                if side[some[0]] == 0:
                    yield edge_batch(v, u, between)

    found = dealt.select(at.alias("at"), side.alias("side"), "cluster", "reach", "vec").repartition(
        "at").sortWithinPartitions("at", "side", "cluster").mapInArrow(compare, EDGES)
    return stored(found.toDF("cluster", "cluster2", "between"))


def dense_counts(cluster: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, n``: rows linked with each dense vector among all dense ones, its own rows included; and links ``a, b``
    that connect the clusters that are linked. Members are ``node, cluster``, the cluster's name being one of them."""
    limit = math.acos(THRESHOLD)
    pivot = vectors.select(F.col("node").alias("cluster"), F.col("vec").alias("pivot"))
    rows = cluster.join(vectors, "node").join(pivot, "cluster")

    def turn(batches):
        for batch in batches:
            if batch.num_rows:
                x, p = unit(batch.column(3).to_pylist()), unit(batch.column(4).to_pylist())
                angle = np.arccos(np.clip((x * p).sum(axis=1), -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(angle)],
                                                 ["node", "cluster", "m", "vec", "angle"])

    turned = stored(rows.select("node", "cluster", "m", "vec", "pivot").mapInArrow(
        turn, "node bigint, cluster bigint, m bigint, vec binary, angle double"))
    near = near_clusters(turned, vectors)
    large = turned.groupBy("cluster").agg((F.count("*") > SMALL).alias("large"))
    ringed = turned.join(large, "cluster").withColumn(
        "ring", F.when(F.col("large"), F.floor(F.degrees("angle") / DEGREES)).otherwise(0))
    slices = ringed.groupBy("cluster", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("slices"))
    placed = ringed.join(slices, ["cluster", "ring"]).withColumn(
        "slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    blocks = stored(placed.groupBy("cluster", "ring", "slice").agg(
        F.sum("m").alias("m"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("node").alias("first")))
    other = blocks.select(*(F.col(c).alias(f"{c}2") for c in ("cluster", "ring", "slice", "m", "low", "high", "first")))
    pairs = blocks.join(near, "cluster").join(other, "cluster2")
    certain = F.col("between") + F.col("high") + F.col("high2") <= limit - SLACK
    least = F.greatest(F.col("between") - F.col("high") - F.col("high2"), F.col("low") - F.col("high2") - F.col("between"),
                       F.col("low2") - F.col("high") - F.col("between"))
    whole = stored(pairs.where(certain).groupBy("cluster", "ring", "slice").agg(
        F.sum("m2").alias("n"), F.collect_set(F.when(F.col("cluster") < F.col("cluster2"), F.struct(
            F.col("first").alias("a"), F.col("first2").alias("b")))).alias("joined")))
    sure = placed.join(whole, ["cluster", "ring", "slice"]).select("node", "n")
    open_ = stored(pairs.where(~certain & (least <= limit + SLACK)).select(
        "cluster", "ring", "slice", "cluster2", "ring2", "slice2"))
    name = F.xxhash64("cluster", "ring", "slice", "cluster2", "ring2", "slice2")
    asked = placed.join(open_, ["cluster", "ring", "slice"]).select(name.alias("at"), F.lit(0).alias("side"), "node",
                                                                    "m", "vec")
    against = placed.select(F.col("cluster").alias("cluster2"), F.col("ring").alias("ring2"),
                            F.col("slice").alias("slice2"), "node", "m", "vec").join(
        open_, ["cluster2", "ring2", "slice2"]).select(name.alias("at"), F.lit(1).alias("side"), "node", "m", "vec")

    def compare(batches):
        for _, (side, ids, m, body) in groups_of(batches, 5):
            side, ids, m, x = np.array(side), np.array(ids, np.int64), np.array(m, np.int64), unit(body)
            near = x[side == 0] @ x[side == 1].T >= THRESHOLD
            same = ids[side == 0][:, None] == ids[side == 1][None, :]
            # one link of the two blocks
            u, v = np.divmod(int(np.argmax(near & ~same)), near.shape[1])
            peer = np.full(len(near), -1, np.int64)
            if near[u, v] and not same[u, v]:
                peer[u] = ids[side == 1][v]
            yield pa.RecordBatch.from_arrays([pa.array(ids[side == 0]), pa.array((near | same) @ m[side == 1]),
                                              pa.array(peer, mask=peer < 0)], ["node", "n", "peer"])

    compared = stored(asked.union(against).repartition("at").sortWithinPartitions("at", "side", "node").mapInArrow(
        compare, "node bigint, n bigint, peer bigint"))
    joined = whole.select(F.explode("joined").alias("j")).select("j.a", "j.b").union(
        compared.where("peer IS NOT NULL").select(F.least("node", "peer").alias("a"), F.greatest("node", "peer").alias("b")))
    return sure.union(compared.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n")), joined


def counted(lists: DataFrame, vectors: DataFrame, dense: int) -> tuple[DataFrame, DataFrame]:
    """``node, n`` (rows linked, without its own) and the links ``a, b`` that connect all that is linked."""
    links = stored(lists.where(F.col("sim") >= THRESHOLD).select(
        F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    both = links.union(links.select("b", "a")).toDF("u", "v")
    many = stored(both.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= dense).select("u"))
    heavy = many.select(F.col("u").alias("v"))
    if many.isEmpty():
        inside = both.where("false").select(F.col("u").alias("node"), F.lit(0).cast("bigint").alias("n"))
        outside = both
    else:
        core = both.join(many, "u", "left_semi").join(heavy, "v", "left_semi")
        found = components(core.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(
            F.col("node").alias("u"), F.col("component").alias("cluster"))
        cluster = stored(many.join(found, "u", "left").select(
            F.col("u").alias("node"), F.coalesce("cluster", "u").alias("cluster")))
        inside, joined = dense_counts(cluster, vectors)
        links = stored(links.union(joined).distinct())
        # links between two dense vectors are counted by their clusters
        outside = both.join(many.withColumn("x", F.lit(True)), "u", "left").join(
            heavy.withColumn("y", F.lit(True)), "v", "left").where("x IS NULL OR y IS NULL").select("u", "v")
    light = outside.join(vectors.select(F.col("node").alias("v"), "m"), "v").groupBy(F.col("u").alias("node")).agg(
        F.sum("m").alias("n"))
    own = vectors.select("node", F.col("m").alias("own"))
    inner = inside.join(own, "node").select("node", (F.col("n") - F.col("own")).alias("n"))
    return stored(light.union(inner).groupBy("node").agg(F.sum("n").alias("n"))), links


def audit(counts: DataFrame, vectors: DataFrame, dims: list[int]) -> float:
    """Share of the links of a stated set of vectors that was found; the set is compared with all vectors."""
    asked = vectors.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "dim", "vec", "m").collect()
    sets = {dim: ([r.node for r in asked if r.dim == dim], [r.vec for r in asked if r.dim == dim]) for dim in dims}

    def compare(batches):
        total: dict[int, int] = {}
        for batch in batches:
            size, body, dim = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist(), batch.column(
                1).to_numpy(zero_copy_only=False)
            for d, (ids, vecs) in sets.items():
                here = np.flatnonzero(dim == d)
                if len(ids) and len(here):
                    near = unit(vecs) @ unit([body[i] for i in here]).T >= THRESHOLD
                    for node, n in zip(ids, (near @ size[here]).tolist()):
                        total[node] = total.get(node, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         ["node", "n"])

    true = {r[0]: r[1] for r in vectors.select("m", "dim", "vec").mapInArrow(compare, "node bigint, n bigint").groupBy(
        "node").agg(F.sum("n")).collect()}
    have = {r[0]: r[1] for r in counts.where(F.col("node").isin([r.node for r in asked])).collect()}
    own = {r.node: r.m for r in asked}
    wanted = sum(n - own[i] for i, n in true.items())
    return 1.0 if not wanted else sum(min(have.get(i, 0), n - own[i]) for i, n in true.items()) / wanted


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = LIST,
                    dense: int = DENSE, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: the key, ``n_links`` (other rows linked with it), ``component_id`` (smallest key reachable)
    and the ``recall`` of the audit."""
    rows = stored(with_row_ids(df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("x"))))
    good = rows.where(valid("x"))
    classes = stored(good.groupBy("x").agg(F.min("row_id").alias("node"), F.count("*").alias("m"),
                                           F.min("id").alias("first")).withColumn("dim", F.size("x")))
    vectors = stored(packed(classes))
    lists = stored(best(first_graph(vectors, TABLES, 1), size, dense))
    dims = by_length(vectors)
    for attempt in range(AUDITS):
        for _ in range(rounds):
            found = stored(refined(lists, vectors, size, dense))
            news = found.join(lists, ["u", "v"], "left_anti").limit(1).count()
            if not news:
                break
            lists = stored(best(lists.select("u", "v", "sim").union(found), size, dense))
        counts, links = counted(lists, vectors, dense)
        recall = audit(counts, vectors, dims)
        if recall >= RECALL:
            break
        size *= 2
        lists = stored(best(lists.select("u", "v", "sim").union(first_graph(vectors, TABLES, attempt + 2)), size, dense))
    groups = components(links).select("node", "component")
    named = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = named.join(names, "component").join(counts, "node", "left").select(
        "x", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    linked = good.join(of_class, "x").select("id", "n_links", "component_id")
    alone = rows.where(~valid("x")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias(
        "component_id"))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.lit(recall).alias("recall"))
