"""Vantage-point trees, hard negatives and spelling variants next to plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from caseloom.llm import lemp, vantage, variants
from caseloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vantage", "op12_variants", "op13_negatives"])
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).execute(SQL[name]).df()) is None


# ---------------------------------------------------------------- nearest vectors

def product(x, y):
    total = 0.0  # sum() would compensate
    for a, b in zip(x, y):
        total += a * b
    return total


def nearest(rows, asked, k):
    out = []
    for q, x in rows:
        if q in asked:
            scored = sorted((-product(x, y), i) for i, y in rows if i != q and len(y) == len(x))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, x, "en", 1) for i, x in rows],
                                 "vec_id bigint, embedding array<double>, q string, rank int")


def found_by(df, **options):
    got = vantage.nearest(df, F.col("vec_id") % 3 == 0, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def clustered(n, dim, seed):
    """Groups of near vectors of very different lengths, some of them equal."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.05 * rng.standard_normal((n, dim))
    x *= np.exp(rng.standard_normal(n))[:, None]
    x[::5] = x[0]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD", 20)
    monkeypatch.setattr(vantage, "LEAF", 4)
    monkeypatch.setattr(vantage, "LEAST", 4)
    rows = clustered(150, 5, 1)
    want = nearest(rows, set(range(0, 150, 3)), 4)
    got = found_by(vectors_of(spark, rows), k=4)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == [r[3] for r in want]


def test_shards_beyond_the_sample(spark, monkeypatch):
    for name, value in (("SHARD", 10), ("LEAF", 4), ("LEAST", 2), ("SAMPLE", 8)):
        monkeypatch.setattr(vantage, name, value)
    rows = clustered(90, 3, 2) + [(100 + i, [float(i), 1.0]) for i in range(20)]
    got = found_by(vectors_of(spark, rows), k=3)
    assert [r[:3] for r in got] == [r[:3] for r in nearest(rows, {i for i, _ in rows if i % 3 == 0}, 3)]


def test_relaxed_search_visits_less_and_keeps_recall():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.2 * rng.standard_normal((4000, 16))
    shard, true = vantage.Shard(np.arange(4000), x), np.argsort(-(x[:100] @ x.T), axis=1, kind="stable")
    bar, visits, recalls = np.full(100, -np.inf), [], []
    for relax in (1.0, 0.5, 0.25):
        seen, visit = [0], vantage.Shard._visit
        shard._visit = lambda some, *rest: (seen.append(len(some)), visit(shard, some, *rest))[1]
        q, ids, _ = shard.search(np.arange(100), x[:100], bar, 20, relax)
        wanted = [set([j for j in true[i].tolist() if j != i][:20]) for i in range(100)]
        visits.append(sum(seen))
        recalls.append(sum(j in wanted[i] for i, j in zip(q.tolist(), ids.tolist())) / 2000)
    assert recalls[0] == 1.0 and recalls[1] >= 0.9
    assert visits[0] >= visits[1] > visits[2]


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [1.0, inf]), (8, [1.0, None]), (9, [1.0, 1.0, 1.0]), (10, [-1.0, 5.0]), (None, [9.0, 9.0]),
            (11, [0.5, 1.0])]
    got = found_by(vectors_of(spark, rows), k=3)
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 11, 0.5)]
    assert found_by(vectors_of(spark, rows).where("false")) == []


def test_extreme_lengths_and_ties(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 0.0]), (2, [1e-200, 1e-200]), (3, [0.0, 1e150]), (4, [0.0, 1.0]), (6, [1.0, 0.0]),
            *((i, [0.0, float(i)]) for i in range(20, 60))]
    got = found_by(vectors_of(spark, rows), k=5)
    assert [r[:3] for r in got] == [r[:3] for r in nearest(rows, {i for i, _ in rows if i % 3 == 0}, 5)]


# ---------------------------------------------------------------- hard negatives

def negatives(rows, anchors, k=5):
    out = []
    for place, (a, label, x) in enumerate(rows):
        if a not in anchors:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, n, other) for n, (i, other, y) in enumerate(rows)
                  if n != place and len(x) == len(y)]
        for s, i, _, _ in sorted(r for r in scored if r[3] == label)[:k]:
            good = sorted(r for r in scored if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s)[:k]
            out += [(a, i, n, j, -s, -t) for n, (t, j, _, _) in enumerate(good, 1)]
    return sorted(out)


def mined(spark, rows, anchors):
    df = spark.createDataFrame([(i, None if x is None else [float(v) if v is not None else None for v in x], label, 1.0)
                                for i, label, x in rows], "vec_id bigint, embedding array<double>, label int, score double")
    got = lemp.hard_negatives(df, F.col("id").isin(anchors)).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_negatives_match_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(lemp, "BLOCK", 16)
    monkeypatch.setattr(lemp, "STEPS", (8, 2, 1))
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((5, 6))
    x = centres[rng.integers(0, 5, 200)] + spread * rng.standard_normal((200, 6))
    x = np.floor(x * np.exp(rng.standard_normal(200))[:, None] * 50)
    rows = [(i, int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]
    rows += [(500 + i, 1, rows[0][2]) for i in range(30)]  # a vector that is very frequent
    assert mined(spark, rows, list(range(0, 200, 9))) == negatives(rows, set(range(0, 200, 9)))


def test_candidates_hold_all_that_reaches_the_threshold():
    import pyarrow as pa
    rng = np.random.default_rng(6)
    x = np.floor(256 * (0.3 * rng.standard_normal((400, 8)) + 3 * np.eye(8)[rng.integers(0, 8, 400)]))
    table = pa.table({"id": np.arange(400), "row": np.arange(400), "label": np.zeros(400, np.int64),
                      "vec": pa.array([v.tobytes() for v in x], pa.binary())})
    block, pruned = lemp.Block(table), 0
    for i in range(50):
        scores = x @ x[i]
        for least in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
            rows = block.candidates(x[i], least)
            if rows is not None:
                pruned += 1
                assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
    assert pruned > 50


def test_odd_rows_of_negatives(spark):
    big = float(1 << 30)
    rows = [(0, 1, [3, 0]), (1, 1, [3, 1]), (2, 2, [3, 2]), (3, None, [3, 3]), (4, 2, None), (5, 2, [None, 1]), (6, 2, [math.nan, 1]),
            (7, 2, []), (8, 1, []), (9, 2, [1, 2, 3]), (1, 1, [3, 1]), (10, 2, [0, 0]), (11, 1, [-3, 0]), (12, 3, [big, 1])]
    good = [r for r in rows if r[1] is not None and r[2] is not None and all(v is not None and v == v for v in r[2])]
    anchors = [0, 1, 8, 9, 10, 11, 12]
    assert mined(spark, rows, anchors) == negatives(good, set(anchors))
    assert mined(spark, [], [0]) == []


def test_products_are_exact():
    x = np.array([[2.0 ** 30, 3.0], [1.0, 2.0]])
    assert lemp.products(x, x).tolist() == [[2 ** 60 + 9, 2 ** 30 + 6], [2 ** 30 + 6, 5]]
    y = np.array([[2.0 ** 40, 2.0 ** 39]])
    with pytest.raises(OverflowError):
        lemp.products(y, y)


# ---------------------------------------------------------------- spelling variants

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if near(w, o))
        form = others[0][1] if others and -others[0][0] >= 10 * n else None
        out[w] = (form, n, len(others), -others[0][0] if form else None)
    roots = {}
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        roots[w] = at
    return {w: (f, roots[w], n, m, k) for w, (f, n, m, k) in out.items()}


@pytest.mark.parametrize("hot", [1000, 3])
def test_variants_match_brute_force(spark, hot):
    rng = random.Random(hot)
    counts = Counter()
    for base in ("abababa", "abcabcabc", "ééééèèè", "aaaaaaaa", "lettersandwords", "zzzzzzzzzzzz"):
        counts[base] += rng.choice((2, 300, 5000))
        for _ in range(60):
            w = list(base)
            for _ in range(rng.choice((1, 1, 1, 2))):
                i, what = rng.randrange(len(w)), rng.randrange(3)
                w[i: i + (what != 0)] = [rng.choice("abcé")] if what < 2 else []
            counts["".join(w)] += rng.choice((1, 3, 40, 500))
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(words, hot=hot).collect()}
    assert got == plain_variants(counts)


def test_odd_words(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Abcdefg, ABCDEFG abcdef", "x"), (None, "ÉÉÉÉÉÉÉ × 1234567", "x"),
                                  (4, "abcdefg " * 50_000, "x"), (4, "abcdefg", "x")], "doc_id bigint, text string, word string")
    words = variants.counted(variants.letter_runs(docs).withColumnRenamed("run", "word"))
    assert {(r.word, r.n) for r in words.collect()} == {("abcdefg", 50_003)}
    assert {(r.word, r.root, r.n_near) for r in variants.variants(words).collect()} == {("abcdefg", "abcdefg", 0)}
    assert variants.variants(variants.counted(variants.letter_runs(docs.where("false")).withColumnRenamed("run", "word"))).count() == 0


def test_long_chains_of_forms(spark):
    chain = [("b" * i + "a" * (17 - i), 10 ** (i + 1)) for i in range(17)]
    got = variants.variants(spark.createDataFrame(chain, "word string, n bigint")).collect()
    assert {r.root for r in got} == {chain[-1][0]}
