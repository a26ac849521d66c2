"""Language, toxicity, embeddings, components and the pipeline."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import language, neighbours, toxicity
from caseloom.llm.components import components
from caseloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def ppm_bits(texts, text, order=2):
    """Code length by escapes, written plainly."""
    counts = Counter()
    for word in (w for t in texts for w in t.split()):
        coded = f" {word} ".encode()
        for i in range(1, len(coded)):
            for k in range(min(order, i) + 1):
                counts[coded[i - k: i], coded[i]] += 1
    total = 0.0
    for word in text.split():
        coded = f" {word} ".encode()
        for i in range(1, len(coded)):
            for k in range(min(order, i), -1, -1):
                context = coded[i - k: i]
                after = {s: n for (c, s), n in counts.items() if c == context}
                if not after:
                    continue
                whole = sum(after.values()) + len(after)
                if coded[i] in after:
                    total -= math.log2(after[coded[i]] / whole)
                    break
                total -= math.log2(len(after) / whole)
            else:
                total += 8
    return total


def test_code_lengths():
    texts = ["the thin then", "der die das die"]
    trees = language.Trees([("de", texts[1]), ("en", texts[0])], order=2)
    found = language.Scorer(trees).code_lengths("then dix zz")
    assert trees.languages == ["de", "en"]
    assert found == pytest.approx([ppm_bits([texts[1]], "then dix zz"), ppm_bits([texts[0]], "then dix zz")])


def test_caches_do_not_change_code_lengths(monkeypatch):
    trees = language.Trees([("a", "abc abd bcd"), ("b", "xyz xyy zzy")])
    whole = language.Scorer(trees).code_lengths("abc xyz bcd abd zzz q abc")
    monkeypatch.setattr(language, "CACHED_WORDS", 2)
    assert language.Scorer(trees).code_lengths("abc xyz bcd abd zzz q abc") == pytest.approx(whole)


def test_language_of_odd_rows(spark):
    rows = [(0, None, "en", 1), (1, "", "de", 1), (2, "123 ²!", "de", 1), (3, "the thing", "en", 1), (4, "der die", "de", 1),
            (5, "the thing", None, 1), (6, "The Thing", "en", 1), (6, "The Thing", "en", 1), (7, "the " * 40_000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    found = language.identify(docs, F.lit(True))
    assert {(r.doc_id, r.lang_pred) for r in found.collect()} == {
        (0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "de"), (5, "en"), (6, "en"), (7, "en")}
    assert found.count() == 9 and found.where("score < 0 OR score > 1").count() == 0
    assert language.identify(docs.where("false"), F.lit(True)).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_of_held_out_documents(spark):
    found = QUERIES["op4_language"](spark, FOLDER).where("held_out")
    both = found.join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = both.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right / n > 0.97


def small_network():
    texts = [["good", "day", "idiot"], ["nice", "day"], ["idiot", "x"], ["nice", "x", "good"]] * 3
    return toxicity.Network(toxicity.Words(texts)), texts


def test_gradient_against_differences():
    network, texts = small_network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    words = sorted({w for t in texts for w in t})
    number = {w: i for i, w in enumerate(words)}
    owner, index, mask = toxicity.laid_out([np.array([number[w] for w in t]) for t in texts[:4]])
    y = np.array([1.0, 0.0, 1.0, 0.0])
    # states are kept in single precision, so differences are coarse
    loss, grad = network.gradient(index, mask, owner, y, words)
    rng = np.random.default_rng(1)
    for name, g in grad.items():
        direction = rng.standard_normal(g.shape)
        values = []
        for sign in (1, -1):
            before = network.p[name]
            network.p[name] = before + sign * 1e-2 * direction
            values.append(network.gradient(index, mask, owner, y, words)[0])
            network.p[name] = before
        assert (values[0] - values[1]) / 2e-2 == pytest.approx(float((g * direction).sum()), rel=0.05, abs=2e-3), name


def test_windows_cover_all_words():
    sizes = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    owner, first = toxicity.windows(sizes)
    for text, n in enumerate(sizes):
        seen = {w for f in first[owner == text] for w in range(f, min(f + toxicity.WINDOW, n))}
        assert seen == set(range(n))


def test_parts_of_long_texts_score_as_the_whole(monkeypatch):
    network, _ = small_network()
    text = " ".join(random.Random(1).choice(["good", "day", "idiot", "nice", "x"]) for _ in range(3000))
    whole = toxicity.Scorer(network).raw([text, None, ""])
    assert whole[1:] == [float("-inf")] * 2
    monkeypatch.setattr(toxicity, "GROUP_WORDS", 320)
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 3)
    assert toxicity.Scorer(network).raw([text, None, ""])[0] == pytest.approx(whole[0], abs=1e-4)


def test_best_cut():
    assert toxicity.best_cut([-3, -2, 1, 2], [0, 0, 1, 1], 0.5) == pytest.approx(-0.5)
    assert toxicity.best_cut([1.0], [1], 0.5) == 0.0


def test_toxicity_learns_and_leaves_others_alone(spark):
    rnd = random.Random(2)
    plain = ["day", "nice", "tree", "walk", "rain", "sun", "green", "house", "with", "and"]
    rows = []
    for i in range(240):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 120))]
        if i % 3 == 0:
            for _ in range(1 + len(words) // 25):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["idiot", "scumbag", "moron"]))
        rows.append((i, " ".join(words), int(i % 3 == 0), 0.5))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, score double")
    network = toxicity.train(docs.where("doc_id % 2 = 0"))
    found = toxicity.score(docs.union(spark.createDataFrame([(900, None, 0, 0.1), (901, "", 0, 0.1)], docs.schema)), network)
    rows = found.where("doc_id % 2 = 1 OR doc_id >= 900").collect()
    wrong = sum((r.score >= 0.5) != bool(r.toxic) for r in rows)
    assert wrong <= 4 and all(r.score == 0 for r in rows if r.doc_id >= 900)
    assert toxicity.train(docs.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs.limit(3), None).collect()} == {0.0}


def test_components(spark):
    rnd = random.Random(3)
    pairs = {(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(60)} | {(i, i + 1) for i in range(100, 160)} | {
        (200, i) for i in range(201, 260)}
    edges = spark.createDataFrame(list(pairs), "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    nodes = sorted({n for a, b in pairs if a != b for n in (a, b)})
    want = brute.groups(nodes, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert got == want
    assert components(edges.where("false")).count() == 0


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(16) for _ in range(60)]
    for spread, n in ((0.05, 30), (0.35, 60), (0.12, 6)):
        middle = rng.standard_normal(16)
        rows += [middle + spread * rng.standard_normal(16) * np.linalg.norm(middle) / 4 for _ in range(n)]
    return rows + [rows[0], rows[0] * 3.0, rows[70]]


@pytest.mark.parametrize("dense", [8, 40])
def test_links_of_vectors(spark, dense):
    some = vectors(4)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3, [1.0] * 3]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(some)] + [(500 + i, v, 1) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df, dense=dense).collect()}
    x = np.array(some) / np.linalg.norm(np.array(some), axis=1)[:, None]
    near = x @ x.T >= 0.9
    group = brute.groups(list(range(len(some))), lambda a, b: bool(near[a, b]))
    want = {i: (int(near[i].sum()) - 1, group[i]) for i in range(len(some))}
    want |= {500 + i: (0, 500 + i) for i in range(6)} | {506: (1, 506), 507: (1, 506)}
    assert len(got) == len(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)  # a search: misses are bounded, false links are none
    assert all(got[i][0] <= want[i][0] for i in want)
    assert neighbours.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("cross", [0.93, 0.9])
def test_links_between_dense_clusters(spark, cross):
    """Two tight groups whose lists are full of inner links, linked as a whole (0.93) or in part (0.9); a third apart."""
    rnd = np.random.default_rng(5)
    base = np.linalg.qr(rnd.standard_normal((48, 3)))[0].T
    centres = [base[0], cross * base[0] + math.sqrt(1 - cross ** 2) * base[1], base[2]]
    some = np.concatenate([c + 0.004 * rnd.standard_normal((n, 48)) for c, n in zip(centres, (150, 90, 60))])
    some /= np.linalg.norm(some, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some)], "vec_id bigint, embedding array<double>")
    near = some @ some.T >= 0.9
    want = {i: (int(near[i].sum()) - 1, 0 if i < 240 else 240) for i in range(300)}
    assert near[:150, 150:240].any() and near[:150, 150:240].all() == (cross > 0.92)
    rows = neighbours.near_duplicates(df, dense=20).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want and rows[0].recall == 1.0


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input: what it drops is what it should drop, and clean documents stay as they are."""
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    more = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "12 34", "en", "s", 5)], base.schema)
    again = base.limit(10).withColumn("doc_id", F.col("doc_id") + 5000)
    docs = base.union(more).union(again)
    read = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "SimHash near-dedup", "suffix-array dedup", "packing"]
    docs = read(docs, "0")
    first = read(stages["language ID"](spark, docs, FOLDER), "1")
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()} == {9000, 9001}
    second = read(stages["exact dedup"](spark, first, FOLDER), "2")
    rows = [(r.doc_id, r.text) for r in first.collect()]
    want = {n for n, w in brute.exact(rows).items() if w[2]}
    assert sorted(r.doc_id for r in second.collect()) == sorted(want)
    third = read(stages["SimHash near-dedup"](spark, second, FOLDER), "3")
    prints = {r.doc_id: brute.fingerprint(r.text) for r in second.collect()}
    group = brute.groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    left = [group[r.doc_id] for r in third.collect()]
    assert sorted(left) == sorted(set(group.values()))
    fourth = read(stages["suffix-array dedup"](spark, third, FOLDER), "4")
    before = {r.doc_id: r.text for r in third.collect()}
    ids = sorted(before)
    plain = {n: w[3].decode("utf-8", "ignore") for n, w in zip(ids, brute.without_repeats([before[n] for n in ids], 200))}
    assert {r.doc_id: r.text for r in fourth.collect()} == {n: t for n, t in plain.items() if t or not before[n]}
    assert fourth.columns == docs.columns
    pieces = stages["packing"](spark, fourth, FOLDER)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in fourth.collect()}
    nothing = read(docs.where("false"), "none")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0, name


def test_samples_take_distinct_texts(spark):
    """20,000 copies of four texts hide neither a language nor a label."""
    few = spark.range(20_000).select("id", F.concat(F.lit("der die das "), (F.col("id") % 4).cast("string")).alias("text"),
                                     F.lit("de").alias("lang"), F.lit(1).alias("toxic"))
    many = spark.range(3000).select((F.col("id") + 20_000).alias("id"), F.concat(F.lit("the thing "), "id").alias("text"),
                                    F.lit("en").alias("lang"), F.lit(0).alias("toxic"))
    docs = few.union(many).withColumnRenamed("id", "doc_id")
    chosen = Counter(language.sample(docs))
    assert {t for lang, t in chosen if lang == "de"} == {f"der die das {i}" for i in range(4)}
    assert sum(lang == "en" for lang, _ in chosen) == language.SAMPLE_TEXTS and max(chosen.values()) == 1
    with_labels, share = toxicity.sample(docs, "text", "toxic")
    apart = toxicity.sample(docs.drop("toxic"), "text", "toxic", docs.select("doc_id", "toxic"))
    assert sorted(with_labels) == sorted(apart[0]) and share == apart[1] == 20 / 23
    assert {t for y, t in with_labels if y == 1} == {f"der die das {i}" for i in range(4)}
    assert sum(y == 0 for y, _ in with_labels) == toxicity.SAMPLE_TEXTS
