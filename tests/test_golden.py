"""Known answers, stated by value."""

import math
import random

import pytest
from pyspark.sql import functions as F

from caseloom.functions.maths import format_duration, normal_quantile, student_quantile, student_quantile_column
from caseloom.operators import aggs, anomaly, distributions, filters, graph, joins, measures, ordering, remaining, windows
from caseloom.operators import temporal as tp
from caseloom.plans.ranks import value_ranks

MIN = 60_000


def names(df):
    rows = df.orderBy("case_id", "pos").collect()
    out = {}
    for r in rows:
        out.setdefault(r["case_id"], []).append(r["activity"])
    return out


def test_unroll_loops(make_log, tiny):
    log = make_log({"1": [(a, i) for i, a in enumerate("abcbd")], "2": [(a, i) for i, a in enumerate("abcad")]})
    unrolled = filters.unroll_loops(log)
    assert names(unrolled) == {"1": ["a", "b", "c", "b_2", "d"], "2": ["a", "b", "c", "a_2", "d"]}
    # chains that start at _2 are not undone
    assert names(filters.reduplicate(unrolled)) == names(unrolled)


@pytest.mark.parametrize("classes,expected", [
    (["b_1", "b_2", "b_3"], ["b", "b", "b"]), (["b_0", "b_1"], ["b", "b"]),
    (["b", "b_2", "b_3"], ["b", "b_2", "b_3"]), (["b_1", "b_3"], ["b_1", "b_3"]),
    (["b_2", "b_4"], ["b_2", "b_4"]), (["b_1"], ["b_1"]), (["5", "b_-1"], ["5", "b_-1"]),
    (["b_1", "b_02", "b_2"], ["b", "b", "b"])])
def test_reduplicate(make_log, tiny, classes, expected):
    log = make_log({"1": [(c, i) for i, c in enumerate(classes)]})
    assert names(filters.reduplicate(log))["1"] == expected


def test_active_case_load(make_log, tiny):
    log = make_log({"1": [("a", 10), ("b", 21), ("c", 50)], "2": [("a", 15), ("b", 25), ("c", 55)],
                    "3": [("a", 20), ("b", 30), ("c", 60)]})
    rows = windows.active_case_load(log).orderBy("case_id", "pos").collect()
    found = {a: [r["load"] for r in rows if r["activity"] == a] for a in "abc"}
    assert found == {"a": [1, 2, 3], "b": [3, 3, 3], "c": [3, 2, 1]}


def test_most_frequent_variant_tie(make_log, tiny):
    log = make_log({"1": [("a", 1)], "2": [("b", 2)], "3": [("b", 3)], "4": [("a", 4)]})
    assert names(filters.most_frequent_variant(log)) == {"3": ["b"]}
    assert names(filters.most_frequent_variant(log, all_cases=True)) == {"2": ["b"], "3": ["b"]}


@pytest.mark.parametrize("percent", [5, 35, 95])
def test_accurate_noise(make_log, percent):
    cases = {str(c): [(chr(97 + i), (i + 1) * 10 * MIN) for i in range(10)] for c in range(300)}
    log, p = make_log(cases), percent / 100
    n = 3000
    assert abs(filters.accurate_noise(log, p, 1.0, 3).count() / n - (1 - p)) < 0.06
    assert abs(filters.accurate_noise(log, p, 0.0, 3).count() / n - (1 + p)) < 0.06
    mixed = filters.accurate_noise(log, p, 0.5, 3)
    assert abs(mixed.count() / n - 1) < 0.08
    assert mixed.select("case_id").distinct().count() == 300
    assert mixed.where("pos = 1").count() == 300


def test_add_noise_is_repeatable_and_never_empties(make_log, tiny):
    log = make_log({str(c): [("a", c), ("b", c + 5)] for c in range(50)})
    first = sorted(map(tuple, filters.add_noise(log, 0.4, 1.0, 9).collect()))
    again = sorted(map(tuple, filters.add_noise(log.repartition(7), 0.4, 1.0, 9).collect()))
    assert first == again and len({r[0] for r in first}) == 50


def brute_pairs(cases):
    pairs, profile = {}, {}
    ids = {}
    for events in cases.values():
        for a, _ in events:
            ids.setdefault(a, len(ids))
    for events in cases.values():
        for j, (b, tb) in enumerate(events):
            for i in range(j):
                a, ta = events[i]
                pairs.setdefault((a, b), []).append((tb - ta, j - i))
                between = ",".join(sorted({x for x, _ in events[i + 1:j]}))
                if ids[a] >= ids[b]:
                    profile.setdefault((b, a, between), []).append(tb - ta)
                if ids[b] >= ids[a]:
                    profile.setdefault((a, b, between), []).append(ta - tb)
    return pairs, profile


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_statistics_match_all_pairs(make_log, tiny, seed):
    rng = random.Random(seed)
    cases, begin = {}, 0
    for c in range(12):
        t, events = begin, []
        for _ in range(rng.randint(1, 14)):
            events.append((rng.choice("ABCD"), t))
            t += rng.choice([0, 0, 1, 7, 1000])
        cases[f"c{c:02d}"] = events
        begin += 5
    pairs, profile = brute_pairs(cases)
    log = make_log(cases)
    found = {(r["before"], r["after"]): r for r in tp.pairwise_gaps(log, "milliseconds").collect()}
    assert {k for k in found if k[0] != tp.START} == set(pairs)
    for key, samples in pairs.items():
        gaps = [g for g, _ in samples]
        mean = sum(gaps) / len(gaps)
        sd = math.sqrt(sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) if len(gaps) > 1 else 0
        row = found[key]
        assert row["n"] == len(gaps) and row["n_direct"] == sum(d == 1 for _, d in samples)
        assert row["mean"] == pytest.approx(mean) and row["sd"] == pytest.approx(sd, abs=1e-6)
        assert row["mean_distance"] == pytest.approx(sum(d for _, d in samples) / len(samples))
    seen = {(r["event"], r["other"], ",".join(r["between"])): r for r in tp.temporal_profile(log).collect()}
    assert set(seen) == set(profile)
    for key, values in profile.items():
        row = seen[key]
        assert (row["n"], row["n_negative"], row["n_positive"]) == (
            len(values), sum(v < 0 for v in values), sum(v > 0 for v in values))
        assert row["sum_ms"] == sum(values) and row["sum_sq"] == sum(v * v for v in values)


def test_likelihood_difference(make_log, spark):
    log = make_log({"x": [("startEvent", 0), ("A", MIN)], "y": [("startEvent", 0), ("A", 5 * MIN)]})
    steps = windows.step_durations(log).withColumn("duration", F.col("duration") / MIN)
    dists = spark.createDataFrame([("startEvent", "IMMEDIATE", []), ("A", "NORMAL", [10.0, 2.0])],
                                  "activity string, dist_type string, params array<double>")
    scores = {r["case_id"]: r["log_likelihood"] for r in anomaly.case_likelihood(
        distributions.with_density(steps, dists)).collect()}
    assert scores["y"] == pytest.approx(scores["x"] + 7, abs=0.01)


def test_choices_are_kept_apart(make_log, spark):
    log = joins.with_state(make_log({"x": [("a", 0), ("b", 0)], "y": [("a", 0), ("c", 0)]}))
    steps = log.withColumn("duration", F.lit(0.0))
    dists = spark.createDataFrame([(a, "IMMEDIATE", []) for a in "abc"], "activity string, dist_type string, params array<double>")
    scored = distributions.with_density(steps, dists)
    choices = anomaly.step_choices(scored, joins.branch_weights(joins.successors(log)))
    rows = {r["case_id"]: r for r in anomaly.case_likelihood(scored, choices).collect()}
    assert rows["x"]["n_choices"] == 1 and rows["x"]["log_likelihood"] == 0.0
    assert rows["x"]["choice_log_probability"] == pytest.approx(math.log(0.5))


def test_sample_rank(spark, tiny):
    samples = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    probes = [0, 1, 1.1, 2, 2.1, 3, 3.9, 4, 4.1]
    asked = spark.createDataFrame([(float(p),) for p in probes], "p double")
    ranks = {r["p"]: r["rank"] for r in windows.sample_rank(value_ranks(samples, [], "v"), asked, [], "v", "p").collect()}
    assert [ranks[float(p)] for p in probes] == [0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_p_value_and_intervals(spark):
    dists = spark.createDataFrame([("A", "NORMAL", [10.0, 1.0]), ("B", "NORMAL", [5.0, 1.0]), ("C", "LOGNORMAL", [1.0, 0.5]),
                                   ("U", "UNIFORM", [2.0, 4.0]), ("D", "DETERMINISTIC", [3.0]), ("E", "EXPONENTIAL", [5.0])],
                                  "activity string, dist_type string, params array<double>")
    step = spark.createDataFrame([("A", 9.0)], "activity string, duration double")
    p = anomaly.p_values(distributions.with_density(step, dists)).first()["p_value"]
    assert p == pytest.approx(0.31731, abs=1e-4)
    at = -0.5 * 9 - math.log(math.sqrt(2 * math.pi))

    def ln_c(x):
        return -0.5 * ((math.log(x) - 1) / 0.5) ** 2 - math.log(0.5 * math.sqrt(2 * math.pi)) - math.log(x)
    cutoffs = spark.createDataFrame([("B", at), ("C", ln_c(0.8)), ("E", -20 / 5 - math.log(5))], "activity string, cutoff double")
    found = {}
    for r in anomaly.anomaly_intervals(dists.where("activity <> 'A'"), cutoffs).orderBy("lower").collect():
        found.setdefault(r["activity"], []).append((r["lower"], r["upper"]))
    inf = float("inf")
    assert found["B"] == [(-inf, pytest.approx(2)), (pytest.approx(8), inf)]
    assert found["C"][0][1] == pytest.approx(0.8) and ln_c(found["C"][1][0]) == pytest.approx(ln_c(0.8))
    assert found["U"] == [(-inf, 2.0), (4.0, inf)]
    assert found["D"] == [(-inf, pytest.approx(3 - 1e-5)), (pytest.approx(3 + 1e-5), inf)]
    assert found["E"] == [(-inf, 0.0), (pytest.approx(20), inf)]


def test_histogram_and_kernel_intervals(spark, tiny):
    values = [1.0] * 10 + [2.0] * 10 + [3.0] + [6.0] * 10
    df = spark.createDataFrame([("A", v) for v in values], "activity string, duration double")
    bins = distributions.histogram(df, ["activity"], "duration", 1.0)
    cut = spark.createDataFrame([("A", math.log(0.1))], "activity string, cutoff double")
    found = [(r["lower"], r["upper"]) for r in anomaly.histogram_intervals(bins, cut, 1.0).orderBy("lower").collect()]
    assert found == [(-math.inf, 0.5), (2.5, 5.5), (6.5, math.inf)]
    data = spark.createDataFrame([("A", normal_quantile((k + 0.5) / 400)) for k in range(400)], "activity string, duration double")
    bands, slots = distributions.kernel_model(data, ["activity"], "duration")
    kernel = anomaly.kernel_intervals(bands, slots, spark.createDataFrame([("A", math.log(0.05))], "activity string, cutoff double"))
    rows = kernel.orderBy("lower").collect()
    assert len(rows) == 2 and rows[0]["upper"] == pytest.approx(-2.0, abs=0.15) and rows[1]["lower"] == pytest.approx(2.0, abs=0.15)
    at = distributions.kde(bands, slots, spark.createDataFrame([("A", rows[0]["upper"])], "activity string, x double"), ["activity"], "x")
    assert at.first()["density"] == pytest.approx(0.05, abs=1e-4)


def test_sum_and_discretised_normal(spark):
    dists = spark.createDataFrame([("A", "NORMAL", [50.0, 1.0]), ("B", "NORMAL", [10.0, 1.0])],
                                  "activity string, dist_type string, params array<double>")
    bins = distributions.discretize(dists.where("activity = 'A'"), 0.25)
    total = distributions.convolve(bins, bins, ["activity"])
    mean = total.agg(F.sum((F.col("bin") + 1) * 0.25 * F.col("probability"))).first()[0]
    assert mean == pytest.approx(100, abs=0.4)
    mass = {r["bin"]: r["probability"] for r in distributions.discretize(dists.where("activity = 'B'"), 1.0).collect()}
    assert 0.95 < sum(p for b, p in mass.items() if abs(b - 10) <= 2) < 0.99
    assert 0.997 < sum(p for b, p in mass.items() if abs(b - 10) <= 3) < 1


def test_conditional_expectation(spark, tiny):
    e = spark.range(1).select(remaining.conditional_expectation(F.lit("EXPONENTIAL"), F.array(F.lit(5.0)), F.lit(1000.0)).alias("e"))
    assert e.first()["e"] == 1005.0
    draws = [10 + 2 * normal_quantile((k + 0.5) / 2000) for k in range(2000)]
    train = spark.createDataFrame([(d,) for d in draws], "duration double")
    probe = spark.createDataFrame([(10.0,), (99.0,)], "elapsed double")
    rows = {r["elapsed"]: r for r in remaining.conditional_duration(train, probe, []).collect()}
    assert rows[10.0]["expected"] == pytest.approx(sum(d for d in draws if d >= 10) / 1000)
    assert rows[99.0]["expected"] == 99.0 and rows[99.0]["n_left"] == 0


def test_branch_weights(spark):
    counts = {"s1": [15, 7, 8], "s2": [0, 5, 10]}
    moves = spark.createDataFrame([(s, f"t{i}", n) for s, row in counts.items() for i, n in enumerate(row) if n],
                                  "state string, activity string, n bigint")
    weights = {(r["state"], r["activity"]): r for r in joins.branch_weights(moves).collect()}
    assert weights["s1", "t0"]["weight"] == 16 and weights["s2", "t2"]["weight"] == 19
    assert weights["s2", "t1"]["probability"] == pytest.approx(13 / 32)


def test_error_posterior_quadrature_agrees_with_closed_form(make_log, spark):
    """An exponential pair against direct numerical integration."""
    log = make_log({"x": [("A", 0), ("B", 1)]}).withColumn("duration", F.when(F.col("pos") == 1, 4.0).otherwise(3.0))
    dists = spark.createDataFrame([("A", "EXPONENTIAL", [5.0]), ("B", "EXPONENTIAL", [2.0])],
                                  "activity string, dist_type string, params array<double>")
    row = anomaly.error_scores(distributions.with_density(log, dists), 0.5, 0.1).where("pos = 1").first()

    def fx(u):
        return math.exp(-u / 5) / 5 if u >= 0 else 0

    def fy(u):
        return math.exp(-u / 2) / 2 if u >= 0 else 0
    step = 0.001
    grid = [i * step for i in range(-4000, 11000)]
    mass = sum(fx(u) * fy(7 - u) for u in grid) * step
    blur = [math.exp(-0.5 * ((4 - u) / 0.5) ** 2) / (0.5 * math.sqrt(2 * math.pi)) for u in grid]
    x_err = sum(fx(u) * b for u, b in zip(grid, blur)) * step
    xy_err = sum(fx(u) * fy(7 - u) * b for u, b in zip(grid, blur)) * step / mass
    assert row["x_error_density"] == pytest.approx(x_err, rel=0.01)
    assert row["xy_density"] == pytest.approx(fx(4) * fy(3) / mass, rel=0.05)
    assert row["xy_error_density"] == pytest.approx(xy_err, rel=0.05)


def test_injected_errors_move_time_to_the_next_step(make_log, tiny):
    log = make_log({str(c): [(a, c * 1000 + i * 60_000) for i, a in enumerate("abcdef")] for c in range(20)})
    rows = anomaly.inject_errors(windows.step_durations(log), 0.3, 4).orderBy("case_id", "pos").collect()
    for c in {r["case_id"] for r in rows}:
        mine = [r for r in rows if r["case_id"] == c]
        assert sum(r["observed"] for r in mine) == pytest.approx(300_000 + mine[-1]["error"])
        for r, nxt in zip(mine, mine[1:]):
            assert nxt["observed"] == pytest.approx(nxt["duration"] + nxt["error"] - r["error"])
    assert {r["label"] for r in rows} <= {"NONE", "TIME_ERROR", "STRUCTURAL_ERROR"}
    assert any(r["label"] != "NONE" for r in rows)


def test_student_quantiles(spark):
    assert student_quantile(0.995, 1) == pytest.approx(63.6567, abs=1e-3)
    assert student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    rows = spark.createDataFrame([(n,) for n in (1, 30, 31, 100, 10_000)], "n bigint")
    for r in rows.select("n", student_quantile_column(0.995, F.col("n")).alias("t")).collect():
        assert r["t"] == pytest.approx(student_quantile(0.995, r["n"]), abs=1e-5)


def test_mean_ci(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (2, 4, 4, 4, 5, 5, 7, 9)], "k string, v double")
    r = aggs.mean_ci(df, ["k"], "v", 0.99).first()
    assert r["ci_width"] == pytest.approx(2 * student_quantile(0.995, 7) * math.sqrt(32 / 7 / 8))
    assert r["error_percent"] == pytest.approx((5 / (5 - r["half_width"]) - 1) * 100)


def brute_dtw(a, b):
    inf = float("inf")
    d = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = len(set(x) ^ set(y)) + min(d[i][j], d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("threshold", [0, 1, 3])
def test_similar_curves_match_brute_force(make_log, spark, threshold):
    from caseloom.operators.curves import similar_curves
    rng = random.Random(3)
    log = make_log({f"{c:02}": [(rng.choice("xyz"), t) for t in sorted(rng.sample(range(1000), rng.randint(1, 5)))]
                    for c in range(60)} | {"70": [("x", 0), ("y", 10)], "71": [("x", 5), ("y", 900)], "72": [("x", 7)]})
    # activities that stay open make runs of several points
    log = log.withColumn("lifecycle", F.when(F.col("pos") % 3 == 1, "start").otherwise("complete"))
    series = windows.case_time_series(log, 12)
    points = {}
    for r in series.orderBy("case_id", "t").collect():
        points.setdefault(r["case_id"], []).append(tuple(r["active"]))
    named = {}
    for case in sorted(points):
        named.setdefault(tuple(points[case]), []).append(case)
    want, first = set(), {}
    for curve, cases in named.items():
        shape = tuple(s for i, s in enumerate(curve) if not i or s != curve[i - 1])
        home = first.setdefault(shape, cases[0])
        want.add((home, cases[0], len(named[tuple(points[home])]), len(cases), 0))
        for other, more in named.items():
            d = brute_dtw(curve, other)
            if cases[0] < more[0] and 0 < d <= threshold:
                want.add((cases[0], more[0], len(cases), len(more), d))
            assert (d == 0) == (shape == tuple(s for i, s in enumerate(other) if not i or s != other[i - 1]))
    got = [tuple(r) for r in similar_curves(series, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_case_time_series_holds_open_activities(make_log, tiny):
    log = make_log({"1": [("a", 0), ("b", 50), ("a", 100)], "2": [("z", 5)]}).withColumn(
        "lifecycle", F.when((F.col("activity") == "a") & (F.col("pos") == 1), "start").otherwise("complete"))
    rows = {(r["case_id"], r["t"]): r["active"] for r in windows.case_time_series(log, 4).collect()}
    assert rows["1", 1] == ["a"] and rows["1", 2] == ["a", "b"] and rows["1", 3] == ["a"] and rows["1", 4] == ["a"]
    assert [k for k in rows if k[0] == "2"] == [("2", 0)]


def test_cross_union(spark):
    one = spark.createDataFrame([(["a"],), (["b"],)], "items array<string>")
    none = one.where("false")
    both = {tuple(r["items"]) for r in joins.cross_union(one, one).collect()}
    assert both == {("a",), ("b",), ("a", "b")}
    assert {tuple(r["items"]) for r in joins.cross_union(none, one).collect()} == {("a",), ("b",)}
    assert {tuple(r["items"]) for r in joins.cross_union(one, none).collect()} == {("a",), ("b",)}


def test_weighted_pick_follows_the_weights(spark):
    table = spark.createDataFrame([(k, o, w) for k in range(2000) for o, w in (("a", 1.0), ("b", 3.0))], "k int, option string, w double")
    picks = ordering.weighted_pick(table, ["k"], "option", "w", 5)
    assert picks.count() == 2000
    assert picks.where("option = 'b'").count() / 2000 == pytest.approx(0.75, abs=0.04)


def test_path_cycle_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", -3.0)], "src string, dst string, weight double")
    with pytest.raises(ValueError):
        graph.path_distances(edges, "a")
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    assert {r["node"]: r["distance"] for r in graph.path_distances(ring, "a").collect()} == {"a": 0.0, "b": 1.0, "c": 3.0}


def test_running_entropy_ends_at_the_entropy(make_log, tiny):
    rng = random.Random(8)
    log = make_log({f"{c:03d}": [(rng.choice("ab"), c * 100 + i) for i in range(rng.randint(1, 3))] for c in range(40)})
    curve = {r["sample_count"]: r["sample_entropy"] for r in windows.running_entropy(log).collect()}
    assert sorted(curve) == list(range(1, 41))
    assert curve[40] == pytest.approx(measures.log_entropy(log).first()["entropy"])


def test_format_duration(spark):
    r = spark.range(1).select(format_duration(F.lit(3_661_999).cast("bigint")).alias("a"), format_duration(
        F.lit(360_000_000).cast("bigint")).alias("b")).first()
    assert (r["a"], r["b"]) == ("01:01:01", "100:00:00")


def test_subset_study_equals_projected_evaluation(make_log, spark):
    """Each subset of the study equals the comparison on the projected log."""
    rng = random.Random(5)
    log = make_log({f"{c:02d}": [(rng.choice("abc"), c * 10_000 + t) for t in sorted(rng.sample(range(5000), 4))] for c in range(12)})
    study = {(r["subset"], r["method"]): r for r in remaining.subset_study(log, ["a"], ["b", "c"], 1, 3, 4).collect()}
    kept = log.where(F.col("activity").isin("a", "b")).withColumnRenamed("pos", "_was")
    kept = kept.selectExpr("'a,b#' || case_id AS case_id", "row_number() OVER (PARTITION BY case_id ORDER BY _was) AS pos",
                           "activity", "ts").withColumn("pos", F.col("pos").cast("bigint"))
    alone = {r["method"]: r for r in remaining.compare_predictors(kept, 3, 4).collect()}
    assert {k[0] for k in study} == {"a,b", "a,c"}
    assert study["a,b", "naive"]["n"] == alone["naive"]["n"]


def test_error_test_on_a_convolved_grid(make_log, spark):
    """p-value of the sum of two exponential durations against direct integration."""
    log = make_log({"x": [("A", 0), ("B", 1)]}).withColumn("duration", F.when(F.col("pos") == 1, 14.0).otherwise(6.0))
    dists = spark.createDataFrame([("A", "EXPONENTIAL", [5.0]), ("B", "EXPONENTIAL", [2.0])],
                                  "activity string, dist_type string, params array<double>")
    rows = anomaly.error_test(distributions.with_density(log, dists), dists, 0.25).orderBy("pos").collect()

    def g(s):
        return (math.exp(-s / 5) - math.exp(-s / 2)) / 3
    step = 0.001
    expected = sum(g(i * step) * step for i in range(1, 120_000) if g(i * step) <= g(20.0))
    assert rows[0]["p_child"] == pytest.approx(math.exp(-3.0))
    assert rows[0]["p_sum"] == pytest.approx(expected, abs=0.01)
    assert rows[0]["is_error"] == (rows[0]["p_sum"] > rows[0]["p_child"])
    assert rows[1]["p_sum"] is None and rows[1]["is_error"] == (math.exp(-3.0) < 0.05)


def test_filtered_classes_have_positions_without_gaps(spark, make_log, tiny):
    log = make_log({"c": [("a", 0), ("x", 1), ("b", 2)], "d": [("x", 0), ("a", 5)]})
    kept = filters.filter_classes(log, ["a", "b"])
    assert sorted((r.case_id, r.pos, r.activity) for r in kept.collect()) == [("c", 1, "a"), ("c", 2, "b"), ("d", 1, "a")]


def test_load_with_missing_times(spark, make_log, tiny):
    log = make_log({"c": [("a", None), ("b", 10), ("c", 30)], "d": [("a", 20), ("b", None)], "e": [("a", 25), ("b", 40)]})
    load = {(r.case_id, r.pos): r.load for r in windows.active_case_load(log).collect()}
    assert load == {("c", 2): 1, ("d", 1): 2, ("e", 1): 2, ("c", 3): 2, ("e", 2): 1}


def test_intervals_of_two_clusters(spark, tiny):
    values = [k / 40 for k in range(41)] + [100 + k / 40 for k in range(41)]
    df = spark.createDataFrame([("A", v) for v in values], "activity string, duration double")
    bands, slots = distributions.kernel_model(df, ["activity"], "duration")
    bins = distributions.histogram(df, ["activity"], "duration", 1.0)

    def cut(value):
        return spark.createDataFrame([("A", value)], "activity string, cutoff double")

    def spans(found):
        return [(r.lower, r.upper) for r in found.orderBy("lower").collect()]

    # above all of the density, below all of it inside the scan, between the modes
    assert spans(anomaly.kernel_intervals(bands, slots, cut(5.0))) == [(-math.inf, math.inf)]
    assert spans(anomaly.histogram_intervals(bins, cut(5.0), 1.0)) == [(-math.inf, math.inf)]
    low = spans(anomaly.kernel_intervals(bands, slots, cut(-1e6)))
    assert len(low) == 2 and low[0][0] == -math.inf and low[-1][1] == math.inf and low[0][1] < 0 and low[1][0] > 101
    middle = spans(anomaly.kernel_intervals(bands, slots, cut(-9.0)))
    assert middle[0][0] == -math.inf and middle[-1][1] == math.inf
    assert all(a < b for a, b in middle) and all(x[1] < y[0] for x, y in zip(middle, middle[1:]))
    assert not any(a < v < b for a, b in middle for v in values)


def test_intervals_of_all_families(spark, tiny):
    df = spark.createDataFrame([("H", 1.0), ("H", 1.0), ("K", 1.0), ("K", 2.0)], "activity string, duration double")
    bands, slots = distributions.kernel_model(df.where("activity = 'K'"), ["activity"], "duration")
    bins = distributions.histogram(df.where("activity = 'H'"), ["activity"], "duration", 1.0)
    dists = spark.createDataFrame([("N", "NORMAL", [0.0, 1.0]), ("H", "HISTOGRAM", None), ("K", "GAUSSIAN_KERNEL", None)],
                                  "activity string, dist_type string, params array<double>")
    cuts = spark.createDataFrame([("N", -2.0), ("H", -2.0), ("K", -2.0)], "activity string, cutoff double")
    found = anomaly.all_anomaly_intervals(dists, cuts, bins, 1.0, bands, slots).collect()
    assert {r.activity for r in found} == {"N", "H", "K"}
    assert {r.activity for r in found if r.lower == -math.inf} == {r.activity for r in found if r.upper == math.inf} == {
        "N", "H", "K"}


def test_grids_follow_the_support(spark):
    dists = spark.createDataFrame([("U", "UNIFORM", [0.0, 4000.0]), ("V", "UNIFORM", [1500.0, 1600.0]),
                                   ("E", "EXPONENTIAL", [2e7]), ("D", "DETERMINISTIC", [7.0]), ("I", "IMMEDIATE", None)],
                                  "activity string, dist_type string, params array<double>")
    bins = distributions.discretize(dists.where("activity <> 'E'"), 1.0)
    about = {r.activity: r for r in bins.groupBy("activity").agg(
        F.min("bin").alias("low"), F.max("bin").alias("high"), F.sum("probability").alias("p")).collect()}
    assert (about["U"].low, about["U"].high) == (0, 4000) and (about["V"].low, about["V"].high) == (1500, 1600)
    assert (about["D"].low, about["D"].high, about["I"].low) == (7, 7, 0)
    assert all(r.p == pytest.approx(1) for r in about.values())
    wide = distributions.discretize(dists.where("activity = 'E'"), 1e5)
    mean = wide.agg(F.sum((F.col("bin") + 0.5) * 1e5 * F.col("probability"))).first()[0]
    assert mean == pytest.approx(2e7, rel=0.01)


def test_measurement_errors_in_any_unit(spark, make_log):
    rows = {f"c{i}": [("a", 0), ("b", 0)] for i in range(6)}
    long = [1000.0, 1200.0, 900.0, 1100.0, 9000.0, 1000.0]
    log = make_log(rows)
    found = []
    for unit in (1.0, 1e6):
        value = F.element_at(F.array(*(F.lit(v * unit) for v in long)), F.substring("case_id", 2, 1).cast("int") + 1)
        steps = log.withColumn("duration", F.when(F.col("activity") == "a", value).otherwise(1000.0 * unit))
        dists = distributions.fit_durations(steps.select("activity", "duration"), "EXPONENTIAL")
        flags = anomaly.error_test(distributions.with_density(steps, dists), dists)
        found.append({(r.case_id, r.pos): (round(r.p_sum, 6) if r.p_sum is not None else None, r.is_error)
                      for r in flags.collect()})
    assert found[0] == found[1] and any(p for p, _ in found[0].values())
    kernel = dists.withColumn("dist_type", F.lit("HISTOGRAM"))
    with pytest.raises(ValueError):  # without the bins
        anomaly.error_test(distributions.with_density(steps, dists).withColumn("dist_type", F.lit("HISTOGRAM")), kernel)


def grid_of_sum(spark, one, two, **measured):
    from caseloom.operators import sums
    fits = spark.createDataFrame([("A", *one), ("B", *two)], "activity string, dist_type string, params array<double>")
    cells = sums.fit_cells(fits, **measured)
    sides = [cells.where(F.col("activity") == name).drop("activity").withColumn("key", F.lit("s")) for name in "AB"]
    rows = sums.sum_cells(*sides, ["key"]).orderBy("k").collect()
    whole = sum(r["mass"] for r in rows)
    return [(r["low"], r["high"], r["mass"] / whole, r["p"]) for r in rows]


def test_sums_of_heavy_tails(spark):
    """LOGNORMAL(0, 2.5) twice: masses within 0.01 of direct integration, p-values of the densities as well."""
    rows = grid_of_sum(spark, ("LOGNORMAL", [0.0, 2.5]), ("LOGNORMAL", [0.0, 2.5]))
    nodes = [math.exp(2.5 * normal_quantile((k + 0.5) / 20_000)) for k in range(20_000)]

    def below(s):  # share of the sum below s
        return sum(0.5 * math.erfc(-math.log(s - x) / 2.5 / math.sqrt(2)) for x in nodes if x < s) / len(nodes)

    for s in (0.05, 0.5, 1.0, 4.0, 20.0, 300.0, 5000.0):
        assert sum(m for _, high, m, _ in rows if high <= s) == pytest.approx(below(s), abs=0.01)
    # the density falls behind its mode, so the p-value of a large sum is what lies above it and a little near 0
    for low, high, _, p in rows:
        if low > 50:
            assert p == pytest.approx(1 - below(low), abs=0.01)
    assert rows[0][1] - rows[0][0] < 0.1 and rows[-1][1] > 1e4


@pytest.mark.parametrize("kind", ["GAMMA", "UNIFORM", "DETERMINISTIC", "HISTOGRAM", "GAUSSIAN_KERNEL"])
def test_sums_of_other_families(spark, kind):
    values = [1.0 + 4 * (k + 0.5) / 500 for k in range(500)]
    draws = spark.createDataFrame([("A", v) for v in values], "activity string, duration double")
    bins = distributions.histogram(draws, ["activity"], "duration", 0.05)
    kernels = distributions.kernel_model(draws, ["activity"], "duration")
    params = {"GAMMA": [4.0, 0.5], "UNIFORM": [1.0, 5.0], "DETERMINISTIC": [3.0]}.get(kind, [])
    rows = grid_of_sum(spark, (kind, params), ("EXPONENTIAL", [2.0]), bins=bins, kernels=kernels)
    mean = {"GAMMA": 2.0}.get(kind, 3.0) + 2
    assert sum((low + high) / 2 * m for low, high, m, _ in rows) == pytest.approx(mean, rel=0.02)
    half = [low for low, _, m, _ in rows if low <= 5.0]
    share = sum(m for low, _, m, _ in rows if low <= 5.0)
    if kind == "DETERMINISTIC":
        assert share == pytest.approx(1 - math.exp(-1), abs=0.01)
    elif kind != "GAMMA":  # mean over the uniform part of the exponential one
        assert share == pytest.approx(sum(1 - math.exp(-(5 - v) / 2) for v in values) / 500, abs=0.02)
    assert half


def test_error_test_of_measured_fits(spark, make_log):
    rng = random.Random(4)
    log = make_log({f"c{i}": [("a", 0), ("b", 0)] for i in range(120)}).withColumn(
        "duration", F.when(F.col("activity") == "a", 5.0).otherwise(9.0) + F.substring("case_id", 2, 3).cast("double") / 30)
    odd = log.withColumn("duration", F.when(F.col("case_id") == "c7", F.when(F.col("pos") == 1, 8.9).otherwise(9.4)).otherwise(
        F.col("duration")))
    data = odd.select("activity", "duration")
    results = []
    for family in ("HISTOGRAM", "GAUSSIAN_KERNEL"):
        dists = distributions.fit_durations(data, family)
        bins = distributions.histogram(data, ["activity"], "duration", 0.25)
        kernels = distributions.kernel_model(data, ["activity"], "duration")
        scored = distributions.with_density(odd, dists, bins, 0.25, kernels)
        found = {(r.case_id, r.pos): r for r in anomaly.error_test(scored, dists, bins=bins, kernels=kernels).collect()}
        assert len(found) == 240
        assert all((r.p_sum is None) == (pos == 2) and 0 <= (r.p_sum or 0) <= 1 for (_, pos), r in found.items())
        assert found["c60", 1].p_sum > 0.5 and found["c119", 1].p_sum < 0.2
        results.append(found)
    assert rng is not None and results[0].keys() == results[1].keys()


@pytest.mark.parametrize("shape,scale", [(0.4, 3.0), (6.0, 1000.0)])
def test_gamma_fits(spark, shape, scale):
    """Quantiles of a gamma distribution bring its parameters back; densities integrate to the distribution function."""
    fit = spark.createDataFrame([("G", "GAMMA", [shape, scale])], "activity string, dist_type string, params array<double>")
    u = F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: (i + 0.5) / 100)).alias("u")
    draws = fit.select("activity", "dist_type", "params", u).select("activity", distributions.quantile(
        F.col("dist_type"), F.col("params"), F.col("u"), F.lit(0.0)).alias("duration"), "u", "dist_type", "params")
    draws = spark.createDataFrame(draws.collect(), draws.schema)
    back = distributions.fit_durations(draws.select("activity", "duration"), "GAMMA").first()
    assert back["dist_type"] == "GAMMA" and back["params"] == pytest.approx([shape, scale], rel=0.05)
    checked = draws.select("u", "duration", distributions.cdf(F.col("dist_type"), F.col("params"), F.col("duration")).alias("c"),
                           distributions.density(F.col("dist_type"), F.col("params"), F.col("duration")).alias("d")).collect()
    assert all(r.c == pytest.approx(r.u, abs=1e-8) for r in checked)
    for r in checked[::20]:
        want = math.exp((shape - 1) * math.log(r.duration) - r.duration / scale - math.lgamma(shape) - shape * math.log(scale))
        assert r.d == pytest.approx(want, rel=1e-8)
    mean, variance = fit.select(*distributions.moments(F.col("dist_type"), F.col("params"))).first()
    assert (mean, variance) == pytest.approx((shape * scale, shape * scale * scale))


@pytest.mark.parametrize("a,b", [(0.5, 0.5), (2.0, 5.0)])
def test_beta_fits(spark, a, b):
    fit = spark.createDataFrame([("B", "BETA", [a, b])], "activity string, dist_type string, params array<double>")
    u = F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: (i + 0.5) / 100)).alias("u")
    draws = fit.select("activity", "dist_type", "params", u).select("activity", distributions.quantile(
        F.col("dist_type"), F.col("params"), F.col("u"), F.lit(0.0)).alias("duration"), "u")
    draws = spark.createDataFrame(draws.collect(), draws.schema)
    odd = draws.select("activity", "duration").union(spark.createDataFrame([("B", 0.0), ("B", 1.0), ("B", 7.0)], "a string, d double"))
    back = distributions.fit_durations(odd, "BETA").first()
    assert back["dist_type"] == "BETA" and back["params"] == pytest.approx([a, b], rel=0.06)


def test_intervals_of_gamma_and_beta(spark):
    fits = [("g", "GAMMA", [3.0, 2.0]), ("j", "GAMMA", [0.5, 2.0]), ("b", "BETA", [2.0, 5.0]), ("u", "BETA", [0.5, 0.5])]
    dists = spark.createDataFrame(fits, "activity string, dist_type string, params array<double>")

    def logf(kind, p, x):
        if kind == "GAMMA":
            return (p[0] - 1) * math.log(x) - x / p[1] - math.lgamma(p[0]) - p[0] * math.log(p[1])
        return ((p[0] - 1) * math.log(x) + (p[1] - 1) * math.log1p(-x) + math.lgamma(sum(p)) - math.lgamma(p[0]) - math.lgamma(p[1]))

    for cut in (-3.0, -0.4, 5.0):
        cuts = dists.select("activity", F.lit(cut).alias("cutoff"))
        found = {}
        for r in anomaly.anomaly_intervals(dists, cuts).collect():
            found.setdefault(r.activity, []).append((r.lower, r.upper))
        for name, kind, p in fits:
            top = 1.0 if kind == "BETA" else 60.0
            for i in range(1, 400):
                x = top * i / 400
                if abs(logf(kind, p, x) - cut) > 1e-6:
                    assert any(lo < x < hi for lo, hi in found[name]) == (logf(kind, p, x) < cut), (name, cut, x)
            assert any(lo < -1 < hi for lo, hi in found[name]) and any(lo < top + 1e5 < hi for lo, hi in found[name])


def test_narrow_modes_of_kernels_are_found(spark):
    """A mode far narrower than a thousandth of the range."""
    bands = spark.createDataFrame([("A", 3, 0.01, 0.0, 1e6, 0.0)], "activity string, n bigint, h double, _lo double, _hi double, _width double")
    slots = spark.createDataFrame([("A", 0.0, 1), ("A", 123456.7, 1), ("A", 1e6, 1)], "activity string, centre double, weight bigint")
    cut = spark.createDataFrame([("A", 0.0)], "activity string, cutoff double")
    found = anomaly.kernel_intervals(bands, slots, cut).orderBy("lower").collect()
    width = 0.01 * math.sqrt(2 * math.log(1 / (3 * 0.01 * math.sqrt(2 * math.pi))))
    ends = [v for c in (0.0, 123456.7, 1e6) for v in (c - width, c + width)]
    assert [v for r in found for v in (r.lower, r.upper)] == pytest.approx([-math.inf, *ends, math.inf], abs=1e-6)


def test_fitted_kernels_are_among_all_intervals(spark):
    values = [k / 40 for k in range(41)] + [100 + k / 40 for k in range(41)]
    data = spark.createDataFrame([(a, v) for a in "NHK" for v in values], "activity string, duration double")
    fits = None
    for name, family in (("N", "NORMAL"), ("H", "HISTOGRAM"), ("K", "GAUSSIAN_KERNEL")):
        part = distributions.fit_durations(data.where(F.col("activity") == name), family)
        fits = part if fits is None else fits.union(part)
    bands, slots = distributions.kernel_model(data, ["activity"], "duration")
    bins = distributions.histogram(data, ["activity"], "duration", 1.0)
    cuts = spark.createDataFrame([(a, -9.0) for a in "NHK"], "activity string, cutoff double")
    found = anomaly.all_anomaly_intervals(fits, cuts, bins, 1.0, bands, slots).collect()
    assert {r.activity for r in found} == {"N", "H", "K"}
    own = anomaly.kernel_intervals(bands.where("activity = 'K'"), slots.where("activity = 'K'"), cuts.where("activity = 'K'"))
    assert sorted((r.lower, r.upper) for r in found if r.activity == "K") == sorted((r.lower, r.upper) for r in own.collect())


def test_means_of_tails(spark, tiny):
    def mean(kind, params, elapsed):
        return spark.range(1).select(remaining.conditional_expectation(
            F.lit(kind), F.array(*map(F.lit, params)), F.lit(elapsed), kind in ("GAMMA", "BETA")).alias("e")).first()["e"]

    assert mean("NORMAL", [10.0, 2.0], 10.0) == pytest.approx(10 + 2 * math.sqrt(2 / math.pi), rel=1e-5)
    assert mean("NORMAL", [10.0, 2.0], 99.0) == 99.0
    # a gamma distribution of shape 2 beyond t: the sum of two exponential parts
    assert mean("GAMMA", [2.0, 3.0], 6.0) == pytest.approx((36 / 3 + 2 * 6 + 2 * 3) / (1 + 6 / 3) , rel=1e-6)
    assert mean("GAMMA", [2.0, 3.0], 0.0) == pytest.approx(6.0)
    # density 2x on (0, 1)
    assert mean("BETA", [2.0, 1.0], 0.5) == pytest.approx((2 / 3) * (1 - 0.125) / (1 - 0.25), rel=1e-6)
    draws = [math.exp(1 + 0.5 * normal_quantile((k + 0.5) / 200_000)) for k in range(200_000)]
    left = [d for d in draws if d >= 4.0]
    assert mean("LOGNORMAL", [1.0, 0.5], 4.0) == pytest.approx(sum(left) / len(left), rel=1e-3)
    assert mean("LOGNORMAL", [1.0, 0.5], 0.0) == pytest.approx(math.exp(1.125))
    parts = spark.createDataFrame([("A", 1.0, 3.0), ("A", 5.0, 1.0), ("A", 9.0, 1.0)], "activity string, value double, weight double")
    probes = spark.createDataFrame([("A", 0.0), ("A", 4.0), ("A", 99.0), ("B", 2.0)], "activity string, elapsed double")
    rows = {(r.activity, r.elapsed): r.expected for r in remaining.conditional_table(parts, probes, ["activity"]).collect()}
    assert rows == {("A", 0.0): pytest.approx(17 / 5), ("A", 4.0): 7.0, ("A", 99.0): 99.0, ("B", 2.0): 2.0}


def test_conversion_of_kernels(spark, tiny):
    df = spark.createDataFrame([("A", float(v)) for v in range(101)], "activity string, duration double")
    bands, slots = distributions.kernel_model(df, ["activity"], "duration")
    measured = distributions.kernel_moments(bands, slots, ["activity"])
    dists = spark.createDataFrame([("A", "GAUSSIAN_KERNEL", None)], "activity string, dist_type string, params array<double>")
    out = distributions.convert_dists(dists, "NORMAL", measured).first()
    h = bands.first()["h"]
    assert out["dist_type"] == "NORMAL" and out["params"][0] == pytest.approx(50, abs=0.1)
    assert out["params"][1] == pytest.approx(math.sqrt(100 * 102 / 12 + h * h), rel=0.01)


def test_distances_from_many_sources(spark):
    from caseloom.operators import graph
    rng = random.Random(9)
    edges = [(str(rng.randrange(40)), str(rng.randrange(40)), float(rng.randint(0, 20))) for _ in range(110)]
    sources = ["0", "1", "2", "7", "nowhere"]
    want = {}
    for s in sources:
        best = {s: 0.0}
        for _ in range(41):
            for a, b, w in edges:
                if a in best and best[a] + w < best.get(b, math.inf):
                    best[b] = best[a] + w
        want.update({(s, n): d for n, d in best.items()})
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    table = spark.createDataFrame([(s,) for s in [*sources, "0", None]], "source string")
    found = {(r["source"], r["node"]): r["distance"] for r in graph.distances_from(df, table).collect()}
    assert found == want
    near = {(r["source"], r["node"]): r["distance"] for r in graph.distances_from(df, table, 9.0).collect()}
    assert near == {k: d for k, d in want.items() if d <= 9}
    with pytest.raises(ValueError):
        graph.distances_from(df.withColumn("weight", F.lit(-1.0)), table)


def test_lognormal_fit_with_zeros_is_that_of_their_logarithms(spark):
    data = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 4.0)], "activity string, duration double")
    fits = {r["activity"]: r["params"] for r in distributions.fit_durations(data, "LOGNORMAL", zeros=True).collect()}
    assert fits["a"][0] == -math.inf and math.isnan(fits["a"][1])
    assert fits["b"] == pytest.approx([math.log(2), math.log(4) / math.sqrt(2)])
    dists = distributions.fit_durations(data, "LOGNORMAL", zeros=True)
    scored = distributions.with_density(data, dists.localCheckpoint()).where("activity = 'a'").collect()
    assert all(math.isnan(r["density"]) for r in scored)
    left = {r["activity"]: r["params"] for r in distributions.fit_durations(data, "LOGNORMAL").collect()}
    assert left["a"] == pytest.approx([math.log(2) / 2, math.log(2) / math.sqrt(2)])


def test_gamma_fit_with_zeros_has_the_smallest_shape(spark):
    data = spark.createDataFrame([("a", v) for v in (0.0, 1.0, 2.0, 5.0)], "activity string, duration double")
    dists = distributions.fit_durations(data, "GAMMA", zeros=True).localCheckpoint()
    shape, scale = dists.first()["params"]
    assert shape == pytest.approx(math.exp(-10)) and shape * scale == pytest.approx(2.0)
    found = {r["duration"]: r["log_density"] for r in distributions.with_density(data, dists).collect()}
    assert found[0.0] == math.inf
    assert found[2.0] == pytest.approx((shape - 1) * math.log(2) - 2 / scale - math.lgamma(shape) - shape * math.log(scale))


def test_movement_after_an_interval_of_no_length(spark):
    from caseloom.operators.joins import resource_movements
    rows = spark.createDataFrame([("r", 1, "A", 0, 0), ("r", 2, "B", 10, 20), ("r", 3, "A", 30, 31)],
                                 "resource string, id bigint, location string, s bigint, e bigint")
    iv = rows.select("resource", "id", "location", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    far = spark.createDataFrame([("A", "B", 6.0), ("B", "A", 4.0)], "origin string, target string, distance double")
    fast = spark.createDataFrame([("r", 2.0)], "resource string, speed double")

    def travel(**more):
        return {r["id"]: r["travel_ms"] for r in resource_movements(iv, far, fast, **more).collect()}

    assert travel() == {2: 0, 3: 2000}
    assert travel(single=F.lit(False)) == {2: 3000, 3: 2000}


@pytest.mark.parametrize("threshold", [1, 3])
def test_similar_cases_are_warped_once_per_class(spark, make_log, monkeypatch, threshold):
    """Distances of all curves as by the full table over 201 points; long runs count as short ones do."""
    from caseloom.operators import curves
    rng = random.Random(threshold)
    cases = {f"c{k:02d}": sorted([("ABC"[rng.randrange(3)], m) for m in [0, 400] + [rng.choice([2, 4, 6, 200, 396]) for _ in range(
        rng.randrange(4))]], key=lambda e: e[1]) for k in range(40)}
    sizes, warped = [], curves._warped
    monkeypatch.setattr(curves, "_warped", lambda pairs, t: (sizes.append(
        pairs.select(F.max(F.array_max("lengths"))).first()[0]), warped(pairs, t))[1])
    found = {(r["left"], r["right"]): r["distance"] for r in curves.similar_cases(make_log(cases), threshold).collect()}
    assert max(sizes) <= threshold + 1

    points = {c: [frozenset(a for a, m in events if m // 2 == t) for t in range(201)] for c, events in cases.items()}
    first = {}
    for c in sorted(points):
        first.setdefault(tuple(points[c]), c)
    shapes, expected = {}, {}

    def distance(a, b):
        best = [0] + [math.inf] * len(b)
        for x in a:
            row = [math.inf]
            for j, y in enumerate(b):
                row.append(len(x ^ y) + min(row[j], best[j], best[j + 1]))
            best = row
        return best[-1]

    for curve, c in first.items():
        shape = tuple(s for i, s in enumerate(curve) if i == 0 or s != curve[i - 1])
        expected[shapes.setdefault(shape, c), c] = 0
        for other, o in first.items():
            if c < o and 0 < (d := distance(curve, other)) <= threshold:
                expected[c, o] = d
    assert found == expected and len(set(expected.values())) > 1


def test_kernel_density_is_summed_once_per_value(tiny, monkeypatch):
    rows = [("a", float(k % 7)) for k in range(60)] + [("b", float(k % 3)) for k in range(12)] + [("a", None)]
    data = tiny.createDataFrame(rows, "activity string, duration double").withColumn("pos", F.monotonically_increasing_id())
    bands, slots = distributions.kernel_model(data, ["activity"], "duration")
    dists = distributions.fit_durations(data, distributions.KERNEL).localCheckpoint()
    summed, put = [], distributions.stored
    monkeypatch.setattr(distributions, "stored", lambda df: (summed.append(out.count()) if "_kernel_density" in (out := put(
        df)).columns else None, out)[1])
    found = distributions.with_density(data, dists, kernels=(bands, slots)).collect()
    assert len(found) == len(rows) and summed == [7 + 3]
    listed = {}
    for s in slots.collect():
        listed.setdefault(s["activity"], []).append((s["centre"], s["weight"]))
    wide = {r["activity"]: (r["n"], r["h"]) for r in bands.collect()}
    for r in found:
        n, h = wide[r["activity"]]
        if r["duration"] is None:
            assert r["density"] is None
        else:
            assert r["density"] == pytest.approx(sum(w * math.exp(-0.5 * ((r["duration"] - c) / h) ** 2) for c, w in listed[
                r["activity"]]) / (n * h * math.sqrt(2 * math.pi)))


def test_shapes_meet_on_their_order(spark, make_log, monkeypatch):
    """Cases with the same activities in another order are not compared."""
    from itertools import permutations
    from caseloom.operators import curves
    cases = {"".join(p): [(a, 100 * i) for i, a in enumerate(p)] for p in permutations("ABCD")}
    cases |= {"short": [("A", 0), ("B", 100), ("D", 300)], "other": [("A", 0), ("B", 100), ("D", 200), ("D", 300)]}
    compared, warped = [], curves._warped
    monkeypatch.setattr(curves, "_warped", lambda pairs, t: (compared.append(pairs.count()), warped(pairs, t))[1])
    found = {(r["left"], r["right"], r["distance"]) for r in curves.similar_cases(make_log(cases), 1).collect()}
    assert {x for x in found if x[2]} == {("ABCD", "short", 1), ("ACBD", "short", 1), ("other", "short", 1)}
    assert max(compared) <= 20  # 276 pairs share their bag


def test_curves_are_the_same_by_case_and_by_point(spark, make_log, tiny):
    """Cases that are gathered and cases that are told from ``active_points``; times may be missing or out of order."""
    from caseloom.operators import curves
    rng = random.Random(8)
    cases = {f"c{k:02d}": [(rng.choice("ABC"), rng.choice([0, 5, 10, 700, 1000])) for _ in range(rng.randint(1, 7))] for k in range(40)}
    log = make_log(cases).withColumn("ts", F.when(F.hash("case_id", "pos") % 5 != 0, F.col("ts")))
    log = log.union(make_log({"gone": [("A", 1)]}).withColumn("ts", F.lit(None).cast("timestamp")))
    one, two, mixed = ({(r["case_id"], str(r["sets"]), tuple(r["lengths"])) for r in c.collect()} for c in (
        curves.case_events(log), curves.curves_of_points(*windows.active_points(log)), curves.log_curves(log)))
    assert one == two == mixed and len(one) == 41
