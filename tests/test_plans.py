"""The shared shapes: slices, ranks and joins with models, on every path."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import graph, remaining, temporal, windows
from caseloom.plans.models import join_model, split_join
from caseloom.plans.ranks import clamped_percentile, order_statistics, value_ranks
from caseloom.plans.slices import neighbours, positions, running, running_dense


@pytest.fixture
def rows(spark):
    """One key holds more than half of all rows; many values are equal."""
    rng = random.Random(6)
    data = [("hot" if i % 5 < 3 else f"k{i % 7}", i, rng.choice([0, 0, 1, 5, rng.randint(-50, 50)])) for i in range(300)]
    return data, spark.createDataFrame(data, "k string, t bigint, v bigint")


def test_positions_neighbours_and_running(tiny, rows):
    data, df = rows
    placed = positions(df, ["k"], ["t"], "pos")
    out = running_dense(placed, ["k"], "pos", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")),
                                               "x": ("xor", F.col("t")), "l": ("last", F.when(F.col("v") > 3, F.col("t")))})
    out = neighbours(out, ["k"], "pos", {"back": ("t", 2), "ahead": ("t", -1)})
    out = running(out.withColumn("_b", F.expr("t div 7")), ["k"], ["_b"], ["t"], {"before": ("sum", F.col("v"))},
                  exclusive=True, overall={"all": ("sum", F.col("v"))})
    found = {(r["k"], r["t"]): r for r in out.collect()}
    assert len(found) == len(data)
    for key in {k for k, *_ in data}:
        mine = [(t, v) for k, t, v in data if k == key]
        s = x = 0
        last = None
        for i, (t, v) in enumerate(mine):
            r = found[key, t]
            assert r["before"] == s and r["all"] == sum(v for _, v in mine)
            s, x, last = s + v, x ^ t, t if v > 3 else last
            assert (r["pos"], r["s"], r["x"], r["l"]) == (i + 1, s, x, last)
            assert r["m"] == max(v for _, v in mine[:i + 1])
            assert r["back"] == (mine[i - 2][0] if i >= 2 else None)
            assert r["ahead"] == (mine[i + 1][0] if i + 1 < len(mine) else None)


def test_order_statistics_and_percentiles(tiny, rows):
    data, df = rows
    ranks = value_ranks(df, ["k"], "v")
    picked = {r["k"]: r for r in order_statistics(ranks, ["k"], "v", {"mid": F.floor(F.col("total") / 2)}).collect()}
    bounds = {r["k"]: r for r in clamped_percentile(ranks, ["k"], "v", {"p5": 5.0, "p95": 95.0}).collect()}
    for key in {k for k, *_ in data}:
        values = sorted(v for k, _, v in data if k == key)
        n = len(values)
        assert picked[key]["total"] == n and picked[key]["mid"] == values[n // 2]
        for p, name in ((5, "p5"), (95, "p95")):
            place = p * (n + 1) / 100
            low = int(place)
            want = values[0] if place < 1 else values[-1] if place >= n else (
                values[low - 1] + (place - low) * (values[low] - values[low - 1]))
            assert bounds[key][name] == pytest.approx(want)


def test_model_joins_agree_on_every_path(tiny, rows):
    data, df = rows
    df = df.withColumn("attrs", F.create_map(F.lit("a"), F.col("k")))
    model = df.where("k <> 'k1'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    expected = sorted((r["t"], r["n"]) for r in df.drop("attrs").join(model, "k", "left").collect() if r["n"] is not None)
    for how in ("inner", "left"):
        for limit in (0, 1000):
            got = join_model(df, model, ["k"], how, max_rows=limit).drop("attrs").collect()
            assert sorted((r["t"], r["n"]) for r in got if r["n"] is not None) == expected
            assert len(got) == (len(data) if how == "left" else len(expected))
        got = split_join(df.drop("attrs"), model, ["k"], "n", how).collect()
        assert sorted((r["t"], r["n"]) for r in got if r["n"] is not None) == expected
        assert len(got) == (len(data) if how == "left" else len(expected))


@pytest.fixture
def thousand(spark):
    """At most a thousand rows in one piece."""
    spark.conf.set("spark.caseloom.hotRows", "1000")
    yield spark
    spark.conf.unset("spark.caseloom.hotRows")


def largest_cell(rows, order):
    from caseloom.plans.slices import cells
    sizes = [r["count"] for r in cells(rows, order).groupBy("_cell").count().collect()]
    return max(sizes), len(sizes)


def test_narrow_values_are_spread(thousand):
    """200,000 scores within 0.0001 of each other, all of one key."""
    scores = thousand.range(200_000).select(F.lit("k").alias("k"), (0.5 + F.col("id") / 2e9).alias("v"))
    most, n = largest_cell(scores, ["k", "v"])
    assert most <= 1000 and n >= 200
    ranks = value_ranks(scores, ["k"], "v")
    assert ranks.agg(F.count("*"), F.min("total"), F.max("total"), F.sum("upto")).first() == (
        200_000, 200_000, 200_000, 200_000 * 200_001 // 2)
    wrong = ranks.where(F.round((F.col("v") - 0.5) * 2e9) != F.col("upto") - 1)
    assert wrong.count() == 0


def test_one_time_is_spread(thousand):
    """A log whose events all bear the same day."""
    from caseloom.operators import forecast, joins, windows
    from caseloom.operators.filters import sort_cases
    day = F.timestamp_seconds(F.lit(1_500_000_000))
    log = thousand.range(20_000).select(F.format_string("c%05d", F.col("id") % 4000).alias("case_id"),
                                        (F.col("id") / 4000).cast("bigint").alias("n"), day.alias("ts"))
    log = log.select("case_id", (F.col("n") + 1).alias("pos"), F.concat(F.lit("a"), "n").alias("activity"), "ts")
    for order in (["ts", "case_id"], ["ts", "case_id", "pos"]):
        most, n = largest_cell(log, order)
        assert most <= 1000 and n >= 20
    numbered = sort_cases(log)
    assert numbered.where(F.format_string("c%05d", F.col("case_index") - 1) != F.col("case_id")).count() == 0
    # with equal times, cases follow one another
    assert {r["load"] for r in windows.active_case_load(log).select("load").distinct().collect()} == {1}
    training = log.select(F.lit("k").alias("k"), "ts", "case_id", "pos")
    probes = thousand.range(3000).select(F.lit("k").alias("k"), F.timestamp_seconds(1_499_999_999 + F.col("id") % 3).alias("ts"),
                                         "id")
    seen = joins.last_observation(training, probes, ["k"], "case_id", ["case_id", "pos"])
    assert {(r["m"], r["observed"]) for r in seen.select((F.col("id") % 3).alias("m"), "observed").distinct().collect()} == {
        (0, None), (1, None), (2, "c03999")}
    fit = forecast.rolling_fit(training, probes, ["k"], "pos").select((F.col("id") % 3).alias("m"), "n", "mean").distinct()
    assert {tuple(r) for r in fit.collect()} == {(0, 0, None), (1, 0, None), (2, 20_000, 3.0)}
    entropy = windows.running_entropy(log).orderBy(F.desc("sample_count")).first()
    assert entropy["sample_count"] == 4000 and abs(entropy["sample_entropy"]) < 1e-9


def test_numbering_reads_its_input_at_most_twice(spark, tmp_path):
    from caseloom.sources.logs import as_log
    path = str(tmp_path / "events")
    spark.range(100).select((F.col("id") % 5).alias("u"), F.lit("a").alias("a"), F.timestamp_seconds("id").alias("ts"),
                            "id").write.parquet(path)
    plan = as_log(spark.read.parquet(path), "u", "a", "ts", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def shuffled_rows(spark, job) -> int:
    """Rows written in shuffles while ``job`` runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages, n = store.stageList(None, False, False, none, None).iterator(), 0
        while stages.hasNext():
            n += stages.next().shuffleWriteRecords()
        return n

    before = total()
    job()
    return total() - before


def test_path_distances_do_not_shuffle_the_edges(spark):
    """A source that reaches few nodes leaves all other edges where they are."""
    n = 5000
    edges = spark.range(n).selectExpr("concat('n', id) AS src", "concat('m', id % 1000) AS dst", "double(id % 7) AS weight")
    edges = edges.unionByName(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("b", "c", 5.0)], edges.schema))
    for longest, far in ((False, 3.0), (True, 6.0)):
        found = {}
        rows = shuffled_rows(spark, lambda: found.update(graph.path_distances(edges, "a", longest).collect()))
        assert found == {"a": 0.0, "b": 1.0, "c": far}
        assert rows < n / 10


def test_distances_from_relax_no_ends(spark):
    """Pairs whose node no edge leaves are not joined with the edges again: each edge is relaxed at most once here."""
    n = 5000
    first = spark.range(n).selectExpr("concat('c', id % 50) AS src", "concat('o', id) AS dst", "double(id % 7) AS weight")
    second = spark.range(n).selectExpr("concat('o', id) AS src", "concat('s', id % 100) AS dst", "double(id % 3) AS weight")
    sources = spark.range(50).selectExpr("concat('c', id) AS source")
    found = {}
    rows = shuffled_rows(spark, lambda: found.update(
        {(r[0], r[1]): r[2] for r in graph.distances_from(first.unionByName(second), sources).collect()}))
    best = {}
    for i in range(n):
        key = (f"c{i % 50}", f"s{i % 100}")
        best[key] = min(best.get(key, 99.0), float(i % 7 + i % 3))
    assert {k: v for k, v in found.items() if k[1].startswith("s")} == best
    assert len(found) == 50 + n + len(best)
    assert rows < 4 * n


def test_pairwise_gaps_shuffle_each_event_once(spark, make_log):
    """Events are repeated per activity of their case after the shuffle, not before."""
    log = make_log({f"{c}": [("abcd"[(c + i) % 4], 1000 * i) for i in range(8)] for c in range(500)})
    found = {}
    rows = shuffled_rows(spark, lambda: found.update({(r[0], r[1]): r for r in temporal.pairwise_gaps(log).collect()}))
    assert sum(r["n"] for r in found.values()) == 500 * (8 * 7 / 2 + 8)
    assert rows < 2 * 4000


def test_pairwise_gaps_with_an_activity_named_as_the_start(make_log):
    log = make_log({"x": [("a", 0), ("_Start", 60_000), ("a", 180_000)], "y": [("_Start", 0)]})
    found = {(r["before"], r["after"]): (r["n"], r["mean"], r["mean_distance"]) for r in temporal.pairwise_gaps(log).collect()}
    assert found == {("a", "_Start"): (1, 1.0, 1.0), ("a", "a"): (1, 3.0, 2.0), ("_Start", "a"): (3, 5 / 3, 1.0),
                     ("_Start", "_Start"): (2, 0.5, 1.0)}


def test_active_case_load_of_whole_cases(spark, make_log):
    """Cases that fit into a window give the same load with fewer rows shuffled."""
    log = make_log({f"{c}": [("a", 7 * c + 1000 * i) for i in range(4)] for c in range(300)})
    log = log.repartition(4).localCheckpoint()
    loads, rows = [{}, {}], []
    for whole in (False, True):
        rows.append(shuffled_rows(spark, lambda: loads[whole].update({(r.case_id, r.pos): r.load for r in windows.active_case_load(
            log, whole).collect()})))
    assert loads[0] == loads[1] and len(loads[0]) == 1200
    assert rows[1] < rows[0]


def test_subset_study_meets_each_case_once(spark):
    """Figures of a case are taken in one pass (48,719 rows were shuffled when each user of them grouped the events)."""
    log = spark.range(4000).selectExpr(
        "concat('c', id div 5) AS case_id", "id % 5 + 1 AS pos", "substr('abcde', int(id * 7 % 5) + 1, 1) AS activity",
        "timestamp_millis(id * 1000 + id % 7) AS ts").localCheckpoint()
    rows = shuffled_rows(spark, lambda: remaining.subset_study(log, ["a"], ["b", "c", "d"], 1, 3, 4).collect())
    assert rows < 40_000
