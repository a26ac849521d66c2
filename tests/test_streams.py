"""Streams over several files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from caseloom.streaming import operators as st
from caseloom.streaming.run import append_to_folder, append_to_table, events_stream, updates_to_table

HOUR = 3_600_000


@pytest.fixture
def folder(spark, tmp_path):
    """Four files in time order; each also holds rows up to 20 minutes late."""
    rows = [(i, i * 11 * 60_000 - (20 * 60_000 if i % 7 == 3 else 0), i % 3, ["a", "b"][i % 2], float(i % 13)) for i in range(2, 202)]
    for part in range(4):
        mine = rows[part * 50:(part + 1) * 50]
        df = spark.createDataFrame(mine, "event_id bigint, ms bigint, user_id bigint, event_type string, value double")
        df.selectExpr("event_id", "CAST(timestamp_millis(ms) AS timestamp_ntz) AS ts", "user_id", "event_type", "value"
                      ).coalesce(1).write.parquet(str(tmp_path / f"w{part}"))
        source = next((tmp_path / f"w{part}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"events-{part}.parquet").write_bytes(source.read_bytes())
    return str(tmp_path / "in"), rows


def stream(spark, folder):
    return events_stream(spark, folder, "events-*.parquet")


def test_hourly_counts_match_batch(spark, folder):
    path, rows = folder
    out = append_to_table(st.hourly_activity(stream(spark, path)))
    found = {(r["activity"], r["s"]): r["n"] for r in out.withColumn("s", F.unix_millis("start")).collect()}
    mark = max(ms for _, ms, *_ in rows) - HOUR
    expected = {}
    for _, ms, _, kind, _ in rows:
        if (ms // HOUR + 1) * HOUR <= mark:
            expected[kind, ms // HOUR * HOUR] = expected.get((kind, ms // HOUR * HOUR), 0) + 1
    assert found == expected


def test_running_normal_keeps_the_latest_state(spark, folder):
    path, rows = folder
    out = {r["activity"]: r for r in updates_to_table(st.running_normal(stream(spark, path)), ["activity"]).collect()}
    for kind in ("a", "b"):
        values = [v for *_, k, v in rows if k == kind]
        assert out[kind]["n"] == len(values) and out[kind]["mean"] == pytest.approx(sum(values) / len(values))


def test_event_gaps_order_late_events(spark, folder):
    path, rows = folder
    out = {r["event_id"]: r["gap_ms"] for r in append_to_table(st.event_gaps(stream(spark, path))).collect()}
    mark = max(ms for _, ms, *_ in rows) - HOUR
    cases, expected = {}, {}
    for event, ms, user, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (user, ms // 86_400_000)
        if ms < mark:
            expected[event] = ms - cases[key] if key in cases else 0
        cases[key] = ms
    assert out == expected


def test_rolling_forecast_bounds_its_history(spark, folder):
    path, _ = folder
    counts = st.hourly_activity(stream(spark, path)).select("activity", F.col("start").alias("at"), "n")
    hours = spark.readStream.schema(counts.schema).parquet(append_to_folder(counts))
    out = append_to_table(st.rolling_forecast(hours, history=5)).collect()
    assert out and max(r["history"] for r in out) == 5
    assert all(r["naive"] == r["n"] for r in out)


def test_rolling_forecast_takes_late_hours_into_their_place(spark, tmp_path):
    """Hours in files of reverse order, one file a batch: the last row of an hour is that of hours in order."""
    counts = [(0, 10), (1, 14), (3, 30), (5, 50), (6, 60), (9, 12)]
    results = {}
    for name, order in (("forth", counts), ("back", counts[::-1])):
        for k, (hour, n) in enumerate(order):
            one = spark.createDataFrame([("a", hour * 3600, n)], "activity string, s bigint, n bigint").select(
                "activity", F.timestamp_seconds("s").alias("at"), "n")
            one.coalesce(1).write.parquet(str(tmp_path / name / f"{k}"))
        files = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
        rows = append_to_table(st.rolling_forecast(files, history=4).withColumn("sent", F.current_timestamp())).collect()
        last = {}
        for r in sorted(rows, key=lambda r: r["sent"]):
            last[r["at"].timestamp()] = (r["n"], r["naive"], r["drift"], r["history"])
        results[name] = list(last[t] for t in sorted(last))
    assert results["forth"] == results["back"]
    # after hour 6: hours 3 to 6 are in reach, the drift is (60 - 30) / 3
    assert results["back"][4] == (60, 60.0, 70.0, 3)


def test_streams_read_tables_that_are_folders(spark, folder, tmp_path):
    path, rows = folder
    spark.read.parquet(f"{path}/events-*.parquet").repartition(3).write.parquet(str(tmp_path / "t" / "events.parquet"))
    spark.read.parquet(f"{path}/events-*.parquet").coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "events.parquet").write_bytes(next((tmp_path / "one").glob("part-*.parquet")).read_bytes())
    for place in ("t", "f"):
        out = updates_to_table(st.running_normal(events_stream(spark, str(tmp_path / place))), ["activity"])
        assert sum(r["n"] for r in out.collect()) == len(rows)


def test_event_gaps_order_by_microsecond(spark, tmp_path):
    # two events of one millisecond, the later one with the smaller number; a last one closes the windows
    rows = [(5, 1_000_000_100), (2, 1_000_000_900), (3, 1_000_500_000), (9, 40_000_000_000_000)]
    df = spark.createDataFrame(rows, "event_id bigint, us bigint").selectExpr(
        "event_id", "CAST(timestamp_micros(us) AS timestamp_ntz) AS ts", "IF(event_id = 9, 2L, 1L) AS user_id",
        "'a' AS event_type", "1D AS value")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    out = append_to_table(st.event_gaps(events_stream(spark, str(tmp_path))))
    assert {r["event_id"]: (r["ms"], r["gap_ms"]) for r in out.collect()} == {
        5: (1_000_000, 0), 2: (1_000_000, 0), 3: (1_000_500, 500)}


def test_event_gaps_keep_one_state_per_bucket(spark, tmp_path):
    """Cases of a bucket share a state, which drops the cases to forget."""
    minute = 60_000
    parts = [[(k, k % 40, minute + k * minute // 40) for k in range(80)], [(100, 3, 300 * minute), (101, 41, 301 * minute)],
             [(200, 3, 310 * minute)], [(300, 99, 600 * minute)]]
    (tmp_path / "in").mkdir()
    for n, mine in enumerate(parts):
        spark.createDataFrame(mine, "event_id bigint, user_id bigint, ms bigint").selectExpr(
            "event_id", "CAST(timestamp_millis(ms) AS timestamp_ntz) AS ts", "user_id", "'a' AS event_type", "1.0D AS value"
        ).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        source = next((tmp_path / f"w{n}").glob("part-*.parquet"))
        (tmp_path / "in" / f"events-{n}.parquet").write_bytes(source.read_bytes())

    def gaps(**more):
        rows = st.event_gaps(stream(spark, str(tmp_path / "in")), buckets=4, **more)
        place = str(tmp_path / f"state{len(more)}")
        query = rows.writeStream.format("memory").queryName(f"gaps{len(more)}").outputMode("append").option(
            "checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert 0 < max(states) <= 4
        return {r["event_id"]: r["gap_ms"] for r in spark.table(f"gaps{len(more)}").collect()}

    kept, forgot = gaps(), gaps(forget_ms=60 * minute)
    assert kept == {k: minute if k >= 40 else 0 for k in range(80)} | {100: 299 * minute - 43 * minute // 40, 101: 0, 200: 10 * minute}
    assert forgot[200] == 10 * minute and forgot[101] == 0 and forgot[79] == minute
