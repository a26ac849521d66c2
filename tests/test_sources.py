"""Reading and writing logs and exports."""

import gzip
import json

from pyspark.sql import functions as F

from caseloom.operators import windows
from caseloom.sources import sinks, xes

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0">
  <string key="concept:name" value="demo"/>
  <trace>
    <string key="concept:name" value="c1"/>
    <float key="simulated:logProbability" value="-1.5"/>
    <event>
      <string key="concept:name" value="check in"/>
      <string key="concept:instance" value="i1"/>
      <boolean key="concept:simulated" value="true"/>
      <string key="lifecycle:transition" value="complete"/>
      <date key="time:timestamp" value="2021-03-04T09:15:30.250+01:00"/>
    </event>
    <event>
      <string key="concept:name" value="sign"/>
      <date key="time:timestamp" value="2021-03-04T09:20:30.250+01:00"/>
      <string key="org:resource" value="Kim"/>
      <int key="cost" value="12"/>
    </event>
  </trace>
  <trace>
    <string key="concept:name" value="c2"/>
    <event><string key="concept:name" value="check in"/><date key="time:timestamp" value="2021-03-05T00:00:00.000+01:00"/></event>
  </trace>
</log>
"""


def test_read_xes_plain_and_gzip(spark, tmp_path):
    (tmp_path / "one.xes").write_text(XES)
    with gzip.open(tmp_path / "two.xes.gz", "wt") as f:
        f.write(XES.replace('"c1"', '"c3"').replace('"c2"', '"c4"'))
    log = xes.read_xes(spark, str(tmp_path))
    rows = {(r["case_id"], r["pos"]): r for r in log.withColumn("ms", F.unix_millis("ts")).collect()}
    assert sorted(rows) == [("c1", 1), ("c1", 2), ("c2", 1), ("c3", 1), ("c3", 2), ("c4", 1)]
    first, second = rows["c1", 1], rows["c1", 2]
    assert (first["activity"], first["lifecycle"], first["instance"], first["ms"]) == ("check in", "complete", "i1", 1614845730250)
    assert first["attrs"] == {"concept:simulated": "true"}
    assert (second["resource"], second["lifecycle"], second["attrs"]) == ("Kim", None, {"cost": "12"})
    about = {(r["case_id"], r["key"]): r["value"] for r in xes.read_xes_cases(spark, str(tmp_path)).collect()}
    assert about["c1", "simulated:logProbability"] == "-1.5"


def test_xes_round_trip_with_long_cases(spark, make_log, tmp_path, monkeypatch):
    monkeypatch.setattr(xes, "TRACE_ROWS", 2)
    log = make_log({"a": [("x", 1000), ("y", 2000), ("x", 2000), ("z & <q>", 9000), ("x", 12345)], "b": [("y", 5)]})
    log = log.withColumns({"lifecycle": F.lit("complete"), "instance": F.lit(None).cast("string"), "resource": F.lit("Kim"),
                           "attrs": F.create_map(F.lit("k"), F.col("pos").cast("string"))})
    xes.write_xes(log, str(tmp_path / "out"))
    back = xes.read_xes(spark, str(tmp_path / "out")).select(*log.columns)
    key = ["case_id", "pos"]
    assert list(map(tuple, back.orderBy(*key).collect())) == list(map(tuple, log.orderBy(*key).collect()))


def test_training_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1.5, 3, 1000), ("A", 2.0, 4, 2000), ("B c", 0.25, 1, 3000)],
                                 "activity string, duration double, system_load bigint, ms bigint").selectExpr(
        "activity", "duration", "system_load", "timestamp_millis(ms) AS ts")
    sinks.write_training(rows, str(tmp_path / "t"))
    back = sinks.read_training(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_exports(spark, make_log, tmp_path):
    log = make_log({"1": [("a", 0), ("b", 40), ("a", 100)], "2": [("b", 7)]})
    sinks.write_duration_matrix(sinks.duration_matrix(log, ["a", "b"]), str(tmp_path / "m"))
    lines = sorted(line for p in (tmp_path / "m").glob("*.csv") for line in p.read_text().split())
    assert set(lines) == {"CaseId;a;b", "1;60;40", "2;NaN;0"}

    scores = spark.createDataFrame([("1", -2.5, 100, 2)], "case_id string, log_likelihood double, case_duration bigint, n_choices int")
    choices = spark.createDataFrame([("1", 1, "a", 0.5), ("1", 2, "b", 0.25)], "case_id string, pos int, activity string, probability double")
    sinks.write_likelihoods(scores, str(tmp_path / "l"), choices)
    text = "".join(p.read_text() for p in (tmp_path / "l" / "cases").glob("*.csv"))
    assert "case_id;log_likelihood" in text and "1;-2.5;100;2" in text
    assert "1;2;b;0.25" in "".join(p.read_text() for p in (tmp_path / "l" / "choices").glob("*.csv"))

    predictions = spark.createDataFrame([(1, "naive", 2.0, 0.5, 3.0)],
                                        "numCase int, method string, prediction double, confidence_interval double, real_duration double")
    sinks.write_predictions(predictions, str(tmp_path / "p"))
    back = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert back.columns == sinks.PREDICTION_COLUMNS and back.first()["method"] == "naive"

    sinks.write_entropy_curve(windows.running_entropy(log), str(tmp_path / "e"))
    curve = spark.read.option("header", True).csv(str(tmp_path / "e"))
    assert curve.columns == sinks.ENTROPY_COLUMNS and curve.count() == 2


def test_intervals_json(spark):
    rows = spark.createDataFrame([("A", float("-inf"), 2.0), ("A", 8.0, 9.0)], "activity string, lower double, upper double")
    doc = json.loads(sinks.intervals_json(rows, "net", 0.01).first()["json"])
    assert doc["label"] == "net" and doc["activities"][0]["intervals"][1] == {"lower": 8.0, "upper": 9.0}
