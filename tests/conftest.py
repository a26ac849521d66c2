import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from caseloom.session import local_session
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def tiny(spark):
    """Slices of three rows, so that every sliced path is taken."""
    spark.conf.set("spark.caseloom.sliceRows", "3")
    spark.conf.set("spark.caseloom.hotRows", "3")
    spark.conf.set("spark.caseloom.cellRows", "100")
    yield spark
    spark.conf.unset("spark.caseloom.sliceRows")
    spark.conf.unset("spark.caseloom.hotRows")
    spark.conf.unset("spark.caseloom.cellRows")


@pytest.fixture
def make_log(spark):
    """Event table from {case: [(activity, ms), ...]}."""
    def build(cases, **columns):
        rows = [(case, i + 1, name, ms) for case, events in cases.items() for i, (name, ms) in enumerate(events)]
        df = spark.createDataFrame(rows, "case_id string, pos bigint, activity string, ms bigint")
        return df.selectExpr("case_id", "pos", "activity", "timestamp_millis(ms) AS ts")
    return build
