"""Registered queries next to DuckDB on sf0.001, with slices of three rows."""

import os

import pytest
from compare import DATA, connect, difference

from caseloom.catalog import COVERS, QUERIES, SQL

FOLDER = str(DATA / "sf0.001")
# one or two queries per operator family; CASELOOM_ALL=1 runs every query
SAMPLE = """events_as_log reduplicate reorder_by_time most_frequent_variant kfold_in prefix_until variants
running_entropy sample_rank duration_stats directly_follows pairwise_gaps_shipments durations_excluding roc_curve
hourly_medians fit_classification density_histogram outlier_steps p_values_empirical error_posterior kernel_density
activity_intervals last_observation resource_movements case_jaccard censored_enabling_memory quantile_entropy
prefix_automaton bounded_history last_season forecast_average remaining_by_bag compare_predictors longest_paths
stream_event_gaps xes_round_trip measurement_error_test_exponential add_noise accurate_noise injected_errors weighted_pick
conditional_expectation_normal convert_histogram delivery_paths case_table filter_classes""".split()
NAMES = sorted(SQL) if os.environ.get("CASELOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(tiny, con, name):
    assert difference(QUERIES[name](tiny, FOLDER).toPandas(), con.execute(SQL[name]).df()) is None


def test_registry_covers_the_inventory():
    covered = {c for v in COVERS.values() for c in v.split(",")}
    wanted = {f"{k}{i}" for k, n in {"S": 8, "F": 21, "J": 11, "A": 34, "W": 11, "O": 5, "L": 12, "T": 10, "R": 8, "G": 2,
                                     "K": 1, "U": 6, "ST": 7}.items() for i in range(1, n + 1)}
    assert wanted - covered == set()
    assert set(SQL) <= set(QUERIES)
