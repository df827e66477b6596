"""Registered queries against DuckDB on the smallest tables."""

import pytest

SF = "/root/testdata/sf0.001"
CHECKED = [
    "P7_preprocess", "E6_detect_events", "F11_extract_features", "F10_pupil_load", "Q4_quality_cards", "G4_segment_between_markers",
    "A6_transition_matrix", "H4_smooth_density", "M2_asof_nearest", "T1_descriptive_table", "T6_rm_anova", "B4_anomaly_hypothesis",
    "L4_classification_metrics", "S3_stream_quality", "N6_read_eyelink_asc",
]


@pytest.fixture(scope="module")
def con():
    from oracle import connect

    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    import __spark_entry__ as entry
    from oracle import compare

    problem, rows, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None and rows > 0


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_exchange_for_events(spark):
    """Velocity, runs and the event table share the exchange on the recording."""
    from saccadia.operators import events
    from saccadia.plans.gaze_view import samples

    plan = events.detect_events(samples(spark, SF), "thresholds")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
