"""Small tables with known answers for the operators over time, curves and records."""

import pytest

from skytally.operators import curves, records, timelines

SCHEMA = "event_id long, t_us long, function_id string, phase string, anomaly_type string, duration double, memory double, cpu double, network double, truth boolean"


def rows(spark, outcomes, gap_us=1_000_000):
    made = [(k, k * gap_us, "f", "error" if bad else "invoke", "execution_failure" if bad else "benign", 1.0 + k, 100.0 * k * k, 5.0, 7.0, bad) for k, bad in enumerate(outcomes)]
    return spark.createDataFrame(made, SCHEMA)


def test_channel_keeps_its_state_between_bounds(spark):
    outcomes = [False, True, False, True, True, False, False, True, False, False, False]
    row = timelines.run(timelines.CHANNELS, rows(spark, outcomes)).first()
    assert (row.n_down, row.failovers, row.recoveries, row.down_at_end) == (6, 1, 1, False)


def test_buffer_sheds_beyond_its_cap(spark):
    row = timelines.run(timelines.BUFFER, rows(spark, [False] * 7)).first()
    assert (row.n, row.shed, row.level) == (7, 3, "critical")


def test_majority_ties_go_to_the_first_seen(spark):
    row = timelines.run(timelines.MAJORITY, rows(spark, [True, False])).first()
    assert (row.phase, row.n, row.agreement) == ("error", 1, 0.5)


def test_areas_of_a_perfect_score(spark):
    scored = spark.createDataFrame([(k, 0.9 if k < 5 else 0.1, k < 5) for k in range(10)], "event_id long, score double, truth boolean")
    row = curves.run(curves.AREAS, scored).first()
    assert (row.average_precision, row.roc_area) == (1.0, 1.0)


@pytest.mark.parametrize("text", [timelines.TREND, timelines.CHANNELS, timelines.OVERLAPS, timelines.METRICS, curves.LATENCY, curves.LOSS, curves.LINKS, curves.ENVELOPE, records.EMISSION, records.REDACTED, records.MAPPED, records.CONSENT])
def test_empty_tables_give_no_rows(spark, text):
    assert curves.run(text, spark.createDataFrame([], SCHEMA)).count() == 0


def test_nulls_pass(spark):
    blank = spark.createDataFrame([(1,) + (None,) * 9], SCHEMA)
    for text in (records.EMISSION, records.REDACTED, records.MAPPED, records.CONSENT, timelines.METRICS, timelines.CHANNELS):
        curves.run(text, blank).collect()
