"""Plans whose work grows with the rows alone."""

import re

from skytally.operators import detectors
from skytally.plans import registry
from skytally.sources.telemetry import load


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_in_time_only_grow(spark, tables):
    """A frame with both ends on the move is read anew for each row."""
    for df in (detectors.votes(load(spark, tables)), registry.stored(spark, tables)):
        plan = plan_of(df)
        assert "RangeFrame, unboundedpreceding" in plan
        assert not re.search(r"RangeFrame, -\d+", plan)


def test_store_runs_what_the_matrix_reads(spark, tables):
    plan = plan_of(registry.stored(spark, tables))
    assert "MapInArrow" not in plan and "duration_p99" not in plan


def test_store_is_dealt_once(spark, tables):
    """Prefixes of the history and chains are frames along the same rows: no join, and one deal by function whatever the steps."""
    plan = plan_of(registry.stored(spark, tables))
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
