"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from skytally.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tables, duck, same, name):
    same(registry.queries()[name](spark, tables), duck, registry.oracle_sql()[name])


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_panel_is_dealt_by_key_and_block(spark, tables):
    """Percentiles are dealt by function and block, windows by function; nothing goes to a single task."""
    from skytally.operators import detectors
    from skytally.sources.telemetry import load

    plan = detectors.votes(load(spark, tables))._jdf.queryExecution().executedPlan().toString()
    dealt = {",".join(x.split("#")[0].strip() for x in line.split("hashpartitioning(")[1].split(", ")[:2]) for line in plan.split("\n") if "Exchange hashpartitioning(" in line}
    assert any(d.startswith("function_id,_block") for d in dealt) and any(d.startswith("function_id,_slot") for d in dealt)
    assert "SinglePartition" not in plan
