"""The store holds the decisions over the panel's scores."""

from skytally.operators import decisions
from skytally.plans import registry


def test_store_is_decided_from_the_panel(spark, tables, duck, same):
    same(registry.queries()["stored_detections"](spark, tables), duck, decisions.DECIDED_SQL)


def test_store_queries_see_the_panel(spark, tables, duck):
    """The best scores by function are those of the decisions with the panel."""
    rows = registry.queries()["top_decisions"](spark, tables).where("rank = 1").collect()
    best = dict(duck.sql(f"SELECT function_id, max(fused_score) FROM ({decisions.DECIDED_SQL}) GROUP BY 1").fetchall())
    assert {r.function_id: r.fused_score for r in rows} == best
