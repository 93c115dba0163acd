"""Pages over small tables: windows, lists, details, bulk actions, exports and the audit trail."""

import csv
from pathlib import Path

import pytest

from skytally.operators import views

_STORE = "event_id long, function_id string, t_us long, decision string, anomaly_type string, fused_score double, band string, techniques string"
_HELD = "event_id long, case_id string, status string"


def store_of(spark, rows):
    return spark.createDataFrame(rows, _STORE)


def test_windows_and_bins():
    assert views.window_of(now_us=10 * views.DAY) == (3 * views.DAY, 10 * views.DAY)
    assert views.window_of("24h", now_us=views.DAY) == (0, views.DAY)
    assert views.window_of("custom", now_us=0, since_us=5, until_us=6) == (5, 6)
    assert views.window_of("custom", now_us=0, since_us=0, until_us=views.LONGEST) == (0, views.LONGEST)
    assert [views.bin_of(d * views.DAY) for d in (1, 2, 7, 8, 30, 31, 90)] == ["1h", "6h", "6h", "1d", "1d", "3d", "3d"]


@pytest.mark.parametrize("spec, since, until", [("2h", None, None), ("custom", None, 5), ("custom", 5, 5), ("custom", 6, 5), ("custom", 0, views.LONGEST + 1)])
def test_bad_windows(spec, since, until):
    with pytest.raises(ValueError):
        views.window_of(spec, now_us=0, since_us=since, until_us=until)


def test_function_page(spark):
    now = 20 * views.DAY
    rows = [
        (1, "a", now - 1, "review", "x", 0.5, "medium", "T1,T2"), (2, "a", now - 2 * views.DAY, "escalate", "x", 0.9, "high", "T2"), (3, "b", now - 8 * views.DAY, "observe", "x", 0.1, "low", ""),
        (4, "c", now - 1, "review", "x", 0.5, "medium", "T3"), (5, None, now - 3, "review", "x", 0.5, "medium", "T1"),
    ]
    held = spark.createDataFrame([(1, "k1", "open"), (2, "k2", "closed"), (3, "k3", "triage"), (4, "k3", "triage")], _HELD)
    page = views.function_page(store_of(spark, rows), held, now_us=now).collect()
    assert [(r.function_id, r.n_day, r.n_week, r.worst, r.n_open_cases, r.top_techniques, r.total) for r in page] == [
        ("a", 1, 2, "escalate", 1, "T2,T1", 4), ("c", 1, 1, "review", 1, "T3", 4), (None, 1, 1, "review", 0, "T1", 4), ("b", 0, 0, "observe", 1, "", 4),
    ]
    page = views.function_page(store_of(spark, rows), held, now_us=now, decision="review", technique="T1", sort="count_7d_desc", limit=1, offset=1).collect()
    assert [(r.function_id, r.total) for r in page] == [(None, 2)]
    with pytest.raises(ValueError):
        views.function_page(store_of(spark, rows), held, now_us=now, sort="name")
    assert views.function_page(store_of(spark, []), held, now_us=now).count() == 0


def test_function_detail(spark):
    rows = [(i, "a", 100 + i // 2, "review" if i % 2 else "observe", "x", 0.5, "medium", f"T{i % 7}") for i in range(50)] + [(90, "a", 99, "escalate", "x", 1.0, "high", "T9"), (91, None, 101, "review", "x", 0.5, "medium", "T1")]
    held = spark.createDataFrame([(3, "k1", "open"), (4, "k1", "open"), (90, "k0", "triage"), (5, "k2", "closed")], _HELD)
    (row,) = views.function_detail(store_of(spark, rows), held, since_us=100, until_us=125).collect()
    assert (row.function_id, row.observe, row.review, row.escalate) == ("a", 25, 25, 0)
    assert [(t.technique, t.n) for t in row.techniques] == [("T0", 8), ("T1", 7), ("T2", 7), ("T3", 7), ("T4", 7)]
    assert [r.event_id for r in row.recent] == list(range(49, 29, -1))
    assert [(b.bin, b.n, b.worst) for b in row.line] == [(0, 50, "review")]
    assert [(c.case_id, c.status) for c in row.cases] == [("k0", "triage"), ("k1", "open")]
    assert views.function_detail(store_of(spark, rows), held, since_us=0, until_us=99, function_id="a").count() == 0
    (bare,) = views.function_detail(store_of(spark, [(1, "b", 5, "observe", "x", 0.1, "low", "")]), held.limit(0), since_us=0, until_us=9, function_id="b").collect()
    assert bare.techniques == [] and bare.cases == [] and len(bare.recent) == 1


def test_bulk_actions(spark):
    picked = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "event_id long")
    held = spark.createDataFrame([(1, "k1"), (2, "k2"), (9, "k1")], "event_id long, case_id string")
    told = lambda action, rows=picked, **more: sorted(((r.event_id, r.case_id, r.ok, r.error) for r in views.bulk_action(rows, held, action, **more).collect()), key=lambda r: (r[0] is None, r[0]))
    assert told("attach", case_id="k1") == [(1, None, False, "duplicate"), (2, None, False, "already_attached"), (3, "k1", True, None), (None, None, False, "not_found")]
    assert told("assign") == [(1, "k1", True, None), (2, "k2", True, None), (3, None, False, "no_case_attached"), (None, None, False, "not_found")]
    assert told("dismiss")[:3] == [(1, "k1", True, None), (2, "k2", True, None), (3, None, True, None)]
    free = spark.createDataFrame([(3,), (4,)], "event_id long")
    assert told("open_case", free, case_id="new") == [(3, "new", True, None), (4, "new", True, None)]
    mixed = spark.createDataFrame([(3,), (2,)], "event_id long")
    assert told("open_case", mixed, case_id="new") == [(2, None, False, "already_attached"), (3, None, False, "not_opened")]
    for action, more in (("close", {}), ("attach", {}), ("attach", {"case_id": "k", "taken": False})):
        with pytest.raises(ValueError):
            views.bulk_action(picked, held, action, **more)


def test_export_is_read_by_others(spark, tmp_path):
    rows = [(1, 'say "a", b', 5, "review", "line\nbreak", 0.12345, None, "T1,T2"), (2, None, 6, "observe", "", 0.5, "low", "")]
    views.write_export(store_of(spark, rows).coalesce(1), str(tmp_path / "out"))
    (path,) = Path(tmp_path / "out").glob("*.csv")
    with path.open(newline="") as f:
        found = list(csv.reader(f))
    assert found[0] == list(views.EXPORTED)
    assert found[1] == ["1", "5", 'say "a", b', "line\nbreak", "review", "0.1235", "", "T1;T2"] and found[2] == ["2", "6", "", "", "observe", "0.5000", "low", ""]


def test_audit_trail(spark):
    trail = spark.createDataFrame([("a", 1, 1, "open"), ("a", 1, 2, "open"), ("b", views.DAY, 3, "close"), (None, 5, 4, "open")], "actor string, ts long, id long, action string")
    page = views.audit_page(trail, action="open", until=5, limit=2, offset=1).collect()
    assert [(r.id, r.total) for r in page] == [(2, 3), (1, 3)]
    assert views.audit_page(trail, actor="zz").count() == 0
    found = {(r.actor, r.action): (r.n, r.first_ts, r.last_ts, r.n_days) for r in views.audit_summary(trail).collect()}
    assert found[None, None] == (4, 1, views.DAY, 2) and found["(none)", None] == (1, 5, 5, 1) and found["a", "open"] == (2, 1, 1, 1) and len(found) == 7


@pytest.mark.parametrize("name", ["function_page", "function_views", "audit_page", "bulk_attach"])
def test_queries_have_rows(spark, tables, name):
    """The times and filters of the registered pages meet the tables."""
    from skytally.plans import registry

    assert registry.queries()[name](spark, tables).count() > 0
