"""Detectors and functions that users add, and consent by intervals."""

import random
from dataclasses import replace

import pytest

from skytally.functions import registered
from skytally.operators import consent, decisions, detectors, panel
from skytally.sources.telemetry import load


def test_registration_errors():
    own = panel.Panel()
    assert len(own) == 26 and own.weights == {n: decisions.weight(n) for n in detectors.NAMES}
    for bad, weight in ((detectors.DETECTORS[0], 0.1), (panel.EXAMPLE, 1.1), (panel.EXAMPLE, -0.1), (panel.EXAMPLE, float("nan")), (replace(panel.EXAMPLE, name="no name"), 0.1), (replace(panel.EXAMPLE, score=" "), 0.1)):
        with pytest.raises(ValueError):
            own.register(bad, weight)
    assert "burst_transfer" not in own and "burst_transfer" in own.register(panel.EXAMPLE, 0.3) and len(own) == 27
    with pytest.raises(ValueError):
        own.register(panel.EXAMPLE, 0.3)


def test_an_added_detector_votes_and_counts(spark, tables):
    """Its votes stand beside the others', and it moves the fused score by its weight."""
    rows = load(spark, tables).where("event_id < 300")
    plain, own = panel.Panel(), panel.Panel().register(panel.EXAMPLE, 0.5)
    votes = {r.event_id: r for r in own.votes(rows).collect()}
    before = {r.event_id: r for r in plain.fused(plain.votes(rows)).collect()}
    after = {r.event_id: r for r in own.fused(own.votes(rows)).collect()}
    total = sum(plain.weights.values())
    hit = [k for k, r in votes.items() if r.burst_transfer_detected]
    assert hit and len(hit) < 300
    for k, r in after.items():
        w = 0.5 if k in hit else 0.0
        assert abs(r.vote_score - (before[k].vote_score * total + w) / (total + 0.5)) < 2e-4 and r.detectors_hit == before[k].detectors_hit + (k in hit)
    assert any(after[k].primary_type == "burst_transfer" for k in hit) and decisions.fused(detectors.votes(rows)).count() == 300


def test_functions_by_name(spark):
    registered.register(spark)
    registered.register(spark)
    rows = spark.createDataFrame([(1, "a,b", 1.0), (2, None, 2.0), (3, "", None), (4, "b", 9.0)], "id int, ts string, x double")
    got = spark.sql(f"SELECT id, place, technique FROM {{rows}} AS r, LATERAL {registered.TABLE}(r.ts) AS t", rows=rows).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (1, 2, "b"), (4, 1, "b")]
    assert spark.sql(f"SELECT {registered.AGGREGATE}(x) AS s FROM {{rows}}", rows=rows).first().s == 1.0
    assert spark.sql(f"SELECT {registered.AGGREGATE}(x) AS s FROM {{rows}} WHERE x IS NULL GROUP BY id", rows=rows).first().s is None


def plainly(stream):
    rank = {"grant": 0, "withdraw": 1, "record": 2}
    grants, ever, out = {}, set(), {}
    for event, subject, purpose, t, kind, until in sorted(stream, key=lambda r: (r[3], rank[r[4]], r[0])):
        key = (subject, purpose)
        if kind == "grant":
            grants.setdefault(key, []).append((event, consent.FOREVER if until is None else until))
            ever.add(key)
        elif kind == "withdraw":
            grants[key] = []
        else:
            own = grants.get(key) or []
            end = max((u for _, u in own), default=None)
            out[event] = ("granted" if own and end > t else "expired" if own else "withdrawn" if key in ever else "missing", own[-1][0] if own else None, None if end is None or end == consent.FOREVER else end)
    return out


def test_intervals(spark):
    """Overlapping, open, empty and missing intervals, withdrawals and equal times."""
    rng = random.Random(8)
    stream = []
    for k in range(600):
        t, kind = rng.randrange(120), rng.choice(["grant", "withdraw", "record", "record", "record"])
        stream.append((k, rng.choice([1, 2, 3, None]), rng.choice([0, 1]), t, kind, rng.choice([None, t - 5, t, t + 1, t + 20, t + 60]) if kind == "grant" else None))
    rows = consent.at_records(spark.createDataFrame(stream, "event_id long, subject long, purpose long, t_us long, kind string, until long").repartition(4)).collect()
    assert {r.event_id: (r.decision, r.granted_by, r.until) for r in rows} == plainly(stream) and {r.decision for r in rows} == {"granted", "expired", "withdrawn", "missing"}
