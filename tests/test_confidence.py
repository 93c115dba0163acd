"""Resampled confidence against a loop over rounds, small panels, weights by trust, figures of each detector."""

import hashlib
import math

import pytest

from skytally.operators import confidence, detectors
from skytally.operators.decisions import weight

_THREE = {"duration_outlier": 0.5, "memory_leak": 0.3, "cpu_burst": 0.2}


def votes_of(spark, rows):
    """Votes from rows of (event_id, {detector: confidence}); detectors that aren't named don't object."""
    base = [(i, i * 1_000_000, "fn", "invoke", "benign", 1.0, 100.0, 1.0, 1.0, bool(hits), *(hits.get(n) for n in detectors.NAMES)) for i, hits in rows]
    schema = "event_id long, t_us long, function_id string, phase string, anomaly_type string, duration double, memory double, cpu double, network double, truth boolean, " + ", ".join(f"{n} double" for n in detectors.NAMES)
    df = spark.createDataFrame(base, schema)
    each = [e for n in detectors.NAMES for e in (f"{n} IS NOT NULL AS {n}_detected", f"coalesce({n}, 0D) AS {n}_confidence", f"CASE WHEN {n} IS NOT NULL THEN 'memory_spike' ELSE 'benign' END AS {n}_type")]
    return df.selectExpr(*df.columns[:10], *each)


def by_loop(hits, weights):
    """Interval, mean, variance and chance by drawing detectors one after the other."""
    names, total = list(weights), sum(weights.values())
    shares = [math.floor(weights[n] * hits.get(n, 0.0) / total * 1e6 + 0.5) for n in names]
    scores = sorted(sum(shares[int(hashlib.md5(f"{b}:{k}".encode()).hexdigest()[:8], 16) % len(names)] for k in range(len(names))) / 1e6 for b in range(1000))
    mean = sum(scores) / 1000
    return scores[25], scores[975], mean, sum((s - mean) ** 2 for s in scores) / 1000, 1 - sum(s > 0.5 for s in scores) / 1000


@pytest.mark.parametrize("weights", [_THREE, {n: weight(n) for n in detectors.NAMES}], ids=["three", "all"])
def test_equals_a_loop(spark, weights):
    rows = [(1, {}), (2, {"duration_outlier": 0.9}), (3, {"duration_outlier": 0.9, "memory_leak": 0.8, "cpu_burst": 1.0}), (4, dict.fromkeys(detectors.NAMES, 1.0))]
    found = {r.event_id: r for r in confidence.confidence(votes_of(spark, rows), weights).collect()}
    for i, hits in rows:
        got, want = found[i], by_loop(hits, weights)
        assert (got.low, got.high, got.mean_bootstrap_score, got.variance, got.p_value) == pytest.approx(want, abs=2e-6)
        assert got.total_uncertainty == pytest.approx(got.model_uncertainty + got.data_uncertainty, abs=2e-6)
        assert got.epistemic_uncertainty == pytest.approx((got.high - got.low) / 2, abs=2e-6) and got.bootstrap_iterations == 1000
        assert got.aleatoric_uncertainty == pytest.approx(min(0.1, 1 / len(weights)), abs=1e-6)
    assert found[1].p_value == 1 and found[4].p_value < found[2].p_value


def test_explanation(spark):
    rows = [(1, {"duration_outlier": 0.9}), (2, {"cpu_burst": 0.9, "duration_outlier": 0.9, "memory_leak": 0.95})]
    found = {r.event_id: r.explanation for r in confidence.confidence(votes_of(spark, rows), _THREE).collect()}
    assert found[1] == "no anomaly: 1 of 3 detectors (33.3 %)"
    assert found[2] == "memory_spike: 3 of 3 detectors (100.0 %), foremost memory_leak 0.95, cpu_burst 0.90, duration_outlier 0.90"


def test_two_detectors_are_not_resampled(spark):
    weights = {"duration_outlier": 0.5, "memory_leak": 0.5}
    row = confidence.confidence(votes_of(spark, [(1, {"duration_outlier": 0.9})]), weights).first()
    assert (row.low, row.high, row.p_value, row.bootstrap_iterations, row.variance) == (0.35, 0.55, 0.5, 0, 0.01)


def test_statistics(spark):
    rows = [(1, {}), (2, {"memory_leak": 0.6}), (3, {"memory_leak": 0.8})]
    found = {r.detector: r for r in confidence.statistics(votes_of(spark, rows)).collect()}
    assert len(found) == len(detectors.NAMES)
    leak, other = found["memory_leak"], found["cpu_burst"]
    assert (leak.n, leak.n_detected, leak.rate, leak.mean_confidence, leak.max_confidence, leak.n_right) == (3, 2, 0.6667, 0.7, 0.8, 3)
    assert (other.n_detected, other.mean_confidence, other.n_right, other.accuracy) == (0, 0.0, 1, 0.3333)


def test_no_votes(spark):
    none = votes_of(spark, [])
    assert confidence.confidence(none).count() == 0 and confidence.statistics(none).count() == 0
