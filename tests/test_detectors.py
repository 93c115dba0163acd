"""Single detectors on crafted histories."""

from pyspark.sql import functions as F

from skytally.operators import decisions, detectors


def history(spark, n, last=None, **columns):
    """Benign rows a second apart; ``last`` overrides columns of the final row."""
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") * 1_000_000).alias("t_us"), F.lit("fn-0").alias("function_id"), F.lit("invoke").alias("phase"), F.lit("benign").alias("anomaly_type"),
        (0.1 + (F.col("id") % 5) * 0.005).alias("duration"), (61440 + (F.col("id") % 10) * 256).cast("double").alias("memory"), (20 + F.col("id") % 8).cast("double").alias("cpu"),
        (512 + (F.col("id") % 20) * 64).cast("double").alias("network"), F.lit(False).alias("truth"),
    )
    for name, value in (last or {}).items():
        rows = rows.withColumn(name, F.when(F.col("event_id") == n - 1, F.lit(value).cast(dict(rows.dtypes)[name])).otherwise(F.col(name)))
    return rows


def final(spark, n, **last):
    return detectors.votes(history(spark, n, last)).orderBy(F.desc("event_id")).first()


def test_statistical_outlier(spark):
    row = final(spark, 51, duration=10.0)
    assert row.statistical_outlier_detected and row.statistical_outlier_type == "timeout_fallback" and row.statistical_outlier_confidence == 1.0
    assert not final(spark, 51).statistical_outlier_detected


def test_guards(spark):
    row = final(spark, 9, duration=10.0)
    assert not row.statistical_outlier_detected and row.statistical_outlier_confidence == 0.0
    assert not row.trend_change_detected and not row.behavioral_drift_detected


def test_network_and_memory(spark):
    row = final(spark, 60, network=1e9, memory=500_000.0)
    assert row.network_anomaly_detected and row.security_anomaly_detected and row.security_anomaly_type == "network_anomaly" and row.resource_spike_detected


def test_error_phase(spark):
    row = final(spark, 30, phase="error", anomaly_type="execution_failure")
    assert row.dependency_failure_detected and row.timeout_pattern_detected and row.dependency_failure_confidence == 0.6


def test_histories_are_apart(spark):
    one = history(spark, 51)
    two = history(spark, 51, {"duration": 10.0}).withColumn("function_id", F.lit("fn-1")).withColumn("event_id", F.col("event_id") + 1000)
    rows = detectors.votes(one.union(two)).where("statistical_outlier_detected").collect()
    assert [r.event_id for r in rows] == [1050]


def test_empty_and_null(spark):
    assert detectors.votes(history(spark, 0)).count() == 0
    rows = history(spark, 12).withColumn("duration", F.lit(None).cast("double"))
    assert detectors.votes(rows).count() == 12


def test_fusion_bounds(spark):
    row = decisions.fused(detectors.votes(history(spark, 60, {"duration": 40.0, "network": 1e9, "memory": 500_000.0, "phase": "error"}))).orderBy(F.desc("event_id")).first()
    assert 0 <= row.vote_score <= 1 and 0 <= row.risk <= 1 and row.detectors_hit >= 6 and row.primary_type != "benign"


def test_feedback_clamps(spark):
    rows = spark.createDataFrame([("f", k, k, k < 8, True, 0.9) for k in range(40)], "function_id string, t_us long, event_id long, confirmed boolean, impact boolean, alignment double")
    row = decisions.feedback_trust(rows).first()
    trust = 0.8
    for k in range(40):
        trust = max(0.1, min(1.0, trust + (0.05 if k < 8 else -0.05) + 0.03))
    assert row.trust == round(trust, 4) and row.n_feedback == 40


def test_feedback_by_blocks_is_the_fold(spark):
    """Many pieces, floors and ceilings, ties in time: the same as one step after the other, whatever the blocks."""
    import random

    rng = random.Random(3)
    rows = [(f"f{k % 3}", rng.randrange(60), k, rng.random() < 0.45, rng.random() < 0.3, rng.choice([0.6, 0.75])) for k in range(3000)]
    want = {}
    for f, _, _, ok, impact, sure in sorted(rows, key=lambda r: (r[1], r[2])):
        step = (5 if ok else -5) + (2 if impact else 0) + (1 if sure >= 0.75 else 0)
        want[f] = max(10, min(100, want.get(f, 80) + step))
    df = spark.createDataFrame(rows, "function_id string, t_us long, event_id long, confirmed boolean, impact boolean, alignment double")
    for block in (7, 100, 10_000):
        got = {r.function_id: (r.trust, r.n_feedback) for r in decisions.feedback_trust(df, block=block).collect()}
        assert got == {f: (t / 100, 1000) for f, t in want.items()}


def test_history_by_another_key(spark):
    rows = history(spark, 40).withColumn("stream", F.lit(1)).withColumn("function_id", F.concat(F.lit("fn-"), F.col("event_id") % 4))
    assert detectors.votes(rows).where("duration_outlier_confidence > 0").count() == 0
    whole = {r.event_id: r.behavioral_drift_confidence for r in detectors.votes(rows, by="stream").collect()}
    assert len(whole) == 40


def test_running_percentiles_by_brute_force(spark):
    """Blocks, frames, nulls, a null key and ids far apart."""
    import random

    import numpy as np

    from skytally.operators.order_statistics import running_percentiles

    rng = random.Random(4)
    rows = [(None if k % 5 == 4 else f"k{k % 3}", k * rng.choice([1, 1000]) + 10**6 * k, None if rng.random() < 0.1 else round(rng.random(), 2)) for k in range(500)]
    df = spark.createDataFrame(rows, "function_id string, event_id long, x double")
    got = {r.event_id: (r.low, r.top) for r in running_percentiles(df, {"low": ("x", 0.3), "top": ("x", 1.0)}, frame=20, block=30).collect()}
    seen = {}
    for key, i, x in sorted(rows, key=lambda r: r[1]):
        frame = seen.setdefault(key, [])
        frame.append(x)
        own = [v for v in frame[-20:] if v is not None]
        low, top = got[i]
        assert (low is None) == (not own) and (not own or abs(low - np.percentile(own, 30)) < 1e-12 and top == max(own))
