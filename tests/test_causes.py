"""Causal pairs against all pairs by brute force."""

from math import exp

from skytally.operators import silent
from skytally.plans import registry
from skytally.sources.telemetry import load


def pairs(rows):
    out = set()
    for a in (r for r in rows if r.truth):
        for b in rows:
            if a.function_id == b.function_id and 0 < b.t_us - a.t_us <= 300_000_000:
                confidence = 0.5 * exp(-(b.t_us - a.t_us) / 6e7) + 0.2 * (a.phase == b.phase) + 0.3 * b.truth
                out.add((a.event_id, b.event_id, a.function_id, round(confidence, 3)))
    return out


def found(df):
    rows = [(r.source, r.target, r.function_id, round(r.confidence, 3)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def close(got, want):
    by = lambda rows: {x[:3]: x[3] for x in rows}
    assert by(got).keys() == by(want).keys() and all(abs(by(got)[k] - by(want)[k]) <= 0.0011 for k in by(want))


def test_causal_pairs_on_the_tables(spark, tables):
    close(found(registry.queries()["causal_pairs"](spark, tables)), pairs(load(spark, tables).collect()))


def test_causal_pairs_of_a_hot_function(spark):
    """More than five followers, ties, arrivals out of order and both ends of the window."""
    times = [0, 0, 299_999_999, 300_000_000, 300_000_001, 600_000_000, *range(1_000_000, 21_000_000, 1_000_000)]
    rows = [(k, "f" if k % 7 else "g", t, "error" if k % 3 == 0 else "invoke", "benign", k % 3 == 0) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, function_id string, t_us long, phase string, anomaly_type string, truth boolean")
    want = pairs(df.collect())
    assert len(want) > 5 * sum(r[5] for r in rows) // 2
    close(found(silent.run(silent.PAIRS, df)), want)


def test_strongest_effects_are_found_without_pairs(spark):
    """Ties in time and strength, repeated ids, unknown types and times; the rows are those of all pairs, and no plan joins."""
    import random

    from skytally.operators import graph

    draw = random.Random(7)
    kinds = ["benign", "benign", "cpu_burst", "execution_failure", None]
    rows = [(k % 290, draw.choice("fgh") if k % 23 else None, draw.randrange(40) * 9_000_000 + draw.randrange(2) if k % 19 else None, draw.choice(["invoke", "error"]), draw.choice(kinds), 0.0) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, function_id string, t_us long, phase string, anomaly_type string, memory double")
    got = graph.successors(df)
    want = sorted(map(tuple, graph.run(graph.SUCCESSORS, df).collect()))
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def odd_records(spark, n=400):
    """Records of three functions with ties in time and order, and null texts, times and measures."""
    import random

    draw = random.Random(11)
    some = lambda x: x if draw.random() > 0.05 else None
    rows = [
        (k, some(draw.choice("fgh")), some(draw.randrange(900) * 2_500_000 + draw.randrange(3)), some(draw.choice(["invoke", "error", "init"])), some(draw.choice(["benign", "benign", "cpu_burst", "execution_failure"])),
         some(draw.randrange(300) / 10), some(2048.0 * draw.randrange(60)), some(float(draw.randrange(101))), some(1024.0 * draw.randrange(900)), some(draw.random() < 0.4))
        for k in range(n)
    ]
    return spark.createDataFrame(rows, "event_id long, function_id string, t_us long, phase string, anomaly_type string, duration double, memory double, cpu double, network double, truth boolean").repartition(3)


def same_rows(got, want):
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    assert len(want := rows(want)) > 300 and rows(got) == want


def test_correlations_make_no_decimals_or_texts_for_a_pair(spark):
    from skytally.operators import graph, studies

    df = odd_records(spark)
    got = graph.correlations(df)
    same_rows(got, studies.run(graph.CORRELATIONS, df))
    plan = registry.queries()["correlation_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "concat_ws" not in plan


def test_causal_pairs_make_no_decimals_for_a_pair(spark):
    df = odd_records(spark)
    got = silent.run(silent.PAIRS_JOINED, df)
    same_rows(got, silent.run(silent.PAIRS, df))
    plan = registry.queries()["causal_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan


def dealt(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strengths_are_made_without_a_join(spark):
    """A row goes to one slot, and to a second one near its end; all pairs come from there."""
    from skytally.operators import graph, studies

    df = odd_records(spark)
    same_rows(graph.strengths(df), studies.run(graph.STRENGTHS, df))
    plan = dealt(graph.strengths(df))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_edges_are_made_without_a_join(spark):
    from skytally.operators import graph

    df = odd_records(spark, 900)
    same_rows(graph.edges(df), graph.run(graph.EDGES, df))
    plan = dealt(graph.edges(df))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_centrality_is_summed_where_edges_are_found(spark):
    from skytally.operators import graph

    df = odd_records(spark, 900)
    close = lambda rows: {r.event_id: (r.out_degree, round(r.out_strength, 4), round(r.anomaly_centrality, 3)) for r in rows.collect()}
    got, want = close(graph.centrality(df)), close(graph.run(graph.CENTRALITY, df))
    assert len(want) > 300 and got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 0.0011 for k in want)
    assert "Join" not in dealt(graph.centrality(df))


def test_blocks_and_batches_lose_no_pair(spark):
    """Blocks smaller than a record's followers, and batches smaller than a span."""
    from skytally.operators import graph, neighbours, studies

    df = odd_records(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = df.selectExpr("event_id", "function_id", "t_us", "phase", "coalesce(anomaly_type <> 'benign', false) AS odd")
        got = neighbours.pairs(rows, graph._REACH, graph._weighed, "source long, target long, function_id string, t_us long, strength double, kind string", by=["function_id"], block=7)
        same_rows(got, studies.run(graph.STRENGTHS, df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
