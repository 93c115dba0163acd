"""Attack paths against the walk along all edges."""

import random

from skytally.functions.dialect import SPARK, fill
from skytally.operators import attack
from skytally.operators.graph import strengths

SCHEMA = "event_id long, function_id string, t_us long, phase string, anomaly_type string, truth boolean"


def by_all_edges(spark, df, path):
    strengths(df).select("source", "target", "strength").write.parquet(f"{path}/edges")
    edges, nodes = spark.read.parquet(f"{path}/edges"), spark.sql(attack.NODES, rows=df)
    visited = attack.walked(edges, nodes.where("truth").selectExpr("event_id AS target"), f"{path}/walk")
    return sorted(map(repr, spark.sql(fill(attack.PATHS, SPARK), visited=visited, nodes=nodes, edges=edges).collect())), edges.count()


def records(n, seed, step):
    """Dense and thin stretches, equal times, times at the ends of the spans, unknown types, functions and times; failures of any type."""
    draw, at, out = random.Random(seed), 0, []
    for k in range(n):
        at += draw.choice([0, 1, step, step, 10_000_000]) if k % 50 else draw.choice([150_000_000, 400_000_000])
        out.append((k * 11 % n, draw.choice("fg") if k % 41 else None, at if k % 37 else None, draw.choice(["invoke", "init", "shutdown", "error"]), draw.choice(["benign", "benign", "cpu_burst", "execution_failure", None]), draw.random() < 0.3))
    return out


def test_paths_without_all_edges(spark, tmp_path, monkeypatch):
    ends = [(5000 + k, "h", t, "invoke", kind, t == 190_000_001) for k, (t, kind) in enumerate([(0, "cpu_burst"), (1, "cpu_burst"), (40_000_001, "cpu_burst"), (70_000_000, "benign"), (70_000_001, "benign"), (70_000_002, "benign"), (190_000_001, "execution_failure")])]
    for step in (2_000_000, 40_000_000):
        df = spark.createDataFrame(records(700, step, step) + ends, SCHEMA)
        want, _ = by_all_edges(spark, df, str(tmp_path / str(step)))
        with monkeypatch.context() as m:
            m.setattr(attack, "strengths", lambda _: 1 / 0)
            got = sorted(map(repr, attack.attack_paths(df).collect()))
        assert got == want and len(got) > 150
        dense = [r for r in got if int(r.split("n_nodes=")[1].split(",")[0]) > 21]
        assert dense if step == 2_000_000 else len(dense) < len(got)


def test_repeated_ids_walk_along_all_edges(spark, tmp_path):
    df = spark.createDataFrame([(k % 80, f, t, p, a, x) for k, f, t, p, a, x in records(120, 3, 5_000_000)], SCHEMA)
    assert sorted(map(repr, attack.attack_paths(df).collect())) == by_all_edges(spark, df, str(tmp_path))[0]


def test_only_failures_with_few_causes_walk(spark, monkeypatch):
    """3,000 records at one second each: nearly all failures end with the first step."""
    df = spark.createDataFrame([(k, "f", k * 1_000_000, "error", "execution_failure", True) for k in range(3000)], SCHEMA)
    walked, seen = attack.walked, []
    monkeypatch.setattr(attack, "walked", lambda edges, targets, *more: (seen.append(targets.count()), walked(edges, targets, *more))[1])
    rows = attack.attack_paths(df).collect()
    assert len(rows) == 3000 and seen == [20] and max(r.n_nodes for r in rows) == 191
