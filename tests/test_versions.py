"""Versions of schemas: compatibility by cases, moved and unmoved records."""

import random
from itertools import permutations

from skytally.operators import versions


def test_compatibility():
    f = versions.compatibility
    assert f({"a": True}, {"a": True}) == "full" and f({}, {}) == "full"
    assert f({"a": True}, {"a": False, "b": False}) == "backward"
    assert f({"a": True, "b": True}, {"a": True, "c": False, "d": False}) == "partial"
    assert f({"a": False}, {"a": True}) == "incompatible" and f({"a": True}, {"b": False}) == "incompatible"


def test_records_move_to_a_neighbour(spark):
    rows = [(k, v, 1.0, 2048.0, None, None) for k, v in enumerate(["0.9", "1.0", "1.1", "2.0", "7.7", None])]
    df = spark.createDataFrame(rows, "event_id long, schema_version string, duration double, memory double, cpu double, memory_mb double")
    got = {r.event_id: (r.schema_version, r.moved, r.cpu, r.memory_mb) for r in versions.migrated(df, "2.0").collect()}
    assert got == {0: ("0.9", False, None, None), 1: ("2.0", True, 0.0, 2.0), 2: ("2.0", True, None, 2.0), 3: ("2.0", True, None, None), 4: ("7.7", False, None, None), 5: (None, False, None, None)}
    assert versions.migrated(df.limit(0), "2.0").count() == 0


def test_records_pass_three_links(spark):
    """Each link's expressions are put into the next one's; what has no way stays as it is."""
    rows = [(k, v, 2.0, 2048.0, c, None, None, None) for k, (v, c) in enumerate([("0.9", 1.0), ("1.0", 9.0), ("1.1", 20.0), ("2.1", 7.0), ("3.0", 1.0), ("x", 2.0), (None, 3.0)])]
    df = spark.createDataFrame(rows, "event_id long, schema_version string, duration double, memory double, cpu double, memory_mb double, load double, weight double")
    got = {r.event_id: (r.schema_version, r.moved, r.steps, r.cpu, r.memory_mb, r.load, r.weight) for r in versions.migrated(df, "3.0").collect()}
    assert got[1] == ("3.0", True, 3, 0.0, 2.0, 0.0, 2.0) and got[2] == ("3.0", True, 3, 20.0, 2.0, 0.4, 2.8) and got[4] == ("3.0", True, 0, 1.0, None, None, None)
    assert got[3][:3] == ("3.0", True, 1) and all(got[k] == (v, False, 0, c, None, None, None) for k, v, c in ((0, "0.9", 1.0), (5, "x", 2.0), (6, None, 3.0)))


def test_cheapest_chain_of_all():
    """Against all simple ways, with cycles, gaps, links that break and versions that no schema names."""
    rng = random.Random(4)
    for _ in range(60):
        names = "abcde"
        schemas = {v: {f: rng.random() < 0.3 for f in "pqrs" if rng.random() < 0.7} for v in names}
        links = {(a, b): {} for a in names + "z" for b in names if a != b and rng.random() < 0.4}
        for a in names + "z":
            ways = []
            for n in range(5):
                for mid in permutations([v for v in names if v not in (a, "e")], n):
                    way = (a, *mid, "e") if a != "e" else ("e",)
                    steps = list(zip(way, way[1:]))
                    if a in schemas and all(s in links and versions.compatibility(schemas[s[0]], schemas[s[1]]) in versions.COSTS for s in steps):
                        ways.append((sum(versions.COSTS[versions.compatibility(schemas[x], schemas[y])] for x, y in steps), len(way), way))
            assert versions.chain(a, "e", schemas, links) == (min(ways)[2] if ways else None)
