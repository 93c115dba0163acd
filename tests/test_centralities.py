"""Centralities and flows against breadth-first search, groups of odd records on separated heaps."""

import random
from collections import deque

import pytest

from skytally.operators import graph


def by_search(links):
    links = {(a, b) for a, b in links if a is not None and b is not None and a != b}
    nodes = sorted({x for link in links for x in link})
    far, ways = {}, {}
    for s in nodes:
        far[s], ways[s], queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            a = queue.popleft()
            for b in (y for x, y in links if x == a):
                if b not in far[s]:
                    far[s][b], ways[s][b] = far[s][a] + 1, 0
                    queue.append(b)
                if far[s][b] == far[s][a] + 1:
                    ways[s][b] += ways[s][a]
    out, m = {}, len(nodes)
    for v in nodes:
        came = [far[s][v] for s in nodes if s != v and v in far[s]]
        close = len(came) / sum(came) * len(came) / (m - 1) if came else 0.0
        share = sum(ways[s][v] * ways[v][t] / ways[s][t] for s in nodes for t in nodes if v not in (s, t) and s != t and t in far[s] and v in far[s] and t in far[v] and far[s][v] + far[v][t] == far[s][t])
        out[v] = (close, share / ((m - 1) * (m - 2)) if m > 2 else 0.0, min(u for u in nodes if u in far[v] and v in far[u]))
    return out


def agree(spark, links):
    got = {r.node: r for r in graph.centralities(spark.createDataFrame(links, "source string, target string")).collect()}
    want = by_search(links)
    assert got.keys() == want.keys()
    for node, (close, share, flow) in want.items():
        assert abs(got[node].closeness - close) < 2e-6 and abs(got[node].betweenness - share) < 2e-6 and got[node].flow == flow


def test_rings_loops_repeats_and_dead_ends(spark):
    agree(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("a", "a"), ("a", "b"), ("f", "a"), (None, "a"), ("b", None)])


def test_many_shortest_paths(spark):
    draw = random.Random(3)
    agree(spark, [(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}") for _ in range(30)])


def test_no_links(spark):
    agree(spark, [])


def test_eigenvector_is_the_leading_one(spark):
    """Against numpy on a strongly linked graph; loops count, repeats and null ends don't."""
    import numpy as np

    links = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "a"), ("b", "b"), ("a", "b"), (None, "a"), ("d", None)]
    got = {r.node: r.score for r in graph.eigenvector(spark.createDataFrame(links, "source string, target string")).collect()}
    m = np.zeros((4, 4))
    for a, b in links:
        if a and b:
            m["abcd".index(b), "abcd".index(a)] = 1
    values, vectors = np.linalg.eig(m)
    lead = np.abs(vectors[:, np.argmax(values.real)].real)
    assert [got[x] for x in "abcd"] == pytest.approx(list(lead / np.linalg.norm(lead)), abs=1e-5)


def test_eigenvector_without_links_or_rounds(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert graph.eigenvector(none).count() == 0
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    with pytest.raises(ValueError):
        graph.eigenvector(chain, rounds=10)


def test_groups_of_separated_heaps(spark):
    """Two heaps far apart are the two groups, whole, with their means; benign and incomplete records are in none."""
    rows = [(k, "cpu_burst", 1.0 + 100 * (k % 3 > 0), 10.0 + k % 3, 5.0, float(k % 3 > 0)) for k in range(60)]
    rows += [(60, "benign", 9e9, 1.0, 1.0, 1.0), (61, "cpu_burst", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, anomaly_type string, duration double, memory double, cpu double, network double")
    found = sorted((r.n, r.duration, r.memory, r.cpu, r.network) for r in graph.clusters(df, k=2).collect())
    assert found == [(20, 1.0, 10.0, 5.0, 0.0), (40, 101.0, 11.5, 5.0, 1.0)]


def test_text_features_by_hand(spark):
    rows = [(1, "api-a-b", '{"k": {"x": {}, "{{": 2}}', None), (2, None, None, "Auth timeout"), (3, "f", "{}", ""), (4, "f", "{", "odd")]
    got = {r.event_id: r for r in graph.run(graph.TEXTS, spark.createDataFrame(rows, "event_id long, function_id string, payload string, message string")).collect()}
    unit = lambda *v: [round(x / sum(y * y for y in v) ** 0.5, 6) for x in v]
    names = ["n_parts", "is_handler", "is_api", "depth", "n_keys", "nested", "failed", "failure_kind"]
    vector = lambda k: [round(got[k][n], 6) for n in names]
    assert vector(1) == unit(3, 0, 1, 2, 1, 1, 0, 0)
    assert vector(2) == unit(0, 0, 0, 0, 0, 0, 1, 1)
    assert vector(3) == unit(1, 0, 0, 0, 0, 0, 0, 0)
    assert got[4].failure_kind > 0
