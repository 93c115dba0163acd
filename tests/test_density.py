"""Components and density-based clusters against brute force."""

import random

import numpy as np
import pytest

from skytally.operators.connected import connected
from skytally.operators.density import density_clusters, standardised


def roots(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_connected(spark):
    """Chains, stars, loops, repeated links, null ends; nothing."""
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3), (9, None), (8, 1), (1, 8)] + [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(50)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.root for r in connected(df).collect()} == roots(links)
    assert connected(df.limit(0)).count() == 0


def brute(rows, eps, least):
    """cluster and core by id, by the definition over all pairs."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], float)
    near = np.zeros((len(x), len(x)), bool)
    for k in range(len(x)):
        total = np.zeros(len(x))
        for d in range(x.shape[1]):
            total = total + (x[k, d] - x[:, d]) * (x[k, d] - x[:, d])
        near[k] = total <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        new = np.where(core, np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1), label)
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1)
    return {int(i): (None if b == np.iinfo(np.int64).max else int(b), bool(c)) for i, b, c in zip(ids, border, core, strict=True)}


def found(df, fields, **more):
    return {r.event_id: (r.cluster, r.core) for r in density_clusters(df, fields, **more).collect()}


@pytest.mark.parametrize("block", [256, 16])
def test_two_thousand_points(spark, block):
    """Clumps, a bridge, copies, noise and points on the border, in four dimensions."""
    rng = np.random.default_rng(block)
    clumps = [rng.normal(c, 0.35, (380, 4)) for c in ([0] * 4, [3, 0, 0, 1], [0, -4, 2, 0])]
    bridge = np.linspace([0, -4, 2, 0], [0, -8, 2, 0], 40)
    x = np.concatenate([*clumps, bridge, np.repeat([[9.0, 9, 9, 9]], 300, 0), rng.uniform(-8, 8, (520, 4))])
    rows = [(int(i), *map(float, v)) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double, d double")
    got = found(df.repartition(5), ["a", "b", "c", "d"], eps=0.5, least=4, block=block)
    assert got == brute(rows, 0.5, 4) and len({c for c, _ in got.values()}) > 4 and None in {c for c, _ in got.values()}


def test_edges(spark):
    """One dimension, points exactly at the distance, nulls, a single point, none; constant fields."""
    rows = [(5, 0.0), (3, 1.0), (9, 2.0), (1, 3.5), (2, 10.0), (4, 10.0)]
    df = spark.createDataFrame([*rows, (7, None)], "event_id long, a double")
    for least in (1, 2, 3, 7):
        assert found(df, ["a"], eps=1.0, least=least) == brute(rows, 1.0, least)
    assert found(df.limit(0), ["a"]) == {} and found(df.where("event_id = 5"), ["a"], least=1) == {5: (5, True)}
    flat = standardised(df.selectExpr("event_id", "a", "CASE WHEN a IS NOT NULL THEN 3.0 END AS b"), ["a", "b"]).collect()
    assert len(flat) == 6 and {r.b for r in flat} == {0.0} and abs(sum(r.a for r in flat)) < 1e-9


def test_dense_heap_is_not_compared_with_itself(spark):
    """A heap of 20,000 points in a few cells, a chain away from it, an island, a border point and noise; all pairs of the heap would take many minutes."""
    from time import monotonic

    rng = np.random.default_rng(5)
    heap = rng.uniform(0, 0.6, (20_000, 2))
    rest = [(0.6 + 0.45 * k, 0.3) for k in range(1, 9)] + [(9.0, 9.0), (9.0, 9.2), (9.2, 9.0), (9.0, 9.49), (-7.0, 4.0)]
    rows = [(int(k), float(a), float(b)) for k, (a, b) in enumerate([*heap, *rest], 1)]
    began = monotonic()
    got = found(spark.createDataFrame(rows, "event_id long, a double, b double"), ["a", "b"], eps=0.5, least=4)
    assert monotonic() - began < 100
    assert all(got[k] == (1, True) for k in range(1, 20_001)) and [got[k][0] for k in range(20_001, 20_006)] == [1, 1, None, None, None]
    assert [got[k] for k in range(20_009, 20_014)] == [(20_009, True), (20_009, True), (20_009, False), (20_009, False), (None, False)]
