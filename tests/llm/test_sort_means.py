"""Rounds against plain Lloyd iterations in Python integers."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.llm import sort_means as sm


def brute(rows, dim, k=8, rounds=10):
    kept = [(i, [max(-sm.BOUND, min(sm.BOUND, math.floor(1024 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assigned = lambda: [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        to = assigned()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, to, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    to = assigned()
    of = {n: sum(d for d, c in to if c == n) for n in range(len(centroids))}
    text = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    most = 2**63 - 1
    return sorted(repr((i, c, d, min(most, of[c]), min(most, sum(of.values())), text[c])) for (i, _), (d, c) in zip(kept, to, strict=True))


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "cluster", "distance", "kind", "n", "sums", "i", "x")})
    return sorted(repr(tuple(r)) for r in sm.clusters(df.repartition(3), **more).collect())


@pytest.mark.parametrize("seed", range(3))
def test_rounds(spark, seed):
    """Small whole components, so that distances tie and vectors repeat; odd rows are left out."""
    rng = random.Random(seed)
    rows = [(k if k % 9 else None if k % 2 else 5, [rng.choice([-2.0, -1.0, 0.0, 0.0005, 1.0]) / rng.choice([1, 1, 512]) for _ in range(3)]) for k in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, 2.0, None]), (104, [1.0, float("nan"), 0.0]), (105, [float("inf"), 0.0, 0.0]), (106, [1.0] * 4)]
    assert found(spark, rows, dim=3, rounds=4) == brute(rows, 3, rounds=4)


def test_extremes(spark):
    """Few vectors, equal centroids, components of any size, none at all."""
    for rows in ([], [(1, None)], [(1, [0.5, -0.5])], [(k, [1.0, 1.0]) for k in range(12)], [(k, [(-1.0) ** k * 1e300, k / 7]) for k in range(12)], [(k, [k * 40_000.0, -k * 1e-9]) for k in range(-6, 7)]):
        assert found(spark, rows, dim=2, rounds=3) == brute(rows, 2, rounds=3)


def test_assign_looks_no_farther_than_needed():
    """Nearest with ties by number from any start, and no look beyond twice the distance."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        c = rng.integers(-3, 4, (6, 2))
        v = rng.integers(-4, 5, (40, 2))
        all_ = ((v[:, None] - c[None]) ** 2).sum(2)
        best, least = sm.assign(v, rng.integers(0, 6, 40), c, *sm.ranked(c))
        assert best.tolist() == all_.argmin(1).tolist() and least.tolist() == all_.min(1).tolist()
    c = np.array([[0, 0], [100, 0], [200, 0]])
    others, apart = sm.ranked(c)
    others = np.array([[1, 9], [0, 2], [1, 0]])  # the last is out of range: looking at it would fail
    assert sm.assign(np.array([[40, 0], [50, 0]]), np.array([0, 0]), c, others, apart)[0].tolist() == [0, 0]


def test_sql(spark, tables, duck, same):
    from skytally.llm.registry import op13_sort_means

    same(op13_sort_means(spark, tables), duck, sm.ORACLE_SQL)
