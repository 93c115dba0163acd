"""Paired tests against signed ranks by hand and published values of Student's curve."""

import math
import random

import pytest

from skytally.operators import studies


def outcome_of(spark, pairs):
    return studies.run(studies.paired("SELECT x, y FROM {rows}"), spark.createDataFrame(pairs, "x double, y double")).first()


def by_hand(pairs):
    d = [round(x - y, 12) for x, y in pairs if x is not None and y is not None]
    some = sorted(abs(v) for v in d if v)
    rank = {a: sum(k + 1 for k, v in enumerate(some) if v == a) / some.count(a) for a in some}
    up, down = (sum(rank[abs(v)] for v in d if v * s > 0) for s in (1, -1))
    n = len(some)
    spread = n * (n + 1) * (2 * n + 1) / 24 - sum(some.count(a) ** 3 - some.count(a) for a in set(some)) / 48
    z = abs(min(up, down) - n * (n + 1) / 4) / math.sqrt(spread) if n else 0.0
    return min(up, down), z, math.erfc(z / math.sqrt(2))


@pytest.mark.parametrize("n", [2, 3, 12, 300])
def test_signed_ranks(spark, n):
    rng = random.Random(n)
    pairs = [(rng.randrange(8) / 8, rng.randrange(6) / 8) for _ in range(n)] + [(None, 1.0), (0.5, 0.5)]
    got, (w, z, p) = outcome_of(spark, pairs), by_hand(pairs)
    assert (got.pairs, got.w) == (n + 1, round(w, 4)) and abs(got.z - z) < 1e-5 and abs(got.p_ranks - p) < 1e-5


@pytest.mark.parametrize("t, n, p", [(2.0, 11, 0.073388), (2.228139, 11, 0.05), (12.706205, 2, 0.05), (4.302653, 3, 0.05), (1.983972, 101, 0.05), (2.626405, 101, 0.01), (1.960201, 10_001, 0.05)])
def test_student(spark, t, n, p):
    """Differences with a mean of t standard errors: half one off it, half the other way, the rest at it."""
    k = n // 2
    off = math.sqrt((n - 1) / (2 * k))
    mean = t / math.sqrt(n)
    pairs = [(mean + off, 0.0)] * k + [(mean - off, 0.0)] * k + [(mean, 0.0)] * (n - 2 * k)
    got = outcome_of(spark, pairs)
    assert abs(got.t - t) < 1e-4 and abs(got.p_t - p) < 2e-5


def test_edges(spark):
    assert outcome_of(spark, []).pairs == 0 and outcome_of(spark, []).p_t is None
    assert outcome_of(spark, [(1.0, 0.5)]).p_t is None
    same = outcome_of(spark, [(1.0, 1.0)] * 5)
    assert (same.t, same.p_t, same.unequal, same.p_ranks) == (0.0, 1.0, 0, 1.0)
    assert outcome_of(spark, [(1.0, 0.5)] * 5).p_t == 0.0
