"""Pairs whose sets lie within the sketch are estimated on their whole union."""

import pytest

from skytally.llm import near_dedup


@pytest.mark.parametrize(("n", "m", "shared"), [(93, 96, 84), (94, 95, 84), (95, 96, 85)])
def test_pair_at_the_threshold_with_the_largest_values_shared(spark, n, m, shared):
    own = n - shared + m - shared
    common = list(range(own, own + shared))
    a, b = sorted([*range(n - shared), *common]), sorted([*range(n - shared, own), *common])
    classes = spark.createDataFrame([(1, a), (2, b)], "node long, sketch array<int>")
    rest = spark.createDataFrame([(1, n, 1, 7, 1, 1), (2, m, 1, 7, 2, 2)], "node long, n long, least int, key long, component long, home long")
    assert [(r.a, r.b) for r in near_dedup.across_lists(rest, classes, 96, 80).collect()] == [(1, 2)]
