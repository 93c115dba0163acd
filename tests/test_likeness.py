"""Likeness of nested values against a recursion over Python's."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skytally.operators.likeness import changes, level, likeness

KIND = "struct<name:string,n:double,list:array<int>,inner:struct<flag:boolean,map:map<string,double>,deep:map<string,struct<x:int,y:string>>>,bags:array<map<string,int>>>"


def plainly(a, b, top=True):
    if a is None or b is None:
        return float(a is None and b is None)
    if isinstance(a, tuple):  # a struct: named pairs
        x, y = {k: v for k, v in a if v is not None}, {k: v for k, v in b if v is not None}
        return plainly(x, y)
    if isinstance(a, dict):
        names = a.keys() | b.keys()
        return sum(plainly(a[k], b[k]) for k in a.keys() & b.keys()) / len(names) if names else 1.0
    if isinstance(a, list):
        return 1.0 if a == b else min(len(a), len(b)) / max(len(a), len(b))
    if isinstance(a, (int, float)) and not isinstance(a, bool):
        return 1.0 if a == b or math.isnan(a) and math.isnan(b) else 0.0 if math.isnan(a) or math.isnan(b) else max(0.0, 1 - abs(a - b) / max(abs(a), abs(b)))
    return float(a == b)


def made(rng):
    maybe = lambda x: None if rng.random() < 0.15 else x
    deep = maybe({rng.choice("pq"): maybe((maybe(rng.randrange(3)), maybe(rng.choice("uv")))) for _ in range(rng.randrange(3))})
    numbers = maybe({rng.choice("abc"): maybe(float(rng.randrange(-2, 4))) for _ in range(rng.randrange(4))})
    inner = maybe((maybe(rng.random() < 0.5), numbers, deep))
    return maybe((maybe(rng.choice(["x", "y"])), maybe(rng.choice([0.0, 1.0, -3.5, 1e300, float("nan")])), maybe([rng.randrange(2) for _ in range(rng.randrange(3))]), inner, maybe([{"z": 1}] * rng.randrange(3))))


def named(v):
    if v is None:
        return None
    inner = None if v[3] is None else (("flag", v[3][0]), ("map", v[3][1]), ("deep", None if v[3][2] is None else {k: None if d is None else (("x", d[0]), ("y", d[1])) for k, d in v[3][2].items()}))
    return (("name", v[0]), ("n", v[1]), ("list", v[2]), ("inner", inner), ("bags", v[4]))


@pytest.mark.parametrize("seed", range(3))
def test_nested_values(spark, seed):
    rng = random.Random(seed)
    rows = [(k, made(rng), made(rng)) for k in range(250)]
    df = spark.createDataFrame(rows, f"id int, a {KIND}, b {KIND}")
    kind = df.schema["a"].dataType
    assert isinstance(kind, StructType)
    got = {r.id: r.x for r in df.select("id", likeness(F.col("a"), F.col("b"), kind).alias("x")).collect()}
    want = {k: plainly(named(a), named(b)) for k, a, b in rows}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and len({round(x, 3) for x in got.values()}) > 20
    back = {r.id: r.x for r in df.select("id", likeness(F.col("b"), F.col("a"), kind).alias("x")).collect()}
    assert all(abs(got[k] - back[k]) < 1e-9 for k in want)


def test_levels_and_first_rows(spark):
    rows = spark.createDataFrame([(1, "g", 100.0), (2, "g", 96.0), (3, "g", 10.0), (4, "h", None), (5, "h", None), (6, "h", 1.0)], "i int, g string, v double")
    assert {r.i: (r.likeness, r.level) for r in changes(rows, "v", by="g", order="i", id_col="i").collect()} == {2: (0.96, "identical"), 3: (0.1042, "very_different"), 5: (1.0, "identical"), 6: (0.0, "very_different")}
    assert [r.x for r in spark.createDataFrame([(0.8,), (0.79,), (0.2,)], "v double").select(level(F.col("v")).alias("x")).collect()] == ["very_similar", "similar", "different"]
