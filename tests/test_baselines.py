"""Baselines where a value lies exactly three deviations from the mean of the ten before."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from skytally.functions.dialect import DUCKDB, fill
from skytally.operators import evaluation


def test_values_at_the_threshold_are_rounded_as_in_the_sql(spark, tmp_path, same):
    """Of nine equal values and another one, that other one comes again: 3 deviations off, whatever the two are."""
    draw, values = random.Random(3), []
    for _ in range(150):
        usual, other = draw.randrange(20_000) / 1000, draw.randrange(20_000) / 1000
        ten = [usual] * 9
        ten.insert(draw.randrange(10), other)
        values += [*ten, other]
    values = [draw.choice([0.0, 900.0]) for _ in values] + values
    n = len(values)
    table = pa.table({
        "event_id": pa.array(range(n), pa.int64()), "function_id": ["f"] * n, "truth": [False] * n, "duration": pa.array(values, pa.float64()),
        **{x: pa.array([float(k % 50) for k in range(n)]) for x in ("memory", "cpu", "network")},
    })
    pq.write_table(table, tmp_path / "rows.parquet")
    df = spark.read.parquet(f"file://{tmp_path}/rows.parquet")
    assert df.count() == n
    same(evaluation.baselines(df), duckdb.connect(), fill(evaluation.BASELINES, DUCKDB).format(rows=f"'{tmp_path}/rows.parquet'"))
