"""Events under other names and units, and every strategy and transform of a mapping."""

import pytest
from pyspark.sql import functions as F

from skytally.operators import mapping
from skytally.operators.mapping import Field


def test_events_of_any_sender(spark):
    """The first filled name counts; units; what is missing, empty, zero or can't be read; unknown names."""
    full = spark.createDataFrame([("", "p1", 0.0, 12.5, "f", "ERROR", "Cpu_Burst", 0.0, (1500.0, 3), 0, None, "oops", 4, ("eu", None), True), (None, None, None, None, None, "odd", "odd", None, (None, None), 7, 5.0, "9", None, None, None)],
        "event_id string, record_id string, timestamp double, invocation_timestamp double, function_name string, phase string, anomaly string, duration double, telemetry_fields struct<duration_ms:double,max_memory_used_mb:int>, memory_spike_kb long, cpu double, network_io_bytes string, network_calls int, execution_environment struct<region:string,runtime:string>, force_starvation boolean")
    got = [tuple(r) for r in mapping.normalised(full).collect()]
    assert got[0] == ("p1", 12.5, "f", "error", "cpu_burst", 1500.0, 3072.0, 88.0, 4096.0, True, "eu", None, None)
    assert got[1] == ("runtime-event", 0.0, "runtime-function", "invoke", "benign", 0.0, 7.0, 5.0, 9.0, False, None, None, None)
    bare = mapping.normalised(spark.createDataFrame([(1,)], "other int")).first()
    assert tuple(bare) == ("runtime-event", 0.0, "runtime-function", "invoke", "benign", 0.0, 0.0, 26.0, 0.0, False, None, None, None)
    calls = spark.createDataFrame([(["a", "b"],), (None,)], "network_calls array<string>")
    assert [r.network for r in mapping.normalised(calls).collect()] == [2048.0, 0.0]
    assert mapping.normalised(spark.createDataFrame([], "telemetry_fields struct<duration_ms:double>")).count() == 0


TRANSFORMED = {
    "to_string": (5, "5"), "to_int": ("7.9", 7), "to_float": ("x", None), "to_bool": ("0", False), "to_lowercase": ("AbÉ", "abé"), "to_uppercase": ("ab", "AB"), "trim": (" a ", "a"), "capitalize": ("fOO bar", "Foo bar"),
    "round": (2.5, 2), "abs": (-2.0, 2.0), "sqrt": (9.0, 3.0), "to_timestamp": ("1970-01-01T00:01:00Z", 60.0), "from_timestamp": (60.0, "1970-01-01T00:01:00"), "format_date": (86400.0, "1970-01-02"), "to_json": ("a", '{"value":"a"}'),
    "from_json": ('{"a": 1}', {"a": "1"}), "hash_value": ("a", "0cc175b9c0f1b6a8"), "anonymize": ("secret", "se****"), "normalize": ("  AB ", "ab"),
}


@pytest.mark.parametrize("name", sorted(mapping.TRANSFORMS))
def test_transforms(spark, name):
    given, want = TRANSFORMED[name]
    row = mapping.mapped(spark.createDataFrame([(given,)], ["x"]), [Field("y", "transform", ("x",), name)]).first()
    assert row.y == want and row.errors == ""


def test_strategies(spark):
    rows = spark.createDataFrame([(1, "a-b", 3.0, None, ("n",)), (2, None, None, None, None)], "id int, s string, x double, y double, t struct<u:string>").withColumn("errors", F.lit("own"))
    fields = [
        Field("d", "direct", ("t.u",), required=True), Field("c", "calculate", by="x * 2", default=-1.0, check="c <> 6"), Field("k", "conditional", by={"big": "x > 2", "none": "x IS NULL"}), Field("m", "aggregate", ("x", "y", "id"), "mean"),
        Field("n", "aggregate", ("x", "y", "zz"), "count"), Field("p", "split", ("s",), ("-", 2), default="?"), Field("q", "merge", ("s", "y", "id"), "+"), Field("e", "default", default=7),
    ]
    got = [tuple(r) for r in mapping.mapped(rows, fields, keep=("id",)).orderBy("id").collect()]
    assert got == [(1, "n", 6.0, "big", 2.0, 1, "b", "a-b+1", 7, "invalid c"), (2, None, -1.0, "none", 2.0, 0, "?", "2", 7, "missing d")]
    for bad in (Field("a", "guess"), Field("a", "direct"), Field("a", "transform", ("x",), "magic"), Field("a", "merge", (), ","), Field("ID", "default", default=1)):
        with pytest.raises(ValueError):
            mapping.mapped(rows, [bad], keep=("id",))
