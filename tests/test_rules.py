"""Rules over small tables, in both engines: types, ranges, patterns, severities, columns that are missing or unknown."""

import ipaddress

import pytest

from skytally.operators import rules
from skytally.operators.rules import Rule

ADDRESSES = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "01.2.3.4", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2", "1:2:3:4:5:6:7", "::ffff:1.2.3.4", "12345::", "g::", "", "1.2.3.4\n", "1:2:3:4:5:6:7::8"]
VALUES = {
    "timestamp": (["0", "9999999999999", "1.5e3", "2024-02-29", "2024-02-29T23:59:59Z", "2024-01-01 00:00", "2024-01-01T00:00:00.123456+02:00"], ["-1", "10000000000000", "2023-02-29", "2024-13-01", "2024-01-01T25:00", "yesterday", ""]),
    "url": (["http://a", "https://a.b/c?d#e", "s3+x://h"], ["http:///p", "a.b/c", "//a", "1://a", ""]),
    "email": (["a@b.co", "a.b+c@d-e.org"], ["a@b", "@b.co", "a..b@c.de", "a b@c.de", "a@-b.co", "a@b.co\n", ""]),
    "base64": (["", "QQ==", "QUI=", "QUJD", "QUJDQUJD"], ["Q", "QQ=", "QQ", "Q===", "QU D", "QQ==\n"]),
    "uuid": (["0123456789abcdef0123456789ABCDEF", "01234567-89ab-cdef-0123-456789abcdef", "urn:uuid:01234567-89ab-cdef-0123-456789abcdef"], ["0123", "g1234567-89ab-cdef-0123-456789abcdef", ""]),
    "json_object": (['{"a": {"b": [1, 2]}}', "{}", ' {"x": null}'], ["[1]", '{"a": 1', "1", "", "null"]),
    "array": (["[]", ' [1, {"a": 2}]'], ["{}", "[1", ""]), "integer": (["1", "-20", "+3"], ["1.0", "1e3", "", "x"]), "float": (["1", ".5", "-1.", "1e-3"], ["nan", "", ".", "1,5"]), "boolean": (["true", "false"], ["True", "1", ""]), "string": (["", "x\n"], []),
}


def both(spark, duck, same, rows, schema, made, **more):
    """The Spark result as a dictionary, having compared it with DuckDB's."""
    import pandas as pd

    df = spark.createDataFrame(rows, schema)
    columns = df.columns
    given = pd.DataFrame(rows, columns=columns).astype(object)  # noqa: F841
    casts = ", ".join(f"CAST({c} AS {'BIGINT' if t == 'bigint' else 'DOUBLE' if t == 'double' else 'VARCHAR'}) AS {c}" for c, t in df.dtypes)
    duck.register("given_rules", given)
    found = rules.checked(df, made, id_col="id", **more)
    same(found, duck, rules.checked_sql(f"(SELECT {casts} FROM given_rules)", columns, made, id_col="id", **more))
    return {r.id: r for r in found.collect()}


@pytest.mark.parametrize("kind", VALUES)
def test_types(spark, duck, same, kind):
    good, bad = VALUES[kind]
    found = both(spark, duck, same, [(i, v) for i, v in enumerate([*good, *bad, None])], "id long, x string", [Rule("x", "type", kind)])
    assert [found[i].valid for i in range(len(found))] == [True] * len(good) + [False] * len(bad) + [True]
    assert found[len(good) + len(bad)].n_checked == 0


def test_addresses_are_those_of_the_standard_library(spark, duck, same):
    found = both(spark, duck, same, list(enumerate(ADDRESSES)), "id long, x string", [Rule("x", "type", "ip_address")])

    def valid(text):
        try:
            return bool(ipaddress.ip_address(text))
        except ValueError:
            return False

    assert {a: found[i].valid for i, a in enumerate(ADDRESSES)} == {a: valid(a) for a in ADDRESSES}


def test_kinds_and_quality(spark, duck, same):
    made = [Rule("a", "required", severity="critical"), Rule("a", "range", low=0, high=10), Rule("b", "enum", ("x", "it's"), severity="warning"), Rule("b", "pattern", "[a-z]+'?", severity="info"), Rule("c", "check", "c > a", name="order"), Rule("gone", "required", severity="warning"), Rule("gone", "type", "integer")]
    rows = [(1, 5.0, "x", 6.0, 0.0), (2, None, "it's", 6.0, 0.0), (3, 11.0, "Y", 1.0, 0.0), (4, None, None, None, None)]
    found = both(spark, duck, same, rows, "id long, a double, b string, c double, other double", made)
    assert (found[1].valid, found[1].warnings, found[1].n_checked, found[1].quality) == (True, "gone:required,other:unknown", 4, 0.8)
    assert (found[2].errors, found[2].n_critical, found[2].quality) == ("a:required,order", 1, 0.0)
    assert (found[3].errors, found[3].warnings, found[3].notes, found[3].quality) == ("a:range,order", "b:enum,gone:required,other:unknown", "b:pattern", 0.1)
    assert (found[4].errors, found[4].n_checked) == ("a:required", 0)
    (odd,) = rules.checked(spark.createDataFrame([(1, float("nan"))], "id long, a double"), [Rule("a", "required"), Rule("a", "range", low=0)], id_col="id").collect()
    assert odd.errors == "a:range"
    quiet = both(spark, duck, same, rows[:1], "id long, a double, b string, c double, other double", made[:1], known=["b", "c", "other"], costs={"critical": 1.0})
    assert quiet[1].quality == 1 and quiet[1].warnings == ""


@pytest.mark.parametrize("bad", [("a", "size"), ("a", "type", "money"), ("a", "range"), ("a", "enum", ()), ("a", "pattern"), ("a", "required", None, "fatal")])
def test_bad_rules(bad):
    with pytest.raises(ValueError):
        Rule(*bad)


def test_empty_table_and_no_rules(spark):
    rows = spark.createDataFrame([], "id long, x string")
    assert rules.checked(rows, [Rule("x", "type", "url")], id_col="id").count() == 0
    (row,) = rules.checked(spark.createDataFrame([(1,)], "id long"), [], id_col="id").collect()
    assert row.valid and row.quality == 1 and row.errors == "" and row.n_checked == 0
