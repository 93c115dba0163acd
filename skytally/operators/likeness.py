"""How alike two nested values are: structs and maps by their common names, lists by length, numbers by their relative difference.

The type is known when a query is built, so the comparison is an expression as deep as the type; nothing leaves the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StructType
from pyspark.sql.window import Window

# Levels and the likeness each begins at.
LEVELS = (("identical", 0.95), ("very_similar", 0.8), ("similar", 0.6), ("moderately_similar", 0.4), ("different", 0.2))


def likeness(a: Column, b: Column, kind: DataType) -> Column:
    """From 0 to 1 for two values of one type; two nulls are alike, a null and a value aren't.

    Of structs and maps: the likeness of what both have, over how many names either has (a null field of a struct isn't had, a null value
    of a map is); nothing on both sides is alike, on one side it isn't. Of lists: the shorter length over the longer, 1 for equal ones.
    Of numbers: 1 less their difference over the larger size (NaN is like itself alone). Of all else: whether they are equal.
    """
    if isinstance(kind, StructType):
        both, either, total = F.lit(0), F.lit(0), F.lit(0.0)
        for f in kind.fields:
            x, y = a[f.name], b[f.name]
            has_x, has_y = x.isNotNull().cast("int"), y.isNotNull().cast("int")
            both, either = both + has_x * has_y, either + F.greatest(has_x, has_y)
            total = total + F.when(has_x * has_y == 1, likeness(x, y, f.dataType)).otherwise(0.0)
        alike = F.when(either == 0, 1.0).otherwise(total / either)
    elif isinstance(kind, MapType):
        names = F.array_union(F.map_keys(a), F.map_keys(b))
        common = F.array_intersect(F.map_keys(a), F.map_keys(b))
        total = F.aggregate(common, F.lit(0.0), lambda t, k: t + likeness(F.element_at(a, k), F.element_at(b, k), kind.valueType))
        alike = F.when(F.size(names) == 0, 1.0).otherwise(total / F.size(names))
    elif isinstance(kind, ArrayType):
        lengths = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
        alike = F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).otherwise(lengths)
        if not _holds_map(kind):
            alike = F.when(a == b, 1.0).otherwise(alike)
    elif isinstance(kind, NumericType):
        x, y = a.cast("double"), b.cast("double")
        alike = F.when(x == y, 1.0).when(F.isnan(x) | F.isnan(y), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y))))
    else:
        alike = (a == b).cast("double")
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(alike)


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _holds_map(kind.elementType)


def level(x: Column) -> Column:
    out = F.when(x >= LEVELS[0][1], LEVELS[0][0])
    for name, least in LEVELS[1:]:
        out = out.when(x >= least, name)
    return out.otherwise("very_different")


def changes(rows: DataFrame, value: str, *, by: str, order: str, id_col: str) -> DataFrame:
    """id, likeness (four places) and level of each row's ``value`` against that of the row before it in its group; first rows have none."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    first = F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1
    paired = rows.select(id_col, F.col(value).alias("_now"), before.alias("_before"), first.alias("_first")).where("NOT _first")
    scored = paired.select(id_col, F.round(likeness(F.col("_now"), F.col("_before"), rows.schema[value].dataType) + 1e-10, 4).alias("likeness"))
    return scored.withColumn("level", level(F.col("likeness")))


def payloads(events: DataFrame) -> DataFrame:
    """Events with a nested payload: who, measures by name (one event in four has one more), and a list of k % 4 marks."""
    k = F.get_json_object("props", "$.k").cast("double")
    measures = F.map_concat(F.create_map(F.lit("k"), k, F.lit("value"), F.col("value")), F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("extra"), k * 2)).otherwise(F.create_map().cast("map<string,double>")))
    who = F.struct(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 7).alias("tier"))
    marks = F.array_repeat(F.lit("m"), (k % 4).cast("int"))
    return events.select("event_id", "user_id", F.struct(who.alias("who"), measures.alias("measures"), marks.alias("marks")).alias("payload"))


_RATIO = "CASE WHEN {a} = {b} THEN 1e0 ELSE greatest(0e0, 1 - abs({a} - {b}) / greatest(abs({a}), abs({b}))) END"
ORACLE_SQL = f"""
WITH p AS (
  SELECT event_id, user_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN user_id % 7 END AS tier, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value, event_id % 4 = 0 AS more,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS marks FROM events),
q AS (SELECT *, {", ".join(f"lag({c}) OVER w AS b_{c}" for c in ("event_id", "kind", "tier", "k", "value", "more", "marks"))} FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (
  SELECT event_id, (CASE WHEN kind = b_kind THEN 1e0 ELSE 0e0 END + CASE WHEN tier = b_tier THEN 1e0 ELSE 0e0 END) / CASE WHEN tier IS NULL AND b_tier IS NULL THEN 1 ELSE 2 END AS who,
    ({_RATIO.format(a="k", b="b_k")} + {_RATIO.format(a="value", b="b_value")} + CASE WHEN more AND b_more THEN {_RATIO.format(a="k", b="b_k")} ELSE 0e0 END) / CASE WHEN more OR b_more THEN 3 ELSE 2 END AS measures,
    CASE WHEN marks = b_marks THEN 1e0 ELSE least(marks, b_marks) * 1e0 / greatest(marks, b_marks) END AS marks
  FROM q WHERE b_event_id IS NOT NULL)
SELECT event_id, round((who + measures + marks) / 3 + 1e-10, 4) AS likeness,
  CASE {" ".join(f"WHEN round((who + measures + marks) / 3 + 1e-10, 4) >= {least} THEN '{name}'" for name, least in LEVELS)} ELSE 'very_different' END AS level
FROM s"""
