"""Functions of the library under names that SQL can call: an aggregate and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

AGGREGATE, TABLE = "skytally_spread", "skytally_techniques"


@pandas_udf(DoubleType())
def spread(v: pd.Series) -> float:
    """Median distance from the median, of the values that aren't null; null without any."""
    known = v.dropna()
    return float((known - known.median()).abs().median()) if len(known) else None


@udtf(returnType=StructType([StructField("place", IntegerType()), StructField("technique", StringType())]), useArrow=True)
class Techniques:
    """The techniques of a comma-separated list, one row each, numbered from 1; none of null or an empty list."""

    def eval(self, listed: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((t for t in (listed or "").split(",") if t), 1)


def register(spark: SparkSession) -> None:
    """Makes both functions known to a session, once; a name that something else has taken is an error."""
    for name, function, known in ((AGGREGATE, spread, spark.udf), (TABLE, Techniques, spark.udtf)):
        if not spark.catalog.functionExists(name):
            known.register(name, function)
        elif not spark.catalog.getFunction(name).isTemporary:
            raise ValueError(f"{name} is a function of the catalog")


def technique_spread(detections: DataFrame) -> DataFrame:
    """technique, place, n and spread of the scores, by place in the detections' lists. Scores are counted by hundredths first, so that no group is large."""
    spark = detections.sparkSession
    register(spark)
    rows = spark.sql(f"SELECT r.fused_score, t.place, t.technique FROM {{rows}} AS r, LATERAL {TABLE}(r.techniques) AS t", rows=detections.select("fused_score", "techniques"))
    counts = rows.groupBy("technique", "place", F.round("fused_score", 2).alias("score")).agg(F.count("*").alias("c"))
    spreads = spark.sql(f"SELECT technique, place, {AGGREGATE}(score) AS spread FROM {{rows}} GROUP BY technique, place", rows=counts)
    sums = counts.groupBy("technique", "place").agg(F.sum("c").alias("n"), F.count("*").alias("n_scores"))
    return sums.join(spreads, ["technique", "place"]).withColumn("spread", F.round(F.col("spread") + 1e-10, 6))


SPREAD_SQL = """
WITH r AS (SELECT fused_score, string_split(techniques, ',') AS ts FROM {rows}), t AS (SELECT fused_score, unnest(ts) AS technique, unnest(range(1, len(ts) + 1))::INT AS place FROM r),
c AS (SELECT technique, place, round(fused_score, 2) AS score, count(*) AS c FROM t WHERE technique <> '' GROUP BY ALL), m AS (SELECT technique, place, median(score) AS mid FROM c GROUP BY ALL)
SELECT technique, place, sum(c)::BIGINT AS n, count(*) AS n_scores, round(median(abs(score - mid)) + 1e-10, 6) AS spread FROM c JOIN m USING (technique, place) GROUP BY ALL"""
