"""The canonical telemetry view, and readers for event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skytally.functions.dialect import DUCKDB, SPARK, fill

#: Columns of the view, from ``events`` (event_id, ts, user_id, event_type, value, props). Time runs 60 times faster, so that short windows are populated.
VIEW = """
SELECT event_id, <micros> <div> 60 AS t_us, concat('fn-', CAST(user_id % 20 AS <string>)) AS function_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'init' WHEN 'purchase' THEN 'shutdown' ELSE 'invoke' END AS phase,
  CASE WHEN event_type = 'error' THEN 'execution_failure' WHEN value >= 150 THEN 'memory_spike' WHEN value >= 115 THEN 'cpu_burst' ELSE 'benign' END AS anomaly_type,
  value / 10.0 AS duration, CAST(<json_k> * 2048 AS DOUBLE) AS memory, CAST((<json_k> * 7 + user_id) % 101 AS DOUBLE) AS cpu,
  CAST(floor(value * <json_k> * 1024) AS DOUBLE) AS network, event_type = 'error' AS truth
FROM {events}
"""


def telemetry(events: DataFrame) -> DataFrame:
    """Event rows as telemetry records: arrival order is event_id, event time t_us; one row per event, nulls stay null."""
    return events.sparkSession.sql(fill(VIEW, SPARK), events=events)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark.read.parquet(f"{sf_dir}/events.parquet"))


ORACLE_VIEW = fill(VIEW, DUCKDB).format(events="events")


def read_events(spark: SparkSession, path: str, kind: str = "json", schema: str | None = None) -> DataFrame:
    """Event files (json, plain or gzipped; csv; parquet; orc) of one schema; compressed by suffix as Spark reads them."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "json":
        return reader.option("multiLine", False).json(path)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(kind).load(path)


def write_rows(rows: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Sinks: parquet, json, csv (with a header) or orc, by partition columns where given."""
    writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
    writer.option("header", True).format(kind).save(path)
