"""Structured Streaming over telemetry: windows with watermarks, duplicates, and detectors per micro-batch.

Every function takes a streaming (or batch) DataFrame of the telemetry view with an event-time column ``at``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.sources.shared import work_path
from skytally.sources.telemetry import telemetry

#: A window is given out once this long has passed, and records later than that are dropped with their window's state.
LATENESS = "5 seconds"


def source(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """A stream of telemetry from Parquet files of events as they arrive."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return with_time(telemetry(events))


def with_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.timestamp_micros("t_us"))


def _counted(rows: DataFrame, window) -> DataFrame:
    made = rows.withWatermark("at", LATENESS).groupBy(window.alias("w"), "function_id").agg(
        F.count("*").alias("n"), F.round(F.avg("duration") + 1e-10, 4).alias("mean_duration"), F.max("duration").alias("max_duration"), F.count_if("truth").alias("errors")
    )
    micros = lambda c: F.unix_micros(F.col(c))
    return made.select(micros("w.start").alias("start_us"), micros("w.end").alias("end_us"), "function_id", "n", "mean_duration", "max_duration", "errors")


def tumbling(rows: DataFrame, size: str = "30 seconds") -> DataFrame:
    return _counted(rows, F.window("at", size))


def sliding(rows: DataFrame, size: str = "30 seconds", step: str = "10 seconds") -> DataFrame:
    """Every record falls in each window that covers it."""
    return _counted(rows, F.window("at", size, step))


def sessions(rows: DataFrame, gap: str = "30 seconds") -> DataFrame:
    return _counted(rows, F.session_window("at", gap))


def global_window(rows: DataFrame) -> DataFrame:
    """All records of each partition of the stream so far: one group for each of four parts of the functions (see ``partition_of``)."""
    part = rows.withColumn("part", partition_of(F.col("function_id")))
    return part.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("duration") + 1e-10, 4).alias("mean_duration"), F.max("duration").alias("max_duration"), F.count_if("truth").alias("errors"))


def partition_of(function_id: Column, parts: int = 4) -> Column:
    """The first eight hexadecimal digits of the name's digest, modulo the parts."""
    return (F.conv(F.substring(F.md5(function_id), 1, 8), 16, 10).cast("long") % parts).cast("int")


def deduplicated(rows: DataFrame) -> DataFrame:
    """The first record of each id within the watermark."""
    return rows.withWatermark("at", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what there is now and returns its rows; each micro-batch is written once, by its number, so a repeated one replaces itself."""
    spark = stream.sparkSession
    out, state = work_path(spark, "stream"), work_path(spark, "stream-state")
    schema = None

    def write(batch: DataFrame, number: int) -> None:
        nonlocal schema
        rows = each(batch) if each else batch
        schema = rows.schema
        rows.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if schema is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(schema).parquet(*(f"{out}/batch={k}" for k in ([0] if mode == "complete" else sorted(_batches(spark, out)))))


def _batches(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return [int(f.getPath().getName().partition("=")[2]) for f in files]
