"""The detector panel over a stream, with each function's history carried from batch to batch.

A record is settled once the latest record seen is ``LATENESS`` past it; what comes after that for an earlier time is dropped as late.
Settled records are numbered within their function by time and appended to the history in the shared folder; their votes come from the
panel over the history of the functions that the batch settles. So how the input is split into files or batches changes no vote: those of
settled records are the panel's over all records that weren't late. Every table of a batch is named by its number and written whole,
so a batch that is run again replaces what it wrote.

A batch reads the history of its functions alone, and its cost grows with that. Records without a time never settle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytally.operators import detectors
from skytally.sources.shared import work_path

#: Microseconds that a record may be late by.
LATENESS = 5_000_000
FIELDS = "event_id long, t_us long, function_id string, phase string, anomaly_type string, duration double, memory double, cpu double, network double, truth boolean"
_NUMBERED = f"{FIELDS}, number long"


class Carried:
    """What a stream of telemetry has settled so far, by batch, under one folder."""

    def __init__(self, spark: SparkSession, path: str, votes: Callable[[DataFrame], DataFrame] = detectors.votes, lateness: int = LATENESS):
        self.spark, self.path, self.votes, self.lateness, self.schema = spark, path, votes, lateness, None

    def _read(self, name: str, schema: str, batches: range) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/batch={k}" for k in batches))

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Settle what can be settled with the records of a batch, and write its votes; for ``foreachBatch``."""
        before = self._read("latest", "t_us long", range(max(0, batch - 1), batch)).first() if batch else None
        before = before["t_us"] if before else None
        fresh = rows.select(*(c.split()[0] for c in FIELDS.split(", "))).where("t_us IS NOT NULL")
        if before is not None:
            fresh = fresh.where(F.col("t_us") > before - self.lateness)
        found = fresh.agg(F.max("t_us").alias("t")).first()["t"]
        latest = max((t for t in (before, found) if t is not None), default=None)
        waiting = self._read("waiting", FIELDS, range(max(0, batch - 1), batch)).unionByName(fresh)
        due = F.lit(False) if latest is None else F.col("t_us") <= latest - self.lateness
        history = self._read("settled", _NUMBERED, range(batch))

        last = history.groupBy("function_id").agg(F.max("number").alias("_last"))
        own = F.row_number().over(Window.partitionBy("function_id").orderBy("t_us", "event_id"))
        now = waiting.where(due).withColumn("number", own).alias("a").join(last.alias("b"), F.expr("a.function_id <=> b.function_id"), "left")
        self._write(now.select(*(F.col(f"a.{c.split()[0]}") for c in FIELDS.split(", ")), (F.col("number") + F.coalesce("_last", F.lit(0))).alias("number")), "settled", batch)
        new = self._read("settled", _NUMBERED, range(batch, batch + 1))
        of = new.select("function_id").distinct().alias("f")
        past = history.alias("h").join(of, F.expr("h.function_id <=> f.function_id"), "left_semi")
        # The panel orders a function's records by id: here their number by time stands for it.
        judged = self.votes(past.unionByName(new).drop("event_id").withColumnRenamed("number", "event_id")).alias("v")
        ids = new.select(F.col("function_id").alias("_f"), F.col("number").alias("_n"), F.col("event_id").alias("_id")).alias("i")
        out = judged.join(ids, F.expr("v.function_id <=> i._f AND v.event_id = i._n")).withColumn("event_id", F.col("_id")).drop("_f", "_n", "_id")
        self.schema = out.schema
        self._write(out, "votes", batch)
        self._write(waiting.where(~due), "waiting", batch)
        self._write(self.spark.createDataFrame([] if latest is None else [(latest,)], "t_us long"), "latest", batch)

    def results(self, batches: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/votes/batch={k}" for k in range(batches)))


def settled_votes(stream: DataFrame, votes: Callable[[DataFrame], DataFrame] = detectors.votes, lateness: int = LATENESS) -> DataFrame:
    """Runs the panel over what a stream holds now: the votes of all settled records, each record once."""
    spark = stream.sparkSession
    path = work_path(spark, "stream-votes")
    carried, ran = Carried(spark, path, votes, lateness), []

    def each(batch: DataFrame, number: int) -> None:
        carried.add(batch, number)
        ran.append(number)

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    if not ran:
        carried.add(spark.createDataFrame([], FIELDS), 0)
    return carried.results(max(ran, default=0) + 1)
