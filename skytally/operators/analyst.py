"""Analyst questions over stored detections: lists, mixes, histograms, roll-ups, technique maps, cases and the audit chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

#: Decisions in order of severity.
RANK = {"observe": 0, "review": 1, "escalate": 2}
HOUR = 3_600_000_000


def rank_of(decision: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, k in RANK.items():
        out = F.when(decision == name, k).otherwise(out)
    return out


def list_detections(
    detections: DataFrame, *, decision: str | None = None, function_id: str | None = None, since_us: int | None = None, until_us: int | None = None, technique: str | None = None,
    text: str | None = None, attached: DataFrame | None = None, unattached: bool = False, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of detections, newest first: equality filters, a half-open time range, a technique, a case-insensitive search, and cases."""
    rows = detections
    for column, value in (("decision", decision), ("function_id", function_id)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    rows = rows.where(F.col("t_us") >= since_us) if since_us is not None else rows
    rows = rows.where(F.col("t_us") < until_us) if until_us is not None else rows
    rows = rows.where(F.array_contains(F.split("techniques", ","), technique)) if technique else rows
    if text:
        rows = rows.where(F.greatest(*(F.contains(F.lower(F.col(c)), F.lit(text.lower())).cast("int") for c in ("function_id", "anomaly_type", "decision"))) == 1)
    if attached is not None:
        rows = rows.join(attached.select("event_id").distinct(), "event_id", "left_anti" if unattached else "left_semi")
    return rows.orderBy(F.desc("t_us"), F.desc("event_id")).offset(offset).limit(limit)


def severity_mix(detections: DataFrame) -> DataFrame:
    """Count by decision; decisions that don't occur have 0."""
    domain = detections.sparkSession.createDataFrame([(k,) for k in RANK], "decision string")
    counts = detections.groupBy("decision").agg(F.count("*").alias("n"))
    return domain.join(counts, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(detections: DataFrame, *, bin_us: int = HOUR, by: Sequence[str] = ()) -> DataFrame:
    """Counts by time bin (aligned to the epoch) and decision, without gaps between the first and last bin of each group."""
    bins = F.floor(F.col("t_us") / bin_us) * bin_us
    counts = detections.groupBy(*by, bins.alias("bin")).agg(*(F.count_if(F.col("decision") == k).alias(k) for k in RANK))
    span = counts.groupBy(*by).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    spine = span.select(*by, F.explode(F.sequence("lo", "hi", F.lit(bin_us))).alias("bin"))
    joined = spine.join(counts, [*by, "bin"], "left")
    return joined.select(*by, "bin", *(F.coalesce(k, F.lit(0)).alias(k) for k in RANK))


def function_rollup(detections: DataFrame, *, now_us: int | None = None, day_us: int = 24 * HOUR) -> DataFrame:
    """Per function: detections, those of the last day and week, last time, mean score, worst decision, techniques."""
    latest = detections.agg(F.max("t_us").alias("now")) if now_us is None else None
    rows = detections.join(F.broadcast(latest)) if latest is not None else detections.withColumn("now", F.lit(now_us).cast("long"))
    some = rows.withColumn("technique", F.explode(F.split("techniques", ","))).groupBy("function_id").agg(F.array_join(F.sort_array(F.collect_set("technique")), ",").alias("techniques"))
    out = rows.groupBy("function_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("t_us") > F.col("now") - day_us).alias("n_day"), F.count_if(F.col("t_us") > F.col("now") - 7 * day_us).alias("n_week"), F.max("t_us").alias("last_us"),
        F.round(F.avg("fused_score"), 4).alias("mean_score"), F.max_by("decision", rank_of(F.col("decision"))).alias("worst"),
    )
    return out.join(some, "function_id", "left")


def threat_map(detections: DataFrame, grid: DataFrame) -> DataFrame:
    """Counts and worst decision by technique over the fixed ``grid`` (tactic, technique); cells without detections have 0."""
    used = detections.select("decision", F.explode(F.split("techniques", ",")).alias("technique"))
    counts = used.groupBy("technique").agg(F.count("*").alias("n"), F.max_by("decision", rank_of(F.col("decision"))).alias("worst"))
    return grid.join(counts, "technique", "left").select("tactic", "technique", F.coalesce("n", F.lit(0)).alias("n"), "worst")


def technique_top(detections: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent techniques by function, then by name."""
    counts = detections.select("function_id", F.explode(F.split("techniques", ",")).alias("technique")).groupBy("function_id", "technique").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("function_id").orderBy(F.desc("n"), "technique"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def case_state(events: DataFrame) -> DataFrame:
    """Latest state of each case from its events (case_id, version, status, detection_id, change): status, version, attached detections."""
    last = events.groupBy("case_id").agg(F.max_by("status", "version").alias("status"), F.max("version").alias("version"))
    held = events.where("detection_id IS NOT NULL").groupBy("case_id", "detection_id").agg(F.max_by("change", "version").alias("change"))
    n = held.where("change = 'attach'").groupBy("case_id").agg(F.count("*").alias("n_detections"))
    return last.join(n, "case_id", "left").select("case_id", "status", "version", F.coalesce("n_detections", F.lit(0)).alias("n_detections"))


def audit_chain(rows: DataFrame, *, by: str = "actor", order: Sequence[str] = ("ts", "id"), payload: str = "payload") -> DataFrame:
    """``rows`` with prev_hash, the hash of the row before in its chain, and row_hash, over prev_hash and the payload.

    So a change shows in all that follows. A chain is appended row by row, by one task a chain; several chains spread over tasks.
    """
    schema = StructType([*rows.schema.fields, StructField("prev_hash", StringType()), StructField("row_hash", StringType())])
    own, at = rows.columns.index(by), rows.columns.index(payload)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = None, ""
        for batch in batches:
            before, after = [], []
            for key, text in zip(batch.column(own).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if (key,) != chain:
                    chain, last = (key,), ""
                before.append(last)
                last = hashlib.sha256(f"{last}|{text or ''}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(after)], schema.names)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(work, schema)


def broken_links(chain: DataFrame, *, by: str = "actor", order: Sequence[str] = ("ts", "id"), payload: str = "payload") -> DataFrame:
    """First row of each chain that doesn't follow from the one before it or from its own payload, and how many don't; unbroken chains have no row.

    Checking needs no fold: each row is held against its neighbour's stored hash and its own text.
    """
    before = F.coalesce(F.lag("row_hash").over(Window.partitionBy(by).orderBy(*order)), F.lit(""))
    own = F.sha2(F.concat(F.col("prev_hash"), F.lit("|"), F.coalesce(payload, F.lit(""))), 256)
    bad = chain.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("prev_hash")) | ~own.eqNullSafe(F.col("row_hash")))
    return bad.groupBy(by).agg(F.min_by(order[-1], F.struct(*order)).alias("first_broken"), F.count("*").alias("n_broken"))


def keep_newest(rows: DataFrame, n: int, *, by: str, order: str, ties: str = "event_id") -> DataFrame:
    """The newest ``n`` rows of each group; of equally new ones those with the larger ``ties``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), F.desc(ties)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
