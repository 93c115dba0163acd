"""Consent at the time of a record: given for an interval or without end, withdrawn, run out, or never given.

Grants, withdrawals and records of a subject and purpose are one stream in order of time. Withdrawals cut it into spans; within a span a
record is covered while the latest end of the grants before it lies ahead. So overlapping intervals need no join: one shuffle by
subject and purpose, and running sums and maxima over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Microseconds since 1970 that stand for no end.
FOREVER = 2**62
#: Consents and records in the event tables: a signup grants (for value hours, without end from 150 on), a purchase withdraws, clicks and views are records.
STREAM = f"""
SELECT event_id, user_id AS subject, CAST(get_json_object(props, '$.k') AS BIGINT) % 3 AS purpose, unix_micros(CAST(ts AS TIMESTAMP)) AS t_us,
  CASE event_type WHEN 'signup' THEN 'grant' WHEN 'purchase' THEN 'withdraw' ELSE 'record' END AS kind,
  CASE WHEN event_type = 'signup' THEN CASE WHEN value >= 150 THEN {FOREVER} ELSE unix_micros(CAST(ts AS TIMESTAMP)) + CAST(floor(value * 3600000000) AS BIGINT) END END AS until
FROM {{rows}} WHERE event_type IN ('signup', 'purchase', 'click', 'view')"""


def at_records(stream: DataFrame) -> DataFrame:
    """Of a stream (event_id, subject, purpose, t_us, kind, until) every record with its decision, the last grant of its span, and the end of its consent.

    Decisions: granted, expired, withdrawn, missing. A grant covers from its time on, up to its end without it; at equal times grants come
    before withdrawals, these before records, then by id. A null end is none; a grant that ends before it begins covers nothing. Null
    subjects, purposes and times are values like others, times the earliest.
    """
    rank = F.when(F.col("kind") == "grant", 0).when(F.col("kind") == "withdraw", 1).otherwise(2)
    order = ("t_us", "_rank", "event_id")
    rows = stream.withColumn("_rank", rank).withColumn("until", F.when(F.col("kind") == "grant", F.coalesce("until", F.lit(FOREVER))))
    so_far = Window.partitionBy("subject", "purpose").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_span", F.count_if(F.col("kind") == "withdraw").over(so_far)).withColumn("_ever", F.count_if(F.col("kind") == "grant").over(so_far))
    span = Window.partitionBy("subject", "purpose", "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_until", F.max("until").over(span)).withColumn("_by", F.last(F.when(F.col("kind") == "grant", F.col("event_id")), ignorenulls=True).over(span))
    decision = F.when(F.col("_until") > F.col("t_us"), "granted").when(F.col("_until").isNotNull(), "expired").when(F.col("_ever") > 0, "withdrawn").otherwise("missing")
    end = F.when(F.col("_until") < FOREVER, F.col("_until"))
    return rows.where("kind = 'record'").select("event_id", "subject", "purpose", decision.alias("decision"), F.col("_by").alias("granted_by"), end.alias("until"))


def decided(events: DataFrame) -> DataFrame:
    return at_records(events.sparkSession.sql(STREAM, rows=events))


#: By looking for each record's grants and withdrawals among all of its subject's.
ORACLE_SQL = f"""
WITH s AS MATERIALIZED (
  SELECT event_id, user_id AS subject, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS purpose, epoch_us(ts) AS t_us, event_type AS kind,
    CASE WHEN value >= 150 THEN {FOREVER} ELSE epoch_us(ts) + CAST(floor(value * 3600000000) AS BIGINT) END AS until
  FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'view')),
r AS (SELECT * FROM s WHERE kind IN ('click', 'view')), w AS (
  SELECT r.event_id, max(s.t_us) AS gone FROM r JOIN s ON s.subject = r.subject AND s.purpose = r.purpose AND s.kind = 'purchase' AND s.t_us <= r.t_us GROUP BY r.event_id),
g AS (
  SELECT r.event_id, count(*) AS ever, max(s.until) FILTER (WHERE s.t_us > coalesce(gone, -1)) AS until, arg_max(s.event_id, s.t_us) FILTER (WHERE s.t_us > coalesce(gone, -1)) AS by_id
  FROM r JOIN s ON s.subject = r.subject AND s.purpose = r.purpose AND s.kind = 'signup' AND s.t_us <= r.t_us LEFT JOIN w ON w.event_id = r.event_id GROUP BY r.event_id)
SELECT r.event_id, r.subject, r.purpose, CASE WHEN g.until > r.t_us THEN 'granted' WHEN g.until IS NOT NULL THEN 'expired' WHEN g.ever > 0 THEN 'withdrawn' ELSE 'missing' END AS decision,
  g.by_id AS granted_by, CASE WHEN g.until < {FOREVER} THEN g.until END AS until
FROM r LEFT JOIN g ON g.event_id = r.event_id"""
