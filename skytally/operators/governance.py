"""Record hygiene: validation, sanitising, redaction, preservation, batch quality, duplicates, health."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skytally.functions.dialect import SPARK, fill

# Ranges and enumerations.
#: Rules as (name, SQL that is true for a violation); all violations of a record are listed.
RULES = (
    ("duration_range", "duration < 0 OR duration > 900"),
    ("memory_range", "memory < 0 OR memory > 3080192"),
    ("cpu_range", "cpu < 0 OR cpu > 100"),
    ("network_range", "network < 0 OR network > 1073741824"),
    ("phase_enum", "phase NOT IN ('init', 'invoke', 'shutdown', 'error', 'timeout')"),
    ("function_missing", "function_id IS NULL OR function_id = ''"),
    ("error_unlabelled", "phase = 'error' AND anomaly_type = 'benign'"),
    ("busy_but_idle", "duration > 30 AND cpu < 1"),
)
VALIDATE = f"""
SELECT event_id, violations, n_violations, n_violations = 0 AS valid, round(greatest(0.0, 1.0 - 0.3 * n_violations), 4) AS quality
FROM (
  SELECT event_id, concat_ws(',', {", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in RULES)}) AS violations, {" + ".join(f"CASE WHEN {v} THEN 1 ELSE 0 END" for _, v in RULES)} AS n_violations FROM {{rows}}
) AS checked"""

#: One row of batch quality: completeness, accuracy, consistency, validity, integrity and their weighted score (fixed weights, the rest of the weight is timeliness, taken as 1 for stored data).
QUALITY = """
SELECT completeness, accuracy, consistency, validity, score, CASE WHEN score >= 0.95 THEN 'excellent' WHEN score >= 0.85 THEN 'good' WHEN score >= 0.75 THEN 'acceptable' WHEN score >= 0.6 THEN 'poor' ELSE 'critical' END AS level
FROM (
  SELECT *, round(0.25 * completeness + 0.25 * accuracy + 0.2 * consistency + 0.15 + 0.1 * validity + 0.05, 4) AS score
  FROM (
    SELECT round((count(function_id) + count(phase) + count(anomaly_type) + count(duration) + count(memory) + count(cpu) + count(network)) / (7e0 * count(*)), 4) AS completeness,
      round(avg(CASE WHEN duration BETWEEN 0 AND 900 AND cpu BETWEEN 0 AND 100 AND memory >= 0 THEN 1e0 ELSE 0e0 END), 4) AS accuracy, round(0.4 + 0.3 / count(DISTINCT anomaly_type) + 0.3 / count(DISTINCT phase), 4) AS consistency,
      round(avg(CASE WHEN phase IN ('init', 'invoke', 'shutdown', 'error', 'timeout') THEN 1e0 ELSE 0e0 END), 4) AS validity
    FROM {rows}
  ) AS parts
) AS scored"""

#: Incidents of each function: runs of failures at most five minutes apart (gaps and islands), and time to recovery.
INCIDENTS = """
WITH marked AS (SELECT function_id, event_id, t_us, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY function_id ORDER BY t_us, event_id) <= 300000000 THEN 0 ELSE 1 END AS fresh FROM {rows} WHERE truth),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY function_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked)
SELECT function_id, count(*) AS incidents, round(avg(seconds), 4) AS mttr, round(max(seconds), 4) AS longest, CAST(sum(n) AS BIGINT) AS failures, count(*) >= 3 AND avg(seconds) <= 300 AS in_target
FROM (SELECT function_id, island, (max(t_us) - min(t_us)) / 1e6 AS seconds, count(*) AS n FROM islands GROUP BY function_id, island) AS each_one
GROUP BY function_id"""

#: Repeats of a record's content within a second after another one of its function.
REPEATS = """
SELECT event_id, function_id, t_us - before_us AS after_us FROM (
  SELECT event_id, function_id, t_us, lag(t_us) OVER (PARTITION BY function_id, phase, anomaly_type ORDER BY t_us, event_id) AS before_us FROM {rows}
) AS ordered WHERE t_us - before_us <= 1000000"""


def _run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)


def validate(telemetry: DataFrame) -> DataFrame:
    return _run(VALIDATE, telemetry)


def batch_quality(telemetry: DataFrame) -> DataFrame:
    return _run(QUALITY, telemetry)


def incidents(telemetry: DataFrame) -> DataFrame:
    return _run(INCIDENTS, telemetry)


def repeats(telemetry: DataFrame) -> DataFrame:
    return _run(REPEATS, telemetry)


def sanitise(text: Column) -> Column:
    """Zero-width characters and scripts out, shell marks out, HTML escaped."""
    out = F.regexp_replace(text, "[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]", "")
    out = F.regexp_replace(out, "(?is)<script[^>]*>.*?</script>", "")
    out = F.translate(out, ";&|$`", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def looks_like_sql(text: Column) -> Column:
    return text.rlike("(?i)\\b(select|insert|update|delete|drop|create|alter|truncate|union|exec)\\b")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility-normalised text, for which Spark has no function; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_path(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts and without a leading slash."""
    return F.array_join(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def clean_url(url: Column) -> Column:
    """Allowed schemes only, without credentials; null otherwise."""
    return F.when(F.lower(url).rlike("^https?://"), F.regexp_replace(url, "^(https?://)[^/?#@]*@", "$1"))


#: Redaction patterns in order.
PATTERNS = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("CARD", r"\b[0-9]{16}\b"),
    ("PHONE", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
)


def redact(text: Column) -> Column:
    """Matches of the patterns, one after the other, as [REDACTED_<kind>]."""
    for kind, pattern in PATTERNS:
        text = F.regexp_replace(text, pattern, f"[REDACTED_{kind}]")
    return text


def redaction_report(docs: DataFrame) -> DataFrame:
    """Counts of each mark after redaction, and a digest of the redacted text."""
    rows = docs.select("doc_id", redact(F.col("text")).alias("clean"))
    counts = [((F.length("clean") - F.length(F.replace(F.col("clean"), F.lit(f"[REDACTED_{k}]"), F.lit("")))) / len(f"[REDACTED_{k}]")).cast("long").alias(f"n_{k.lower()}") for k, _ in PATTERNS]
    return rows.select("doc_id", *counts, F.md5("clean").alias("digest"))


def preserved(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = ("duration", "memory", "cpu", "network", "phase", "function_id")) -> DataFrame:
    """Share of the fields that a transform left as they were (numbers within 1e-9), and those at risk."""
    both = before.alias("b").join(after.alias("a"), "event_id")
    numeric = {f for f, t in before.dtypes if t in ("double", "bigint", "int")}
    same = [F.coalesce(F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) <= 1e-9, F.col(f"a.{f}").isNull() & F.col(f"b.{f}").isNull()) if f in numeric else F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields]
    score = sum((s.cast("int") for s in same), F.lit(0)) / len(fields)
    return both.select("event_id", F.round(score, 4).alias("score"), F.array_compact(F.array(*(F.when(~s, F.lit(f)) for s, f in zip(same, fields, strict=True)))).alias("at_risk"))
