"""Records one by one: digests and priorities, redacted forms, field transforms, checks of values, latest consent."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill

#: Digest of a record's canonical text, its severity by kind, whether it is critical, and how soon it goes out (10 critical, 8 high, 6 medium, 3 low).
EMISSION = """
SELECT event_id, <sha256:concat_ws('|', CAST(event_id AS <string>), function_id, CAST(t_us AS <string>), phase, anomaly_type)> AS digest, severity, critical, CASE WHEN critical THEN 10 WHEN severity >= 5 THEN 8 WHEN severity >= 2 THEN 6 ELSE 3 END AS priority
FROM (
  SELECT *, severity >= 8 OR severity >= 6 AND cpu >= 80 AS critical
  FROM (SELECT *, CASE anomaly_type WHEN 'benign' THEN 0 WHEN 'cpu_burst' THEN 2 WHEN 'memory_spike' THEN 3 WHEN 'execution_failure' THEN 6 ELSE 5 END AS severity FROM {rows}) AS weighed
) AS judged"""

#: Forms of a redacted identifier: masked in part or whole, hashed, pseudonymous, generalised.
REDACTED = """
SELECT event_id, concat(substr(function_id, 1, 3), repeat('*', greatest(0, length(function_id) - 3))) AS partial_mask, repeat('*', length(function_id)) AS full_mask, substr(<sha256:function_id>, 1, 16) AS hashed,
  concat('[PSEUDO:', substr(<sha256:concat('salt', function_id)>, 1, 16), ']') AS pseudonym, CAST(floor(memory / 65536.0) AS BIGINT) AS memory_band
FROM {rows}"""

#: Named field transforms.
MAPPED = """
SELECT event_id, upper(function_id) AS upper_name, lower(anomaly_type) AS lower_type, concat(upper(substr(phase, 1, 1)), lower(substr(phase, 2))) AS capital_phase, round(duration, 1) AS rounded, abs(duration - 5.0) AS away, round(sqrt(memory), 4) AS root_memory,
  md5(function_id) AS digest, replace(function_id, '-', '_') AS safe_name, length(anomaly_type) AS type_length, coalesce(nullif(anomaly_type, 'benign'), 'none') AS alias, CAST(duration AS BIGINT) AS whole_seconds, t_us <div> 1000000 AS epoch_seconds
FROM {rows}""".replace("CAST(duration AS BIGINT)", "CAST(floor(duration) AS BIGINT)")

#: Checks of page addresses: form, scheme, a numeric host, a query, odd characters, length.
ADDRESSES = """
SELECT page_id, <matches:url, '^https?://[^/?# ]+'> AS is_url, <matches:url, '^https://'> AS secure, <matches:url, '^[a-z]+://[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+([:/?#]|$)'> AS numeric_host, <matches:url, '[?][^#]'> AS has_query, <matches:url, '[^ -~]'> AS not_ascii, length(url) <= 2048 AS in_length
FROM {rows}"""

#: Latest state of each function and kind of record (consent as of the last record), and how many records it covers.
CONSENT = """
SELECT function_id, anomaly_type, phase, event_id AS decided_by, phase <> 'error' AS granted, n FROM (
  SELECT function_id, anomaly_type, max_by(phase, event_id) AS phase, max(event_id) AS event_id, count(*) AS n FROM {rows} GROUP BY function_id, anomaly_type
) AS latest"""


def run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)
