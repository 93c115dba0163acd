"""Silent failures and execution properties: robust outliers, trace order, completeness, temporal properties over ordered traces."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill

#: Risks of a record that succeeded: robust z of its measures over 6, too quick for its work, idle but long; fused to a probability.
PROBABILITY = """
WITH med AS (SELECT function_id, <percentile>(duration, 0.5) AS d, <percentile>(network, 0.5) AS w FROM {rows} GROUP BY function_id),
off AS (SELECT r.*, med.d, med.w, abs(duration - d) AS od, abs(network - w) AS ow FROM {rows} r JOIN med ON r.function_id = med.function_id),
mad AS (SELECT function_id, <percentile>(od, 0.5) AS md, <percentile>(ow, 0.5) AS mw FROM off GROUP BY function_id),
risks AS (
  SELECT event_id, off.function_id, CASE WHEN md > 0 AND od / (1.4826 * md) > 6.0 OR mw > 0 AND ow / (1.4826 * mw) > 6.0 THEN 1.0 ELSE 0.0 END AS corruption, CASE WHEN duration < 0.2 * d AND network > w THEN 1.0 ELSE 0.0 END AS inconsistent,
    CASE WHEN cpu < 5 AND duration > 2.0 * d THEN 1.0 ELSE 0.0 END AS idle, CASE WHEN network = 0 AND w > 0 THEN 1.0 ELSE 0.0 END AS no_output
  FROM off JOIN mad ON off.function_id = mad.function_id WHERE phase <> 'error'
), fused AS (SELECT *, 0.15 + 0.85 * (0.4 * corruption + 0.25 * inconsistent + 0.2 * idle + 0.15 * no_output) AS p FROM risks)
SELECT event_id, function_id, corruption, inconsistent, idle, no_output, round(p, 4) AS probability, round(1.0 - exp(-3.0 * p * p * (3.0 - 2.0 * p)), 4) AS calibrated FROM fused WHERE corruption + inconsistent + idle + no_output > 0"""

#: Dialogue traces: turns without gaps, roles that alternate after a leading system turn, empty turns.
TRACES = """
WITH ordered AS (SELECT conv_id, turn, role, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before_turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_role FROM {rows})
SELECT conv_id, count(*) AS turns, CAST(sum(CASE WHEN before_turn IS NOT NULL AND turn <> before_turn + 1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, CAST(sum(CASE WHEN role = before_role THEN 1 ELSE 0 END) AS BIGINT) AS repeats,
  CAST(sum(CASE WHEN role = 'system' AND before_role IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS late_system, CAST(sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_turns
FROM ordered GROUP BY conv_id"""

#: Finite-trace temporal properties of each function: always(cpu within bounds), eventually(shutdown), every error is followed within five records by success, init directly before invoke at least once, no error until the first init.
PROPERTIES = """
WITH steps AS (
  SELECT *, lead(phase) OVER (PARTITION BY function_id ORDER BY event_id) AS after_phase, max(CASE WHEN NOT truth THEN 1 ELSE 0 END) OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS recovers,
    max(CASE WHEN phase = 'init' THEN 1 ELSE 0 END) OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun
  FROM {rows}
)
SELECT function_id, min(CASE WHEN cpu BETWEEN 0 AND 100 THEN 1 ELSE 0 END) = 1 AS always_bounded, max(CASE WHEN phase = 'shutdown' THEN 1 ELSE 0 END) = 1 AS eventually_shut, min(CASE WHEN truth AND coalesce(recovers, 0) = 0 THEN 0 ELSE 1 END) = 1 AS errors_recover,
  max(CASE WHEN phase = 'init' AND after_phase = 'invoke' THEN 1 ELSE 0 END) = 1 AS init_then_invoke, max(CASE WHEN truth AND begun = 0 THEN 1 ELSE 0 END) = 0 AS no_error_until_init
FROM steps GROUP BY function_id"""

#: Causal pairs inside a function: an error and all that follows it within five minutes, weighted by time, phase and outcome; an equi-join on time buckets (own and next) with the exact condition left over.
PAIRS = """
WITH slots AS (SELECT event_id, function_id, t_us, phase, t_us <div> 300000000 AS bucket FROM {rows} WHERE truth UNION ALL SELECT event_id, function_id, t_us, phase, t_us <div> 300000000 + 1 AS bucket FROM {rows} WHERE truth),
records AS (SELECT event_id, function_id, t_us, phase, truth, t_us <div> 300000000 AS bucket FROM {rows})
SELECT a.event_id AS source, b.event_id AS target, b.function_id, round(0.5 * exp(-(b.t_us - a.t_us) / 6e7) + 0.2 * CASE WHEN b.phase = a.phase THEN 1.0 ELSE 0.0 END + 0.3 * CASE WHEN b.truth THEN 1.0 ELSE 0.0 END, 4) AS confidence
FROM slots a JOIN records b ON a.function_id = b.function_id AND a.bucket = b.bucket AND b.t_us > a.t_us AND b.t_us - a.t_us <= 300000000"""

#: The same for Spark, in slots of half the time; a double is rounded without going by its decimal text.
PAIRS_JOINED = """
WITH slots AS (SELECT event_id, function_id, t_us, phase, <explode:<sequence:t_us <div> 150000000, t_us <div> 150000000 + 2>> AS bucket FROM {rows} WHERE truth),
records AS (SELECT event_id, function_id, t_us, phase, truth, t_us <div> 150000000 AS bucket FROM {rows})
SELECT a.event_id AS source, b.event_id AS target, b.function_id, floor((0.5 * exp(-(b.t_us - a.t_us) / 6e7) + 0.2 * CASE WHEN b.phase = a.phase THEN 1.0 ELSE 0.0 END + 0.3 * CASE WHEN b.truth THEN 1.0 ELSE 0.0 END) * 10000.0 + 0.5) / 10000.0 AS confidence
FROM slots a JOIN records b ON a.function_id = b.function_id AND a.bucket = b.bucket AND b.t_us > a.t_us AND b.t_us - a.t_us <= 300000000"""

#: Text shape: entropy of the characters, counted inside the text's row, and the codec that suits it.
ENTROPY = """
WITH chars AS (SELECT doc_id, length(text) AS n_chars, <counted:text> AS counts FROM {rows} WHERE text <> ''),
bits AS (SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(<size:counts> AS BIGINT) AS n_kinds, round(<entropy:counts> + 1e-10, 4) AS entropy FROM chars)
SELECT *, CASE WHEN entropy < 3.5 THEN 'zstd' WHEN entropy < 5.0 THEN 'snappy' ELSE 'none' END AS codec FROM bits"""


def run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)
