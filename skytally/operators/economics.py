"""Cost histories: spikes, autocorrelation, bursts, trend and risk per function."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill

_LAGS = (2, 3, 4, 5, 6, 7, 12, 24)
#: Price of an invocation: a request fee and memory seconds (values of a published price list).
COST = "0.0000002 + 0.0000166667 * duration * (memory / 1048576.0)"

COSTS = f"SELECT event_id, function_id, t_us, row_number() OVER (PARTITION BY function_id ORDER BY event_id) AS n, 1000000.0 * ({COST}) AS cost FROM {{rows}}"
_BASE = f"WITH costs AS ({COSTS})"

#: Three kinds of spikes and their union: mean + 3 sd, upper fence, and 3 scaled median deviations.
SPIKES = f"""
{_BASE}, stats AS (SELECT function_id, avg(cost) AS m, stddev_pop(cost) AS s, <percentile>(cost, 0.25) AS q1, <percentile>(cost, 0.5) AS med, <percentile>(cost, 0.75) AS q3 FROM costs GROUP BY function_id),
away AS (SELECT costs.*, m, s, q1, q3, med, abs(cost - med) AS off FROM costs JOIN stats ON costs.function_id = stats.function_id),
spread AS (SELECT function_id, <percentile>(off, 0.5) AS mad FROM away GROUP BY function_id),
judged AS (
  SELECT event_id, away.function_id, cost, s > 0 AND abs(cost - m) / s > 3.0 AS z_spike, cost > q3 + 1.5 * (q3 - q1) AS iqr_spike, mad > 0 AND off / (1.4826 * mad) > 3.0 AS mad_spike
  FROM away JOIN spread ON away.function_id = spread.function_id
)
SELECT event_id, function_id, round(cost, 4) AS cost, z_spike, iqr_spike, mad_spike FROM judged WHERE z_spike OR iqr_spike OR mad_spike
"""

#: Autocorrelation of the costs at the lags of interest, the strongest lag, trend, volatility, bursts of the last 5 against all.
PROFILE = f"""
{_BASE}, lagged AS (
  SELECT *, avg(cost) OVER (PARTITION BY function_id) AS m, {", ".join(f"lag(cost, {k}) OVER (PARTITION BY function_id ORDER BY n) AS l{k}" for k in _LAGS)}, lag(cost) OVER (PARTITION BY function_id ORDER BY n) AS l1,
    var_pop(cost) OVER (PARTITION BY function_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v5
  FROM costs
)
SELECT function_id, count(*) AS n, round(avg(cost), 4) AS mean_cost, round(stddev_pop(cost), 4) AS sd_cost, round(sum(cost), 2) AS total_cost, round(regr_slope(cost, n), 6) AS trend,
  round(stddev_pop(CASE WHEN l1 > 0 THEN (cost - l1) / l1 END), 4) AS volatility, CAST(sum(CASE WHEN v5 > 0 AND n >= 5 AND v5 > 1e4 THEN 1 ELSE 0 END) AS BIGINT) AS bursts,
  {", ".join(f"round(sum((cost - m) * (l{k} - m)) / sum((cost - m) * (cost - m)), 4) AS ac_{k}" for k in _LAGS)}
FROM lagged GROUP BY function_id
"""

#: Abuse indicators by function against the whole: rate, duration, memory and error ratios, and the risk they add up to.
RISK = """
WITH per AS (
  SELECT function_id, count(*) * 1e0 AS n, avg(duration) AS d, avg(memory) AS m, avg(cpu) AS u, avg(CASE WHEN truth THEN 1e0 ELSE 0e0 END) AS e, (max(t_us) - min(t_us)) / 6e7 AS minutes FROM {rows} GROUP BY function_id
), whole AS (SELECT avg(n) AS n, avg(d) AS d, avg(m) AS m, avg(u) AS u FROM per)
SELECT function_id, round(per.n / nullif(minutes, 0), 4) AS per_minute, round(per.d / whole.d, 4) AS duration_ratio, round(per.m / whole.m, 4) AS memory_ratio, round(per.u / whole.u, 4) AS cpu_ratio, round(e, 4) AS error_rate,
  round(least(1.0, 0.3 * least(per.n / whole.n, 2.0) / 2.0 + 0.3 * least(per.d / whole.d, 2.0) / 2.0 + 0.2 * least(per.m / whole.m, 2.0) / 2.0 + 0.2 * e), 4) AS risk
FROM per JOIN whole ON true
"""


def _run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)


def spikes(telemetry: DataFrame) -> DataFrame:
    return _run(SPIKES, telemetry)


def profile(telemetry: DataFrame) -> DataFrame:
    return _run(PROFILE, telemetry)


def risk(telemetry: DataFrame) -> DataFrame:
    return _run(RISK, telemetry)
