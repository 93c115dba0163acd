"""Adaptive sampling: rolling profiles per function, phase inference, rates, and deterministic draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill
from skytally.operators.order_statistics import running_percentiles

#: Records of a function that a profile looks back on. Fixed value.
FRAME = 1000
_W = f"OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN {FRAME - 1} PRECEDING AND CURRENT ROW)"
_H = "OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_O = "OVER (PARTITION BY function_id ORDER BY event_id)"
#: The profile's measures as sliding windows, and as differences of running sums: a window engine adds every frame anew, sums grow with the frame.
WINDOWED = f"""
  SELECT event_id, function_id, t_us, phase, duration, memory, cpu, truth, avg(duration) {_W} AS mean_d, <percentile>(duration, 0.5) {_W} AS p50, <percentile>(duration, 0.95) {_W} AS p95, avg(memory) {_W} AS mean_m, max(memory) {_W} AS max_m, avg(cpu) {_W} AS mean_c,
    (t_us - lag(t_us) {_O}) / 1e6 AS idle, count(*) {_W} AS seen, avg(CASE WHEN truth THEN 1e0 ELSE 0e0 END) {_W} AS error_rate
  FROM {{rows}}"""
_SUMS = {"mean_d": "duration", "mean_m": "memory", "mean_c": "cpu", "error_rate": "CASE WHEN truth THEN 1e0 ELSE 0e0 END"}
_MEANS = ", ".join(f"(s_{m} - coalesce(lag(s_{m}, {FRAME}) {_O}, 0)) / nullif(c_{m} - coalesce(lag(c_{m}, {FRAME}) {_O}, 0), 0) AS {m}" for m in _SUMS)
SUMMED = f"""
  SELECT event_id, function_id, t_us, phase, duration, memory, cpu, truth, p50, p95, max_m, {_MEANS}, (t_us - lag(t_us) {_O}) / 1e6 AS idle, least(k, {FRAME}) AS seen
  FROM (SELECT *, row_number() {_O} AS k, {", ".join(f"coalesce(sum({x}) {_H}, 0e0) AS s_{m}, count({x}) {_H} AS c_{m}" for m, x in _SUMS.items())} FROM {{rows}}) AS summed"""



def profile(measures: str) -> str:
    """Rolling profile over the last thousand records of the function, its inferred state, and the sampling rate (base .1, raised for what is rare or bad)."""
    return f"""
WITH profiled AS ({measures}
), stated AS (
  SELECT *, CASE WHEN phase = 'init' OR idle > 300 OR idle IS NULL THEN 'cold' WHEN duration > 1.5 * p95 THEN 'high_latency' WHEN memory > 1.3 * mean_m THEN 'memory_pressure' WHEN cpu > 80 THEN 'cpu_intensive' WHEN idle > 30 THEN 'warm' ELSE 'steady' END AS state,
    duration > 2.0 * p95 OR memory > 1.5 * mean_m OR cpu > 2.0 * mean_c OR error_rate > 0.1 AS unusual FROM profiled
), rated AS (
  SELECT *, least(1.0, greatest(0.01, 0.1 * CASE WHEN truth THEN 5.0 ELSE 1.0 END * CASE WHEN unusual THEN 3.0 ELSE 1.0 END * CASE WHEN state = 'cold' THEN 2.0 ELSE 1.0 END * CASE WHEN seen < 10 THEN 5.0 ELSE 1.0 END)) AS rate FROM stated
)
SELECT event_id, function_id, state, unusual, round(mean_d + 1e-9, 4) AS mean_duration, round(p50 + 1e-9, 4) AS p50_duration, round(p95 + 1e-9, 4) AS p95_duration, round(mean_m + 1e-9, 2) AS mean_memory, max_m AS max_memory, round(rate, 4) AS rate, <hash:event_id> % 10000 < rate * 10000 AS sampled
FROM rated"""


def summary(measures: str) -> str:
    """By function: share of each state, of what was sampled, and the rate that its load calls for."""
    return f"""
SELECT function_id, count(*) AS n, CAST(sum(CASE WHEN sampled THEN 1 ELSE 0 END) AS BIGINT) AS n_sampled, CAST(sum(CASE WHEN state = 'cold' THEN 1 ELSE 0 END) AS BIGINT) AS n_cold, CAST(sum(CASE WHEN unusual THEN 1 ELSE 0 END) AS BIGINT) AS n_unusual, round(avg(rate), 4) AS mean_rate,
  CASE WHEN count(*) > 1000 THEN 'busy' WHEN count(*) > 100 THEN 'normal' ELSE 'quiet' END AS load_class
FROM ({profile(measures)}) AS profile GROUP BY function_id"""


PROFILE, SUMMARY = profile(WINDOWED), summary(WINDOWED)
_PERCENTILES = {"p50": ("duration", 0.5), "p95": ("duration", 0.95), "max_m": ("memory", 1.0)}


def run(text: Callable[[str], str], rows: DataFrame) -> DataFrame:
    """``profile`` or ``summary`` over telemetry: percentiles and maxima from frames kept in order, means from running sums."""
    return rows.sparkSession.sql(fill(text(SUMMED), SPARK), rows=running_percentiles(rows, _PERCENTILES, frame=FRAME))
