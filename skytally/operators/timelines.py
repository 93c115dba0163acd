"""Behaviour over time: load shedding, quality trends, channel states with hysteresis, service scores, overlaps, majority votes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill

#: A bounded buffer replayed: of each function's 30-second window the first ``cap`` records stay, the rest is shed; the level follows how full it is.
BUFFER = """
WITH placed AS (SELECT event_id, function_id, t_us <div> 30000000 * 30000000 AS start_us, row_number() OVER (PARTITION BY function_id, t_us <div> 30000000 ORDER BY event_id) AS place FROM {rows})
SELECT function_id, start_us, count(*) AS n, CAST(sum(CASE WHEN place > {cap} THEN 1 ELSE 0 END) AS BIGINT) AS shed,
  CASE WHEN count(*) >= 0.95 * {cap} THEN 'critical' WHEN count(*) >= 0.8 * {cap} THEN 'high' WHEN count(*) >= 0.5 * {cap} THEN 'medium' WHEN count(*) >= 0.2 * {cap} THEN 'low' ELSE 'none' END AS level
FROM placed GROUP BY function_id, start_us""".replace("{cap}", "4")

#: Share of records without failure by hour: mean of the later half against the earlier (within 5 % is stable), strength and volatility.
TREND = """
WITH hours AS (SELECT function_id, t_us <div> 3600000000 AS hour, avg(CASE WHEN truth THEN 0e0 ELSE 1e0 END) AS quality FROM {rows} GROUP BY function_id, t_us <div> 3600000000),
ranked AS (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY hour) AS n, count(*) OVER (PARTITION BY function_id) AS total FROM hours),
halves AS (
  SELECT function_id, count(*) AS hours, avg(CASE WHEN n * 2 <= total THEN quality END) AS early, avg(CASE WHEN n * 2 > total THEN quality END) AS late, avg(quality) AS m, stddev_pop(quality) AS s,
    CAST(sum(CASE WHEN quality < 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS alerts FROM ranked GROUP BY function_id
)
SELECT function_id, hours, round(early, 6) AS early, round(late, 6) AS late, CASE WHEN late > early * 1.05 THEN 'improving' WHEN late < early * 0.95 THEN 'declining' ELSE 'stable' END AS direction,
  round(CASE WHEN m > 0 THEN least(1.0, s / m) ELSE 0.0 END, 6) AS strength, round(s, 6) AS volatility, alerts
FROM halves"""

#: Channel state with hysteresis: two failures in a row take a channel down, three successes in a row bring it up; in between it keeps its state.
CHANNELS = """
WITH steps AS (
  SELECT event_id, function_id, truth, row_number() OVER (PARTITION BY function_id ORDER BY event_id) AS n, sum(CASE WHEN truth THEN 1 ELSE 0 END) OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS bad2,
    sum(CASE WHEN truth THEN 0 ELSE 1 END) OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS good3 FROM {rows}
), turns AS (
  SELECT *, coalesce(max(CASE WHEN bad2 = 2 THEN n END) OVER (PARTITION BY function_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_bad,
    coalesce(max(CASE WHEN good3 = 3 THEN n END) OVER (PARTITION BY function_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS last_good FROM steps
), states AS (SELECT *, last_bad > last_good AS down FROM turns),
moves AS (SELECT *, coalesce(lag(down) OVER (PARTITION BY function_id ORDER BY n), false) AS was_down FROM states)
SELECT function_id, count(*) AS n, CAST(sum(CASE WHEN down THEN 1 ELSE 0 END) AS BIGINT) AS n_down, CAST(sum(CASE WHEN down AND NOT was_down THEN 1 ELSE 0 END) AS BIGINT) AS failovers,
  CAST(sum(CASE WHEN was_down AND NOT down THEN 1 ELSE 0 END) AS BIGINT) AS recoveries, max_by(down, n) AS down_at_end
FROM moves GROUP BY function_id"""

#: Service score of each function as a channel (latency .4, throughput .3, availability .2, cost .1, each against the best) and its rank.
SERVICE = """
WITH per AS (SELECT function_id, avg(duration) AS d, count(*) * 1e0 AS n, avg(CASE WHEN truth THEN 0e0 ELSE 1e0 END) AS up, avg(duration * memory) AS cost FROM {rows} GROUP BY function_id),
best AS (SELECT min(d) AS d, max(n) AS n, max(up) AS up, min(cost) AS cost FROM per),
scored AS (SELECT function_id, round(0.4 * best.d / nullif(per.d, 0) + 0.3 * per.n / best.n + 0.2 * per.up / nullif(best.up, 0) + 0.1 * best.cost / nullif(per.cost, 0), 4) AS score FROM per JOIN best ON true)
SELECT function_id, score, row_number() OVER (ORDER BY score DESC, function_id) AS rank FROM scored"""

#: Overlaps of failure incidents of different functions: intervals meet by the hours they touch, and each pair counts in the hour where the later begins.
OVERLAPS = """
WITH marked AS (SELECT function_id, event_id, t_us, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY function_id ORDER BY t_us, event_id) <= 60000000 THEN 0 ELSE 1 END AS fresh FROM {rows} WHERE truth),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY function_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked),
spans AS (SELECT function_id, min(t_us) AS lo, max(t_us) + 1000000 AS hi FROM islands GROUP BY function_id, island),
slots AS (SELECT function_id, lo, hi, <explode:<sequence:lo <div> 3600000000, hi <div> 3600000000>> AS slot FROM spans)
SELECT a.function_id AS first_function, b.function_id AS second_function, count(*) AS n, round(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) / 1e6, 4) AS seconds
FROM slots a JOIN slots b ON a.slot = b.slot AND a.function_id < b.function_id AND a.lo < b.hi AND b.lo < a.hi AND a.slot = greatest(a.lo, b.lo) <div> 3600000000
GROUP BY a.function_id, b.function_id"""

#: Phase that most records of a function's ten minutes report, ties to the one seen first, and how many agree.
MAJORITY = """
WITH counts AS (SELECT function_id, t_us <div> 600000000 * 600000000 AS start_us, phase, count(*) AS n, min(event_id) AS first_id FROM {rows} GROUP BY function_id, t_us <div> 600000000 * 600000000, phase),
ranked AS (SELECT *, row_number() OVER (PARTITION BY function_id, start_us ORDER BY n DESC, first_id) AS place, sum(n) OVER (PARTITION BY function_id, start_us) AS total FROM counts)
SELECT function_id, start_us, phase, n, round(n * 1e0 / total, 4) AS agreement FROM ranked WHERE place = 1"""

#: Metrics one under the other: aggregated wide in one pass, then turned.
METRICS = """
SELECT function_id, metric, n, CASE metric METRIC_LO END AS lowest, CASE metric METRIC_HI END AS highest, round(CASE metric METRIC_MEAN END, 4) AS mean
FROM (SELECT function_id, count(*) AS n, WIDE FROM {rows} GROUP BY function_id) AS wide JOIN (VALUES ('duration'), ('memory'), ('cpu'), ('network')) AS names(metric) ON true"""
_NAMES = ("duration", "memory", "cpu", "network")
for _mark, _part in (("METRIC_LO", "lo"), ("METRIC_HI", "hi"), ("METRIC_MEAN", "m")):
    METRICS = METRICS.replace(_mark, " ".join(f"WHEN '{x}' THEN {x}_{_part}" for x in _NAMES))
METRICS = METRICS.replace("WIDE", ", ".join(f"min({x}) AS {x}_lo, max({x}) AS {x}_hi, avg({x}) AS {x}_m" for x in _NAMES))


def run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)
