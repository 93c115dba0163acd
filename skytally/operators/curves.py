"""Curves and comparisons of scores: ROC and precision-recall points, gaps, folds, false-alarm control, latency, loss, edge accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill

#: Points of both curves, one per score at four places: at most 10,001 rows reach the ordered windows.
CURVE = """
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp * 1e0 / nullif(pos, 0) AS recall, fp * 1e0 / nullif(neg, 0) AS fpr, tp * 1e0 / (tp + fp) AS precision_
FROM (
  SELECT score, sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, sum(c - p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp, sum(p) OVER () AS pos, sum(c - p) OVER () AS neg
  FROM (SELECT round(score, 4) AS score, count(*) AS c, sum(CASE WHEN truth THEN 1 ELSE 0 END) AS p FROM {rows} GROUP BY 1) AS counted
) AS summed"""

POINTS = f"SELECT threshold, tp, fp, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(precision_, 6) AS precision_ FROM ({CURVE}) AS curve"

#: Areas by trapezoids under both curves, from their first point on.
AREAS = f"""
SELECT round(sum((recall - before_recall) * (precision_ + before_precision) / 2e0), 6) AS average_precision, round(sum((fpr - before_fpr) * (recall + before_recall) / 2e0), 6) AS roc_area, count(*) AS points
FROM (
  SELECT *, coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0e0) AS before_recall, coalesce(lag(precision_) OVER (ORDER BY threshold DESC), 1e0) AS before_precision, coalesce(lag(fpr) OVER (ORDER BY threshold DESC), 0e0) AS before_fpr
  FROM ({CURVE}) AS curve
) AS steps"""

#: Lowest threshold that keeps the false alarms within a target, and what it finds.
ALARMS = f"""
SELECT target, min(threshold) AS threshold, round(max(recall), 6) AS recall, round(max(fpr), 6) AS fpr
FROM ({CURVE}) AS curve JOIN (VALUES (0.001), (0.01), (0.05), (0.1), (0.2)) AS grid(target) ON fpr <= target GROUP BY target"""

#: Smallest, largest and mean score by class, and the room between the classes.
GAPS = """
SELECT round(min(CASE WHEN truth THEN score END), 6) AS min_true, round(max(CASE WHEN truth THEN score END), 6) AS max_true, round(avg(CASE WHEN truth THEN score END), 6) AS mean_true, round(min(CASE WHEN NOT truth THEN score END), 6) AS min_false,
  round(max(CASE WHEN NOT truth THEN score END), 6) AS max_false, round(avg(CASE WHEN NOT truth THEN score END), 6) AS mean_false, round(min(CASE WHEN truth THEN score END) - max(CASE WHEN NOT truth THEN score END), 6) AS gap
FROM {rows}"""

#: Accuracy at .09 in each of five folds, drawn by a hash of the id, so that no class is ordered in one task.
FOLDS = """
SELECT fold, count(*) AS n, CAST(sum(CASE WHEN truth THEN 1 ELSE 0 END) AS BIGINT) AS n_true, round(avg(CASE WHEN (score >= 0.09) = truth THEN 1e0 ELSE 0e0 END), 6) AS accuracy
FROM (SELECT <hash:concat('fold', event_id)> % 5 AS fold, score, truth FROM {rows}) AS dealt GROUP BY fold"""

#: Latency by function: percentiles with linear interpolation, mean, spread, half-width of the 95 % interval of the mean.
LATENCY = """
SELECT function_id, count(*) AS n, round(avg(duration), 4) AS mean, round(<percentile>(duration, 0.5), 4) AS p50, round(<percentile>(duration, 0.95), 4) AS p95, round(<percentile>(duration, 0.99), 4) AS p99, round(stddev_samp(duration), 4) AS sd,
  round(1.96 * stddev_samp(duration) / sqrt(count(*)), 4) AS half_width, min(duration) AS lowest, max(duration) AS highest
FROM {rows} GROUP BY function_id"""

#: Failures a million in the earlier and later half of each function's time, the reduction, and z of the two proportions.
LOSS = """
WITH middle AS (SELECT function_id AS f, (min(t_us) + max(t_us)) <div> 2 AS cut FROM {rows} GROUP BY function_id),
arms AS (
  SELECT function_id, sum(CASE WHEN t_us < cut THEN 1e0 ELSE 0e0 END) AS n1, sum(CASE WHEN t_us >= cut THEN 1e0 ELSE 0e0 END) AS n2, sum(CASE WHEN truth AND t_us < cut THEN 1e0 ELSE 0e0 END) AS x1, sum(CASE WHEN truth AND t_us >= cut THEN 1e0 ELSE 0e0 END) AS x2
  FROM {rows} JOIN middle ON function_id = f GROUP BY function_id
)
SELECT function_id, round(1e6 * x1 / nullif(n1, 0), 2) AS ppm_before, round(1e6 * x2 / nullif(n2, 0), 2) AS ppm_after, round(1e0 - (x2 / nullif(n2, 0)) / nullif(x1 / nullif(n1, 0), 0), 6) AS reduction,
  round((x1 / nullif(n1, 0) - x2 / nullif(n2, 0)) / nullif(sqrt((x1 + x2) / (n1 + n2) * (1e0 - (x1 + x2) / (n1 + n2)) * (1e0 / nullif(n1, 0) + 1e0 / nullif(n2, 0))), 0), 4) AS z
FROM arms"""

#: Predicted links (a failure and the function's next record within a minute) against true ones (two failures in a row within five): precision, recall and F1 by the phase of the second.
LINKS = """
WITH steps AS (SELECT event_id, truth, t_us, function_id, lead(event_id) OVER w AS after_id, lead(t_us) OVER w AS after_us, lead(truth) OVER w AS after_truth, lead(phase) OVER w AS after_phase FROM {rows}),
predicted AS (SELECT event_id AS source, after_id AS target, after_phase AS kind FROM steps WHERE truth AND abs(after_us - t_us) <= 60000000),
actual AS (SELECT event_id AS source, after_id AS target, after_phase AS kind FROM steps WHERE truth AND after_truth AND abs(after_us - t_us) <= 300000000),
counted AS (
  SELECT coalesce(p.kind, a.kind) AS kind, sum(CASE WHEN p.source IS NOT NULL AND a.source IS NOT NULL THEN 1e0 ELSE 0e0 END) AS hits, count(p.source) AS n_predicted, count(a.source) AS n_actual
  FROM predicted p FULL OUTER JOIN actual a ON p.source = a.source AND p.target = a.target GROUP BY 1
)
SELECT kind, n_predicted, n_actual, CAST(hits AS BIGINT) AS hits, round(coalesce(hits / nullif(n_predicted, 0), 0e0), 6) AS precision_, round(coalesce(hits / nullif(n_actual, 0), 0e0), 6) AS recall, round(coalesce(2e0 * hits / nullif(n_predicted + n_actual, 0), 0e0), 6) AS f1 FROM counted
""".replace("OVER w", "OVER (PARTITION BY function_id ORDER BY event_id)")

#: Distance of each record's duration and memory from its function's mean under their covariance (squared, two degrees of freedom; 9.21 is the 99 % point).
ENVELOPE = """
WITH fits AS (SELECT function_id AS f, avg(duration) AS md, avg(memory) AS mm, var_pop(duration) AS vd, var_pop(memory) AS vm, covar_pop(duration, memory) AS c FROM {rows} WHERE NOT truth GROUP BY function_id)
SELECT event_id, function_id, truth, round(d2, 4) AS distance, d2 > 9.21 AS outside
FROM (
  SELECT event_id, function_id, truth, ((duration - md) * (duration - md) * vm - 2e0 * (duration - md) * (memory - mm) * c + (memory - mm) * (memory - mm) * vd) / nullif(vd * vm - c * c, 0) AS d2
  FROM {rows} JOIN fits ON function_id = f
) AS measured"""


def run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)
