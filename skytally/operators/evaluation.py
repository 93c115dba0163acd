"""Evaluation of scores against truth, and simple outlier baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill

_FIELDS = ("duration", "memory", "cpu", "network")

#: Confusion counts and ratios for thresholds .05 to .95: each row counts once at its score's step, sums over the steps do the rest.
SWEEP = """
SELECT t AS threshold, tp, fp, pos - tp AS fn, neg - fp AS tn, round(CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE 0.0 END, 6) AS precision_, round(CASE WHEN pos > 0 THEN tp * 1e0 / pos ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + pos - tp > 0 THEN 2e0 * tp / (2 * tp + fp + pos - tp) ELSE 0.0 END, 6) AS f1, round(CASE WHEN neg > 0 THEN fp * 1e0 / neg ELSE 0.0 END, 6) AS fpr
FROM (
  SELECT t, CAST(sum(CASE WHEN truth THEN c ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN truth THEN 0 ELSE c END) AS BIGINT) AS fp, max(pos) AS pos, max(neg) AS neg
  FROM (SELECT least(95, CAST(floor(score * 100 + 1e-9) AS INT)) AS step, truth, count(*) AS c FROM {rows} GROUP BY 1, 2) AS counted
  JOIN (SELECT CAST(sum(CASE WHEN truth THEN 1 ELSE 0 END) AS BIGINT) AS pos, CAST(sum(CASE WHEN truth THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM {rows}) AS total ON true
  RIGHT JOIN (SELECT CAST(i AS INT) AS t FROM {steps}) AS grid ON step >= t
  GROUP BY t
) AS summed
"""

#: Area under the ROC curve by ranks, ties at their mean rank: counts per score, so that ties cost nothing.
AUC = """
SELECT round((sum(p * (below + (c + 1) / 2e0)) - pos * (pos + 1) / 2e0) / (pos * neg), 6) AS auc, pos, neg
FROM (
  SELECT score, c, p, sum(c) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS below, sum(p) OVER () * 1e0 AS pos, sum(c - p) OVER () * 1e0 AS neg
  FROM (SELECT round(score, 4) AS score, count(*) AS c, sum(CASE WHEN truth THEN 1 ELSE 0 END) AS p FROM {rows} GROUP BY 1) AS counted
) AS ranked
GROUP BY pos, neg
"""

#: Z-score, interquartile and moving-average baselines trained on benign rows of the first half of each function's arrivals.
BASELINES = """
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY function_id) AS total FROM {rows}),
trained AS (
  SELECT function_id, FITS FROM numbered WHERE n * 2 <= total AND NOT truth GROUP BY function_id
), moved AS (
  SELECT *, MOVES FROM numbered
)
SELECT event_id, moved.function_id, truth, round(greatest(ZS), 4) AS z_score, greatest(ZS) > 3.0 AS z_hit, IQRS AS iqr_hit, n > 10 AND greatest(MAS) > 3.0 AS ma_hit
FROM moved JOIN trained ON moved.function_id = trained.function_id WHERE n * 2 > total
"""
BASELINES = (
    BASELINES.replace("FITS", ", ".join(f"avg({x}) AS {x}_m, greatest(stddev_pop({x}), 1e-8) AS {x}_s, <percentile>({x}, 0.25) AS {x}_q1, <percentile>({x}, 0.75) AS {x}_q3" for x in _FIELDS))
    .replace("MOVES", ", ".join(f"avg({x}) OVER w AS {x}_wm, stddev_pop({x}) OVER w AS {x}_ws".replace("OVER w", "OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)") for x in _FIELDS))
    .replace("ZS", ", ".join(f"abs({x} - {x}_m) / {x}_s" for x in _FIELDS))
    .replace("IQRS", "(" + " OR ".join(f"{x} < {x}_q1 - 1.5 * ({x}_q3 - {x}_q1) OR {x} > {x}_q3 + 1.5 * ({x}_q3 - {x}_q1)" for x in _FIELDS) + ")")
    .replace("MAS", ", ".join(f"coalesce(abs({x} - {x}_wm) / greatest({x}_ws, 1e-8), 0.0)" for x in _FIELDS))
)

_BEFORE = "OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


def _deviation(x: str) -> str:
    """Deviation of the ten before by running means, in their order. Spark's own is written in another form, which rounds otherwise; of ten values nine of which are equal it lies at a third of the odd one's distance, where the threshold is."""
    more = "named_struct('n', s.n + 1, 'm', s.m + (v - s.m) / (s.n + 1), 'd', s.d + (v - (s.m + (v - s.m) / (s.n + 1))) * (v - s.m))"
    return f"aggregate(collect_list({x}) {_BEFORE}, named_struct('n', 0, 'm', 0.0, 'd', 0.0), (s, v) -> {more}, s -> CASE WHEN s.n > 0 THEN sqrt(s.d / s.n) END)"


_BASELINES = BASELINES
for _x in _FIELDS:
    _BASELINES = _BASELINES.replace(f"stddev_pop({_x}) {_BEFORE}", _deviation(_x))

#: Effect sizes between the scores of the two classes: means, Cohen's d, Cliff's delta (from ranks), 95 % interval of the mean difference.
EFFECTS = """
SELECT round(m1 - m0, 6) AS mean_difference, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohen_d, round(2e0 * u / (n1 * n0) - 1, 6) AS cliff_delta,
  round(m1 - m0 - 1.96 * sqrt(v1 / n1 + v0 / n0), 6) AS ci_low, round(m1 - m0 + 1.96 * sqrt(v1 / n1 + v0 / n0), 6) AS ci_high
FROM (
  SELECT avg(CASE WHEN truth THEN score END) AS m1, avg(CASE WHEN NOT truth THEN score END) AS m0, var_samp(CASE WHEN truth THEN score END) AS v1, var_samp(CASE WHEN NOT truth THEN score END) AS v0,
    sum(CASE WHEN truth THEN 1e0 ELSE 0e0 END) AS n1, sum(CASE WHEN truth THEN 0e0 ELSE 1e0 END) AS n0 FROM {rows}
) AS moments
JOIN (
  SELECT sum(p * (below - pbelow + (c - p) / 2e0)) AS u FROM (
    SELECT c, p, sum(c) OVER o - c AS below, sum(p) OVER o - p AS pbelow FROM (SELECT round(score, 4) AS score, count(*) AS c, sum(CASE WHEN truth THEN 1 ELSE 0 END) AS p FROM {rows} GROUP BY 1) AS counted
  ) AS ranked
) AS ranks ON true
""".replace("OVER o", "OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def _run(text: str, rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    more = {"steps": spark.range(5, 96).withColumnRenamed("id", "i")} if "{steps}" in text else {}
    return spark.sql(fill(text, SPARK), rows=rows, **more)


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """``scored`` has score (0 to 1) and truth; one row per threshold in hundredths. One pass and 92 counts, whatever the rows."""
    return _run(SWEEP, scored)


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve from scores at four places; at most 10,001 distinct scores reach the ordered window."""
    return _run(AUC, scored)


def effects(scored: DataFrame) -> DataFrame:
    return _run(EFFECTS, scored)


def baselines(telemetry: DataFrame) -> DataFrame:
    """Baseline verdicts of the second half of each function's arrivals."""
    return _run(_BASELINES, telemetry)
