"""How sure a fused score is: resampled panels, chances and uncertainties, a sentence that explains them, and figures of each detector.

A panel of n detectors is resampled n at a time with replacement. Which detectors a round draws is the same for all records, so a round
is a row of counts and a record's scores are one product of its shares with all rounds. Shares are whole millionths, which makes the
products exact, and SQL gives the same figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.functions.dialect import DUCKDB, SPARK, fill
from skytally.operators.decisions import fused_text, weight
from skytally.operators.detectors import NAMES

# Rounds of resampling, the score that a chance is about, places of the interval's ends among the sorted scores.
ROUNDS, NULL_SCORE, ENDS = 1000, 0.5, (0.025, 0.975)
#: A panel of fewer detectors isn't resampled; these stand in its place. Fixed values.
LEAST, SPREAD = 3, 0.1
FEW = {"variance": 0.01, "p_value": 0.5, "model_uncertainty": 0.5, "data_uncertainty": 0.3, "epistemic_uncertainty": 0.2, "aleatoric_uncertainty": 0.1}
#: Records whose scores of all rounds a task holds at a time.
AT_ONCE = 1000
_UNIT = 1_000_000


def _shares(weights: Mapping[str, float]) -> str:
    total = round(sum(weights.values()), 6)
    return ", ".join(f"CAST(floor(CASE WHEN {n}_detected THEN {float(w)} * {n}_confidence / {total} ELSE 0.0 END * {_UNIT}.0 + 0.5) AS BIGINT)" for n, w in weights.items())


def _said(weights: Mapping[str, float]) -> str:
    """Detectors that object with their confidence; the surest first, of equally sure ones the first by name."""
    return ", ".join(f"CASE WHEN {n}_detected THEN concat(lpad(CAST(10000 - CAST(floor({n}_confidence * 10000 + 0.5) AS INT) AS <string>), 5, '0'), '|{n} ', <fixed:'%.2f', round({n}_confidence + 1e-10, 2)>) END" for n in weights)


def _told(weights: Mapping[str, float]) -> str:
    fused = fused_text(weights, keep=(f"<list:{_shares(weights)}> AS shares", f"<sorted:<kept:<list:{_said(weights)}>>> AS said"))
    objecting = f"concat(CAST(detectors_hit AS <string>), ' of {len(weights)} detectors (', <fixed:'%.1f', round(consensus * 100.0 + 1e-10, 1)>, ' %)')"
    return f"""
SELECT event_id, vote_score, vote_confidence, shares,
  CASE WHEN anomaly THEN concat(primary_type, ': ', {objecting}, ', foremost ', <sub:<joined:<part:said, 1, 3>, ', '>, '[0-9]+[|]', ''>) ELSE concat('no anomaly: ', {objecting}) END AS explanation
FROM ({fused}) AS fused"""


#: Of each record's resampled scores: ends of the interval, mean, variance and the part over the null score, all in whole units.
_MEASURES = f"""
SELECT event_id, explanation, round(lo + 1e-10, 6) AS low, round(hi + 1e-10, 6) AS high, round(v + 1e-10, 6) AS variance, round(1.0 - above / {ROUNDS}.0 + 1e-10, 4) AS p_value,
  round(v + 1e-10, 6) AS model_uncertainty, round(gap + 1e-10, 6) AS data_uncertainty, round((hi - lo) / 2.0 + 1e-10, 6) AS epistemic_uncertainty, round(aleatoric + 1e-10, 6) AS aleatoric_uncertainty,
  {ROUNDS} AS bootstrap_iterations, round(v + gap + 1e-10, 6) AS total_uncertainty, round(hi - lo + 1e-10, 6) AS confidence_width, round(mean + 1e-10, 6) AS mean_bootstrap_score
FROM (SELECT *, least_score / {_UNIT}.0 AS lo, most_score / {_UNIT}.0 AS hi, spread / {_UNIT}.0 / {_UNIT}.0 AS v, centre / {_UNIT}.0 AS mean, abs(vote_confidence - vote_score) AS gap FROM {{rows}}) AS scaled"""
_FEW = f"""
SELECT event_id, explanation, round(greatest(0.0, vote_confidence - {SPREAD}) + 1e-10, 6) AS low, round(least(1.0, vote_confidence + {SPREAD}) + 1e-10, 6) AS high, {", ".join(f"{v} AS {k}" for k, v in FEW.items())},
  0 AS bootstrap_iterations, {FEW["model_uncertainty"] + FEW["data_uncertainty"]} AS total_uncertainty, round(least(1.0, vote_confidence + {SPREAD}) - greatest(0.0, vote_confidence - {SPREAD}) + 1e-10, 6) AS confidence_width, vote_confidence AS mean_bootstrap_score
FROM {{rows}}"""


def drawn(n: int, rounds: int = ROUNDS) -> np.ndarray:
    """How often each of ``n`` detectors is drawn in each round: the first eight digits of the MD5 of round and place say which."""
    counts = np.zeros((rounds, n))
    for b in range(rounds):
        for k in range(n):
            counts[b, int(hashlib.md5(f"{b}:{k}".encode()).hexdigest()[:8], 16) % n] += 1
    return counts


def confidence(votes: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Interval, variance, chance, eight uncertainties and explanation of each record of ``votes``.

    ``weights`` is by detector, base weight times trust; without it the base weights. p_value is the part of resampled scores that don't
    pass 0.5. Panels of fewer than three detectors give fixed figures around the weighted confidence. No record is shuffled.
    """
    weights = weights or {n: weight(n) for n in NAMES}
    spark = votes.sparkSession
    told = spark.sql(fill(_told(weights), SPARK), rows=votes)
    if len(weights) < LEAST:
        return spark.sql(fill(_FEW, SPARK), rows=told)
    counts, (first, last) = drawn(len(weights)), (int(e * ROUNDS) for e in ENDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                shares = batch.column(3).flatten().to_numpy().reshape(-1, len(weights)).astype(float)
                scores = np.partition(shares @ counts.T, (first, last), axis=1)
                mean = scores.mean(axis=1)
                found = (scores[:, first], scores[:, last], mean, ((scores - mean[:, None]) ** 2).mean(axis=1), (scores > NULL_SCORE * _UNIT).sum(axis=1).astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), *map(pa.array, found)], names)

    names = ["event_id", "vote_score", "vote_confidence", "explanation", "least_score", "most_score", "centre", "spread", "above"]
    schema = "event_id long, vote_score double, vote_confidence double, explanation string, least_score double, most_score double, centre double, spread double, above double"
    found = told.mapInArrow(work, schema).withColumn("aleatoric", F.lit(min(0.1, 1 / len(weights))))
    return spark.sql(fill(_MEASURES, SPARK), rows=found)


def confidence_sql(votes: str, weights: Mapping[str, float] | None = None) -> str:
    weights = weights or {n: weight(n) for n in NAMES}
    n, (first, last) = len(weights), (int(e * ROUNDS) + 1 for e in ENDS)
    told = fill(_told(weights), DUCKDB).format(rows=f"({votes}) AS votes")
    if n < LEAST:
        return fill(_FEW, DUCKDB).format(rows=f"({told}) AS told")
    tallied = ", ".join(f"CAST(count(*) FILTER (WHERE d = {k}) AS DOUBLE)" for k in range(n))
    found = f"""WITH counts AS MATERIALIZED (SELECT b, [{tallied}] AS counts FROM (SELECT b, CAST('0x' || substr(md5(b || ':' || k), 1, 8) AS BIGINT) % {n} AS d FROM range({ROUNDS}) AS r(b), range({n}) AS p(k)) GROUP BY b),
told AS MATERIALIZED ({told}), scored AS (SELECT event_id, list_sort(list(list_dot_product(CAST(shares AS DOUBLE[]), counts))) AS scores FROM told, counts GROUP BY event_id),
summed AS (SELECT *, list_sum(scores) / {ROUNDS} AS centre FROM scored)
SELECT event_id, vote_score, vote_confidence, explanation, scores[{first}] AS least_score, scores[{last}] AS most_score, centre, list_sum(list_transform(scores, lambda x: (x - centre) * (x - centre))) / {ROUNDS} AS spread,
  len(list_filter(scores, lambda x: x > {NULL_SCORE} * {_UNIT})) AS above, {min(0.1, 1 / n)!r}::DOUBLE AS aleatoric FROM summed JOIN told USING (event_id)"""
    return fill(_MEASURES, DUCKDB).format(rows=f"({found}) AS found")


#: Figures of one detector over all votes: how often it objects, how sure it is then, and how often it is right.
STATISTIC = """
SELECT '{name}' AS detector, n, {name}_n AS n_detected, round({name}_n * 1e0 / n + 1e-10, 4) AS rate, round({name}_sum / greatest({name}_n, 1) + 1e-10, 4) AS mean_confidence, round({name}_max + 1e-10, 4) AS max_confidence,
  {name}_right AS n_right, round({name}_right * 1e0 / n + 1e-10, 4) AS accuracy FROM {sums} WHERE n > 0"""
_SUMS = ", ".join(
    f"count(CASE WHEN {n}_detected THEN 1 END) AS {n}_n, coalesce(sum(CASE WHEN {n}_detected THEN CAST(floor({n}_confidence * 10000 + 0.5) AS BIGINT) END), 0) / 10000.0 AS {n}_sum, coalesce(max(CASE WHEN {n}_detected THEN {n}_confidence END), 0.0) AS {n}_max, count(CASE WHEN {n}_detected = truth THEN 1 END) AS {n}_right"
    for n in NAMES
)
SUMS = f"SELECT count(*) AS n, {_SUMS} FROM {{rows}}"


def statistics(votes: DataFrame) -> DataFrame:
    """One row per detector, from one pass over the votes; without votes no rows. A null truth is never right."""
    spark = votes.sparkSession
    sums = spark.sql(fill(SUMS, SPARK), rows=votes)
    each = F.array(*(F.struct(F.lit(n).alias("detector"), *(F.col(f"{n}_{c}").alias(c) for c in ("n", "sum", "max", "right"))) for n in NAMES))
    rows = sums.where("n > 0").select(F.col("n").alias("total"), F.inline(each))
    return rows.selectExpr(
        "detector", "total AS n", "n AS n_detected", "round(n / total + 1e-10, 4) AS rate", "round(sum / greatest(n, 1) + 1e-10, 4) AS mean_confidence", "round(max + 1e-10, 4) AS max_confidence",
        "`right` AS n_right", "round(`right` / total + 1e-10, 4) AS accuracy",
    )


def statistics_sql(votes: str) -> str:
    sums = fill(SUMS, DUCKDB).format(rows=f"({votes}) AS votes")
    return f"WITH sums AS MATERIALIZED ({sums}) " + " UNION ALL ".join(fill(STATISTIC, DUCKDB).format(name=n, sums="sums") for n in NAMES)
