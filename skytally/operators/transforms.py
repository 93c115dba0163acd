"""Transforms of records for robustness tests and privacy: seeded noise, masking, label flips, budgets; and their utility."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill



def _uniform(seed: str) -> str:
    return f"((<hash:concat('{seed}', event_id)> % 1000000 + 0.5) / 1e6)"


#: Evasion and poisoning: measures pulled towards benign, quantised, drawn Laplace noise of a privacy budget, and flipped labels of a share of the rows.
PERTURBED = f"""
SELECT event_id, function_id, round(duration * (0.9 + 0.2 * {_uniform('d')}), 4) AS evaded_duration, floor(memory / 4096.0) * 4096.0 AS quantised_memory, round(ln(1.0 + network), 4) AS log_network,
  round(duration - sign({_uniform('l')} - 0.5) * 0.5 * ln(1.0 - 2.0 * abs({_uniform('l')} - 0.5)), 4) AS private_duration, CASE WHEN {_uniform('f')} < 0.1 THEN NOT truth ELSE truth END AS poisoned_truth, {_uniform('f')} < 0.1 AS flipped
FROM {{rows}}"""

#: What the private column keeps: mean and spread preserved, correlation with the original.
UTILITY = f"""
SELECT function_id, count(*) AS n, round(1.0 - least(1.0, abs(avg(private_duration) - avg(evaded_duration)) / greatest(abs(avg(evaded_duration)), 1e-9)), 4) AS mean_kept, round(covar_pop(private_duration, evaded_duration) / nullif(stddev_pop(private_duration) * stddev_pop(evaded_duration), 0), 4) AS correlation,
  round(avg(CASE WHEN flipped THEN 1e0 ELSE 0e0 END), 4) AS flipped_share
FROM ({PERTURBED}) AS perturbed GROUP BY function_id"""

#: Privacy budget spent by each function in order, and whether it is still within the limit.
BUDGET = """
SELECT event_id, function_id, round(sum(0.01) OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS spent, row_number() OVER (PARTITION BY function_id ORDER BY event_id) <= 100 AS within_budget FROM {rows}"""

#: k-anonymity of coarse attributes: group sizes, and whether each is at least 5.
ANONYMITY = """
SELECT phase, anomaly_type, CAST(floor(duration / 5.0) AS BIGINT) AS duration_band, count(*) AS n, count(DISTINCT function_id) AS functions, count(*) >= 5 AS anonymous FROM {rows} GROUP BY phase, anomaly_type, CAST(floor(duration / 5.0) AS BIGINT)"""


def run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)
