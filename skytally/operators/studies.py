"""Studies over stored detections and records: calibration, ablation, tests, folds, resampling, costs, features, attack scores, change levels.

Texts run in Spark and in DuckDB. What a study repeats (thresholds, settings) is a small table; rows are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill

_TRUTH = "anomaly_type = 'execution_failure'"
_RATIOS = "round(CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE 0.0 END, 6) AS precision_, round(CASE WHEN tp + fn > 0 THEN tp * 1e0 / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"
_COUNTS = "CAST(sum(CASE WHEN {hit} AND truth THEN c ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN {hit} AND NOT truth THEN c ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN NOT {hit} AND truth THEN c ELSE 0 END) AS BIGINT) AS fn"

#: Aggregates of the matrix against thresholds .10 to .90 in steps of .05, over counts by score.
CALIBRATION = f"""
SELECT threshold, tp, fp, fn, {_RATIOS} FROM (
  SELECT threshold, {_COUNTS.format(hit="score >= threshold")} FROM (SELECT aggregate AS score, {_TRUTH} AS truth, count(*) AS c FROM {{rows}} GROUP BY aggregate, {_TRUTH}) AS counted
  JOIN ({" UNION ALL ".join(f"SELECT {t / 100:.2f} AS threshold" for t in range(10, 91, 5))}) AS grid ON true GROUP BY threshold
) AS swept"""

_SIGNALS = {"rule_chain": 0.7, "drift_tracker": 0.65, "graph_immunized": 0.6, "semantic_deviation": 0.75}
_WITHOUT = {out: "(" + " + ".join(f"{k} * {c}" for k, c in _SIGNALS.items() if k != out) + f") / {sum(c for k, c in _SIGNALS.items() if k != out):.2f} + 1e-10 >= 0.15" for out in (*_SIGNALS, "none")}
#: The matrix with each signal left out in turn, and with none.
ABLATION = f"""
SELECT without, tp, fp, fn, {_RATIOS} FROM (
  SELECT without, {_COUNTS.format(hit="hit")} FROM (
    SELECT without, truth, CASE without {" ".join(f"WHEN '{k}' THEN h_{k}" for k in _WITHOUT)} END AS hit, c FROM (
      SELECT truth, {", ".join(f"h_{k}" for k in _WITHOUT)}, count(*) AS c FROM (SELECT {_TRUTH} AS truth, {", ".join(f"{v} AS h_{k}" for k, v in _WITHOUT.items())} FROM {{rows}}) AS judged GROUP BY truth, {", ".join(f"h_{k}" for k in _WITHOUT)}
    ) AS counted JOIN ({" UNION ALL ".join(f"SELECT '{k}' AS without" for k in _WITHOUT)}) AS settings ON true
  ) AS each_one GROUP BY without
) AS summed"""

_BY_SCORE = f"SELECT fused_score AS score, count(*) AS c, sum(CASE WHEN {_TRUTH} THEN 1 ELSE 0 END) AS p FROM {{rows}} GROUP BY fused_score"
#: Scores of failures against others: Welch's t and its degrees of freedom, Mann-Whitney's U with its normal value corrected for ties.
TESTS = f"""
SELECT n1, n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 4) AS welch_t, round(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)), 2) AS degrees,
  round(u, 1) AS mann_whitney_u, round((u - n1 * n0 / 2e0) / sqrt(n1 * n0 / 12e0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1e0)))), 4) AS mann_whitney_z
FROM (
  SELECT avg(CASE WHEN {_TRUTH} THEN fused_score END) AS m1, avg(CASE WHEN NOT {_TRUTH} THEN fused_score END) AS m0, var_samp(CASE WHEN {_TRUTH} THEN fused_score END) AS v1, var_samp(CASE WHEN NOT {_TRUTH} THEN fused_score END) AS v0,
    sum(CASE WHEN {_TRUTH} THEN 1e0 ELSE 0e0 END) AS n1, sum(CASE WHEN {_TRUTH} THEN 0e0 ELSE 1e0 END) AS n0 FROM {{rows}}
) AS moments JOIN (
  SELECT sum(p * (below + (c - p) / 2e0)) AS u, sum(c * 1e0 * c * c - c) AS ties FROM (SELECT c, p, sum(c - p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (c - p) AS below FROM ({_BY_SCORE}) AS counted) AS ranked
) AS ranks ON true"""

#: Two methods' accuracy by function and hour, the decision's and the rule chain's, as pairs.
PAIRS = f"SELECT avg(CASE WHEN (decision <> 'observe') = ({_TRUTH}) THEN 1e0 ELSE 0e0 END) AS x, avg(CASE WHEN (rule_chain >= 0.5) = ({_TRUTH}) THEN 1e0 ELSE 0e0 END) AS y FROM {{rows}} GROUP BY function_id, t_us <div> 3600000000"
_NODES = 2000
_SIMPSON = f"CASE WHEN k = 0 OR k = {_NODES} THEN 1e0 WHEN k % 2 = 1 THEN 4e0 ELSE 2e0 END"


#: Paired tests of pairs (x, y): signed ranks (equal pairs are left out, tied sizes share their mean rank, the variance is less by the ties) and Student's t. Two-sided chances are areas by Simpson's rule: of the normal curve up to z, and of cos^(n-2) up to atan(t / sqrt(n-1)), which is Student's curve. Fewer than two pairs give nulls; pairs that all differ alike have t 0, or 1e9 where they differ.


def paired(pairs: str) -> str:
    return f"""
WITH apart AS (SELECT round(x - y, 12) AS d FROM ({pairs}) AS p WHERE x IS NOT NULL AND y IS NOT NULL),
sizes AS (SELECT abs(d) AS a, count(*) AS c, sum(CASE WHEN d > 0 THEN 1e0 ELSE 0e0 END) AS pos FROM apart WHERE d <> 0 GROUP BY abs(d)),
ranks AS (SELECT c, pos, coalesce(sum(c) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2e0 AS r FROM sizes),
signed AS (SELECT coalesce(sum(c), 0) * 1e0 AS n, coalesce(sum(pos * r), 0e0) AS up, coalesce(sum((c - pos) * r), 0e0) AS down, coalesce(sum(c * 1e0 * c * c - c), 0e0) AS ties FROM ranks),
means AS (SELECT count(*) AS m, avg(d) AS mean_d, stddev_samp(d) AS sd FROM apart),
stats AS (
  SELECT m, n, up, down, mean_d, CASE WHEN n > 0 THEN abs(least(up, down) - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - ties / 48e0) ELSE 0e0 END AS z,
    CASE WHEN m > 1 THEN CASE WHEN sd > 0 THEN abs(mean_d) / (sd / sqrt(m * 1e0)) WHEN mean_d = 0 THEN 0e0 ELSE 1e9 END END AS t FROM signed JOIN means ON true),
ends AS (SELECT *, least(z, 9e0) AS z_end, least(atan(t / sqrt(v)), least(acos(-1e0) / 2, 12 / sqrt(v))) AS t_end, least(acos(-1e0) / 2, 12 / sqrt(v)) AS t_all FROM (SELECT *, CASE WHEN m > 1 THEN m - 1e0 END AS v FROM stats) AS s),
areas AS (
  SELECT m, n, up, down, mean_d, z, t, sum({_SIMPSON} * exp(-0.5 * (z_end * k / {_NODES}) * (z_end * k / {_NODES}))) * z_end / {_NODES} / 3e0 * 2 / sqrt(2 * acos(-1e0)) AS below_z,
    CASE WHEN t IS NULL THEN NULL ELSE sum({_SIMPSON} * power(abs(cos(coalesce(t_end, 0e0) * k / {_NODES})), v - 1e0)) * t_end / nullif(sum({_SIMPSON} * power(abs(cos(coalesce(t_all, 0e0) * k / {_NODES})), v - 1e0)) * t_all, 0e0) END AS below_t
  FROM ends JOIN (SELECT <explode:<sequence:0, {_NODES}>> AS k) AS nodes ON true GROUP BY m, v, n, up, down, mean_d, z, t, z_end, t_end, t_all)
SELECT m AS pairs, CAST(n AS BIGINT) AS unequal, round(least(up, down), 4) AS w, round(z + 1e-10, 6) AS z, CASE WHEN m > 1 THEN round(greatest(0e0, 1 - below_z) + 1e-10, 6) END AS p_ranks, round(mean_d + 1e-10, 6) AS mean_difference, round(t + 1e-10, 6) AS t, CASE WHEN t IS NOT NULL THEN round(greatest(0e0, 1 - below_t) + 1e-10, 6) END AS p_t FROM areas"""


#: The store's rows by 4,096 slots of their hashes, so that a stratum is numbered in many tasks.
_DRAWN = f"SELECT event_id, {_TRUTH} AS truth, decision, decision <> 'observe' AS hit, <hash:event_id> AS h, <hash:event_id> <div> 1048576 AS slot FROM {{rows}}"
#: Five folds with the same share of failures in each, and each fold's accuracy of the review threshold.
FOLDS = f"""
SELECT fold, count(*) AS n, CAST(sum(CASE WHEN truth THEN 1 ELSE 0 END) AS BIGINT) AS failures, round(avg(CASE WHEN hit = truth THEN 1e0 ELSE 0e0 END), 6) AS accuracy
FROM (
  SELECT truth, hit, (own + coalesce(before_slot, 0) - 1) % 5 AS fold
  FROM (SELECT *, row_number() OVER (PARTITION BY truth, decision, slot ORDER BY h, event_id) AS own FROM ({_DRAWN}) AS drawn) AS o
  JOIN (SELECT truth AS s_truth, decision AS s_decision, slot AS s_slot, sum(c) OVER (PARTITION BY truth, decision ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_slot FROM (SELECT truth, decision, slot, count(*) AS c FROM ({_DRAWN}) AS drawn GROUP BY truth, decision, slot) AS counts) AS sums
    ON truth = s_truth AND decision = s_decision AND slot = s_slot
) AS dealt GROUP BY fold"""

#: Mean score by resampling: each row counts 0 to 5 times in each of 50 samples, by a hash of its id and the sample (Poisson of mean 1).
BOOTSTRAP = """
SELECT count(*) AS samples, round(avg(m) + 1e-10, 6) AS mean_score, round(<percentile>(m, 0.025) + 1e-10, 6) AS low, round(<percentile>(m, 0.975) + 1e-10, 6) AS high FROM (
  SELECT sample, sum(w * fused_score) / sum(w) AS m FROM (
    SELECT sample, fused_score, CASE WHEN u < 0.36788 THEN 0 WHEN u < 0.73576 THEN 1 WHEN u < 0.91970 THEN 2 WHEN u < 0.98101 THEN 3 WHEN u < 0.99634 THEN 4 ELSE 5 END AS w
    FROM (SELECT sample, fused_score, <hash:concat(CAST(event_id AS <string>), '-', CAST(sample AS <string>))> / 4294967296.0 AS u FROM {rows} JOIN (SELECT <explode:<sequence:1, 50>> AS sample) AS samples ON true) AS drawn
  ) AS weighed GROUP BY sample
) AS means"""

#: What each threshold costs: 100 for a missed failure, 5 for a false alarm, 20 saved for a caught one.
BENEFIT = f"""
SELECT threshold, tp, fp, fn, 20 * tp - 5 * fp - 100 * fn AS net FROM (
  SELECT threshold, {_COUNTS.format(hit="score >= threshold")} FROM (SELECT fused_score AS score, {_TRUTH} AS truth, count(*) AS c FROM {{rows}} GROUP BY fused_score, {_TRUTH}) AS counted
  JOIN ({" UNION ALL ".join(f"SELECT {t / 10:.1f} AS threshold" for t in range(1, 10))}) AS grid ON true GROUP BY threshold
) AS swept"""

#: Pairs of functions whose failures by ten minutes go together: Pearson's correlation over all ten minutes there are.
FAILURES = """
WITH bins AS (SELECT function_id, t_us <div> 600000000 AS bin, sum(CASE WHEN truth THEN 1e0 ELSE 0e0 END) AS f FROM {rows} GROUP BY function_id, t_us <div> 600000000),
grid AS (SELECT function_id, bin FROM (SELECT DISTINCT function_id FROM bins) AS x JOIN (SELECT DISTINCT bin FROM bins) AS y ON true),
series AS (SELECT g.function_id, g.bin, coalesce(f, 0e0) AS f FROM grid g LEFT JOIN bins b ON g.function_id = b.function_id AND g.bin = b.bin)
SELECT a.function_id AS first_id, b.function_id AS second_id, round(corr(a.f, b.f), 4) AS correlation FROM series a JOIN series b ON a.bin = b.bin AND a.function_id < b.function_id GROUP BY a.function_id, b.function_id"""

#: Of pairs of a function's records within a minute, the share whose arrival and event times agree on the order.
ORDER = """
SELECT a.function_id, count(*) AS pairs, round(avg(CASE WHEN a.t_us <= b.t_us THEN 1e0 ELSE 0e0 END), 6) AS concordant
FROM (SELECT event_id, function_id, t_us, t_us <div> 60000000 + d AS slot FROM {rows} JOIN (SELECT <explode:<list:-1, 0, 1>> AS d) AS steps ON true) AS a JOIN (SELECT event_id, function_id, t_us, t_us <div> 60000000 AS slot FROM {rows}) AS b
  ON a.function_id = b.function_id AND a.slot = b.slot AND a.event_id < b.event_id AND abs(a.t_us - b.t_us) <= 60000000 GROUP BY a.function_id"""

#: Eleven features of a record for trained models.
FEATURES = """
SELECT event_id, duration, ln(1 + memory) AS log_memory, cpu, ln(1 + network) AS log_network, (t_us <div> 3600000000) % 24 AS hour, (t_us <div> 86400000000) % 7 AS weekday, CASE WHEN phase = 'invoke' THEN 1 ELSE 0 END AS invoked, CASE WHEN phase = 'error' THEN 1 ELSE 0 END AS failed,
  memory / (duration + 0.001) AS memory_rate, network / (duration + 0.001) AS network_rate, length(function_id) AS name_length FROM {rows}""".replace("ln(1 + memory)", "round(ln(1 + memory), 9)").replace("ln(1 + network)", "round(ln(1 + network), 9)")

#: Training on benign records alone: by hash order the first 200 train, the next 50 and all others test. Only those 250 are ordered.
SPLIT = """
WITH picked AS (SELECT event_id AS id, row_number() OVER (ORDER BY h, event_id) AS place FROM (SELECT event_id, <hash:event_id> AS h FROM {rows} WHERE anomaly_type = 'benign' ORDER BY h, event_id LIMIT 250) AS first_ones)
SELECT event_id, CASE WHEN anomaly_type <> 'benign' THEN 'test' WHEN place <= 200 THEN 'train' WHEN place <= 250 THEN 'test' ELSE 'spare' END AS part FROM {rows} LEFT JOIN picked ON event_id = id"""

_MB = "(memory / 1024.0)"
_PRICE = f"(0.0000166667 * {_MB} / 1024.0 * duration + 0.0000002 + network / 1073741824.0 * 0.00001)"
#: Scores of four kinds of cost attacks, the likeliest, whether it passes its threshold, and its estimated cost. Fixed values.
ATTACKS = f"""
SELECT event_id, round(dow + 1e-10, 4) AS dow, round(crypto + 1e-10, 4) AS crypto, round(amplification + 1e-10, 4) AS amplification, round(chaining + 1e-10, 4) AS chaining, kind, top >= CASE kind WHEN 'dow' THEN 0.7 WHEN 'crypto' THEN 0.8 WHEN 'amplification' THEN 0.6 ELSE 0.65 END AS attacked,
  round(price * CASE kind WHEN 'dow' THEN 2.0 + top * 8.0 WHEN 'crypto' THEN 1.5 + top * 3.5 WHEN 'amplification' THEN 3.0 + top * 12.0 ELSE 1.8 + top * 6.2 END, 9) AS cost
FROM (SELECT *, CASE WHEN dow >= top THEN 'dow' WHEN crypto >= top THEN 'crypto' WHEN amplification >= top THEN 'amplification' ELSE 'chaining' END AS kind FROM (SELECT *, greatest(dow, crypto, amplification, chaining) AS top FROM (
  SELECT event_id, {_PRICE} AS price,
    least(1.0, CASE WHEN {_PRICE} > 0.000042 THEN least(0.4, ({_PRICE} / 0.000021 - 2.0) / 8.0) ELSE 0.0 END + CASE WHEN duration > 0.225 THEN least(0.3, (duration / 0.15 - 1.5) / 5.0) ELSE 0.0 END + CASE WHEN {_MB} > 90 THEN least(0.2, ({_MB} / 45.0 - 2.0) / 8.0) ELSE 0.0 END + CASE WHEN truth THEN 0.1 ELSE 0.0 END) AS dow,
    least(1.0, CASE WHEN cpu > 45 THEN least(0.5, (cpu / 15.0 - 3.0) / 7.0) ELSE 0.0 END + CASE WHEN duration > 10 THEN least(0.3, (duration - 10.0) / 50.0) ELSE 0.0 END + CASE WHEN network / greatest(memory * 1024.0, 1.0) < 0.1 THEN 0.2 ELSE 0.0 END) AS crypto,
    least(1.0, CASE WHEN {_MB} > 450 THEN least(0.6, ({_MB} / 45.0 - 10.0) / 50.0) ELSE 0.0 END + CASE WHEN network > 104857600 THEN least(0.3, network / 1073741824.0) ELSE 0.0 END + CASE WHEN duration < 2 AND {_MB} > 200 THEN 0.1 ELSE 0.0 END) AS amplification,
    least(1.0, CASE WHEN {_MB} > 50 AND {_MB} < 150 THEN 0.2 ELSE 0.0 END + CASE WHEN duration > 0.5 AND duration < 3 THEN 0.3 ELSE 0.0 END + CASE WHEN network > 1024 AND network < 10485760 THEN 0.2 ELSE 0.0 END) AS chaining FROM {{rows}}
) AS scored) AS topped) AS named"""

_FIELDS = ("event_id", "t_us", "function_id", "phase", "anomaly_type", "duration", "memory", "cpu", "network")
#: How complete each function's trace is: mean share of the fields that are there (every 9th duration and 8th cpu is lost), verified from 0.8 on.
COMPLETENESS = f"""
SELECT function_id, count(*) AS n, round(avg(share), 6) AS score, avg(share) >= 0.8 AS verified, CAST(sum(CASE WHEN share < 1 THEN 1 ELSE 0 END) AS BIGINT) AS incomplete FROM (
  SELECT function_id, ({" + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in _FIELDS)}) / {len(_FIELDS)}e0 AS share
  FROM (SELECT event_id, t_us, function_id, phase, anomaly_type, CASE WHEN event_id % 9 > 0 THEN duration END AS duration, memory, CASE WHEN event_id % 8 > 0 THEN cpu END AS cpu, network FROM {{rows}}) AS lossy
) AS shares GROUP BY function_id"""

_ALIKE = {x: f"CASE WHEN greatest(abs({x}), abs(before_{x})) > 0 THEN 1.0 - abs({x} - before_{x}) / greatest(abs({x}), abs(before_{x})) ELSE 1.0 END" for x in ("duration", "memory", "cpu", "network")}
#: How much a record differs from its function's last one: mean likeness of its measures (four fifths) and words (a fifth), and its level.
CHANGES = f"""
SELECT event_id, round(likeness + 1e-10, 4) AS likeness, CASE WHEN likeness >= 0.95 THEN 'identical' WHEN likeness >= 0.8 THEN 'very_similar' WHEN likeness >= 0.6 THEN 'similar' WHEN likeness >= 0.4 THEN 'moderately_similar' WHEN likeness >= 0.2 THEN 'different' ELSE 'very_different' END AS level
FROM (SELECT event_id, ({" + ".join(_ALIKE.values())}) * 0.2 + 0.1 * (CASE WHEN phase = before_phase THEN 1 ELSE 0 END + CASE WHEN anomaly_type = before_type THEN 1 ELSE 0 END) AS likeness FROM (
  SELECT *, lag(phase) OVER (PARTITION BY function_id ORDER BY event_id) AS before_phase, lag(anomaly_type) OVER (PARTITION BY function_id ORDER BY event_id) AS before_type, {", ".join(f"lag({x}) OVER (PARTITION BY function_id ORDER BY event_id) AS before_{x}" for x in _ALIKE)} FROM {{rows}}
) AS paired WHERE before_phase IS NOT NULL) AS compared"""

_PRINT = ("n", "mean_duration", "spread", "failures", "mean_network")
#: A function's hours as fingerprints, and how like the hour before each is: mean ratio of the smaller to the larger of five figures.
FINGERPRINTS = f"""
WITH hours AS (SELECT function_id, t_us <div> 3600000000 AS hour, count(*) * 1e0 AS n, avg(duration) AS mean_duration, coalesce(stddev_pop(duration), 0e0) AS spread, sum(CASE WHEN truth THEN 1e0 ELSE 0e0 END) AS failures, avg(network) AS mean_network FROM {{rows}} GROUP BY function_id, t_us <div> 3600000000),
paired AS (SELECT *, {", ".join(f"lag({x}) OVER (PARTITION BY function_id ORDER BY hour) AS b_{x}" for x in _PRINT)} FROM hours)
SELECT function_id, hour, round(({" + ".join(f"CASE WHEN greatest({x}, b_{x}) > 0 THEN least({x}, b_{x}) / greatest({x}, b_{x}) ELSE 1.0 END" for x in _PRINT)}) / {len(_PRINT)}.0 + 1e-10, 4) AS similarity FROM paired WHERE b_n IS NOT NULL"""

_TEN = {"duration": "duration", "memory": "memory", "cpu": "cpu", "network": "network", "memory_rate": "memory / (duration + 0.001)", "network_rate": "network / (duration + 0.001)", "errors": "CASE WHEN truth THEN 1.0 ELSE 0.0 END", "odd": "CASE WHEN anomaly_type <> 'benign' THEN 1.0 ELSE 0.0 END", "cold": "CASE WHEN phase = 'init' THEN 1.0 ELSE 0.0 END", "name_length": "length(function_id) * 1.0"}
#: Ten metrics of the records: count, sum, least, most and mean of each.
METRICS = f"""
SELECT metric, count(v) AS n, round(sum(v), 2) AS total, round(min(v), 4) AS least, round(max(v), 4) AS most, round(avg(v), 4) AS mean
FROM (SELECT metric, CASE metric {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _TEN.items())} END AS v FROM {{rows}} JOIN ({" UNION ALL ".join(f"SELECT '{k}' AS metric" for k in _TEN)}) AS names ON true) AS told GROUP BY metric"""

#: Records, failures and mean duration by quarter of an hour, without gaps.
SERIES = """
WITH bins AS (SELECT t_us <div> 900000000 AS bin, count(*) AS n, CAST(sum(CASE WHEN truth THEN 1 ELSE 0 END) AS BIGINT) AS failures, avg(duration) AS mean_duration FROM {rows} GROUP BY t_us <div> 900000000),
spine AS (SELECT <explode:<sequence:lo, hi>> AS bin FROM (SELECT min(bin) AS lo, max(bin) AS hi FROM bins) AS ends)
SELECT spine.bin, coalesce(n, 0) AS n, coalesce(failures, 0) AS failures, round(coalesce(mean_duration, 0e0) + 1e-10, 4) AS mean_duration FROM spine LEFT JOIN bins ON spine.bin = bins.bin"""


def run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)
