"""From votes to decisions: fusion, enrichment, the detection matrix, trust fusion, classification, technique alignment, feedback.

All of it is arithmetic on one row, so it adds no shuffle to the panel's; the feedback fold alone is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytally.functions.dialect import DUCKDB, SPARK, fill
from skytally.operators.detectors import NAMES
from skytally.operators.detectors import ORACLE_SQL as VOTES_SQL
from skytally.operators.order_statistics import numbered

# Fusion weights; detectors without one have 0.01.
WEIGHTS = {
    "statistical_outlier": 0.15, "isolation_forest": 0.12, "temporal_deviation": 0.10, "resource_spike": 0.08, "execution_pattern": 0.08, "network_anomaly": 0.07, "memory_leak": 0.06, "cpu_burst": 0.06,
    "io_intensive": 0.05, "cold_start": 0.05, "timeout_pattern": 0.04, "frequency_anomaly": 0.04, "duration_outlier": 0.03, "correlation_break": 0.03, "seasonal_deviation": 0.02, "trend_change": 0.02,
}
# Severity by anomaly type (0 to 10); others 5. Categories of the types the view can name.
SEVERITY = {"benign": 0, "cold_start": 1, "cpu_burst": 2, "memory_spike": 3, "io_intensive": 2, "network_anomaly": 4, "execution_failure": 6, "starvation_fallback": 5, "timeout_fallback": 5, "economic_abuse": 8}
NORMALISED = {"benign": "benign", "cpu_burst": "suspicious", "memory_spike": "suspicious", "execution_failure": "suspicious", "cold_start": "suspicious", "io_intensive": "suspicious", "network_anomaly": "suspicious", "starvation_fallback": "suspicious", "timeout_fallback": "suspicious"}
# Label parts, tactic and technique, in order.
TECHNIQUES = (
    (("timeout", "dos"), "impact", "T1499"),
    (("injection",), "execution", "T1059"),
    (("serverless", "lambda_invoke", "function_invocation", "cold_start", "execution_pattern", "invocation_anomaly"), "execution", "T1648"),
    (("exfil", "leak"), "exfiltration", "T1567"),
    (("s3_exfil", "cloud_bucket", "account_transfer", "cross_account", "network_anomaly"), "exfiltration", "T1537"),
    (("spike", "drift", "frequency_anomaly", "infrastructure_enum", "resource_discovery"), "discovery", "T1580"),
    (("metadata", "credential", "sts_token", "assume_role", "security_anomaly", "env_variable"), "credential-access", "T1552.005"),
)
DEFAULT_TECHNIQUE = ("collection", "T1059.009")



def weight(name: str) -> float:
    return WEIGHTS.get(name, 0.01)


def _case(column: str, names: dict[str, object], other: object) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else repr(x)
    return f"CASE {column} {' '.join(f'WHEN {quote(k)} THEN {quote(v)}' for k, v in names.items())} ELSE {quote(other)} END"


_TYPES = ("cold_start", "cpu_burst", "economic_abuse", "execution_failure", "io_intensive", "memory_spike", "network_anomaly", "starvation_fallback", "timeout_fallback")


def _mean_of(*names: str) -> str:
    return "round((" + " + ".join(f"{n}_confidence" for n in names) + f") / {len(names)}.0 + 1e-10, 4)"


#: Detectors whose votes are a record's markers of drift: in latency, memory, load and variance.
DRIFTS = ("performance_regression", "memory_leak", "behavioral_drift", "trend_change")
SILENT = ("dependency_failure", "cascade_failure", "error_clustering", "resource_starvation")
#: The detectors that the matrix reads.
READ = (*DRIFTS, "economic_abuse", *SILENT)
_DRIFTED = " + ".join(f"CASE WHEN {n}_detected THEN 1 ELSE 0 END" for n in DRIFTS)
#: What the matrix reads of fused scores, for votes of the detectors in ``READ`` alone.
SIGNALS = f"""
SELECT event_id, t_us, function_id, phase, anomaly_type, duration, memory, cpu, network, {_mean_of("economic_abuse")} AS economic, {_mean_of(*SILENT)} AS silent, {_DRIFTED} AS drift_markers FROM {{rows}}"""


def fused_text(weights: Mapping[str, float], types: Sequence[str] = _TYPES, keep: Sequence[str] = ()) -> str:
    """Text that fuses the votes of the detectors named by ``weights``; ``types`` are the anomaly types that they may name, ``keep`` more columns over the votes."""
    total, types = round(sum(weights.values()), 6), sorted(types)
    votes = lambda value: "(" + " + ".join(f"CASE WHEN {n}_detected THEN {w} * {value.format(n=n)} ELSE 0.0 END" for n, w in weights.items()) + f") / {total}"
    for_type = {t: "(" + " + ".join(f"CASE WHEN {n}_detected AND {n}_type = '{t}' THEN {w} ELSE 0.0 END" for n, w in weights.items()) + ")" for t in types}
    most = f"greatest({', '.join(f'w_{t}' for t in types)})"
    # Of types with equal weight the first by name.
    primary = f"CASE WHEN {most} = 0 THEN 'benign' {' '.join(f'WHEN w_{t} >= {most} - 1e-9 THEN {chr(39)}{t}{chr(39)}' for t in types)} END"
    count, need = "(" + " + ".join(f"CASE WHEN {n}_detected THEN 1 ELSE 0 END" for n in weights) + ")", max(2, min(3, len(weights) // 2))
    return f"""
SELECT event_id, t_us, function_id, phase, anomaly_type, duration, memory, cpu, network, truth, vote_score, vote_confidence, detectors_hit, consensus, primary_type,
  vote_score > 0.5 AND vote_confidence > 0.6 AND detectors_hit >= {need} AS anomaly, adversarial, economic, silent, drift_markers,
  round(least(1.0, 0.3 * severity / 10.0 + 0.25 * adversarial + 0.2 * economic + 0.15 * silent + 0.1 * (1.0 - vote_confidence)) + 1e-10, 4) AS risk{"".join(f", {k}" for k in keep)}
FROM (
  SELECT *, {primary} AS primary_type FROM (
    SELECT *, round({votes("1.0")} + 1e-10, 4) AS vote_score, round({votes("{n}_confidence")} + 1e-10, 4) AS vote_confidence, {count} AS detectors_hit, round({count} / {len(weights)}.0 + 1e-10, 4) AS consensus,
      {", ".join(f"{v} AS w_{t}" for t, v in for_type.items())},
      {_mean_of("security_anomaly", "behavioral_drift", "execution_pattern", "isolation_forest")} AS adversarial, {_mean_of("economic_abuse")} AS economic,
      {_mean_of(*SILENT)} AS silent, {_case("anomaly_type", SEVERITY, 5)} AS severity, {_DRIFTED} AS drift_markers
    FROM {{rows}}
  ) AS weighed
) AS named"""


FUSED = fused_text({n: weight(n) for n in NAMES})
_TOTAL = round(sum(weight(n) for n in NAMES), 6)
_VOTED = "(" + " + ".join(f"CASE WHEN {n}_detected THEN {weight(n)} ELSE 0.0 END" for n in NAMES) + f") / {_TOTAL}"

_COMPLETE = "(" + " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in ("function_id", "t_us", "phase", "anomaly_type", "duration", "memory", "cpu", "network")) + ") / 8.0"
#: A record's parents are its function's records of the minute before it; its causal depth counts those before it in an unbroken chain, each at most a minute after the one before.
_PARENTS = """SELECT *, row_number() OVER (PARTITION BY function_id, chain ORDER BY t_us, event_id) - 1 AS depth FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY function_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain, count(*) OVER (PARTITION BY function_id ORDER BY t_us RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING) AS parents
      FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY function_id ORDER BY t_us, event_id) <= 60000000 THEN 0 ELSE 1 END AS fresh FROM {rows}) AS gaps
    ) AS chains"""
_MINUTE = "count(*) OVER (PARTITION BY function_id ORDER BY t_us RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING)"
_GROWN = "(CASE WHEN t_us IS NULL THEN {} ELSE {} - {} END)".format(*(_MINUTE.replace("60000000 PRECEDING AND 1 PRECEDING", f"UNBOUNDED PRECEDING AND {end}") for end in ("CURRENT ROW", "1 PRECEDING", "60000001 PRECEDING")))
#: The same in Spark, along one order: a chain's rows are numbered from the last row that began one.
_CHAINS = f"""SELECT *, nth - max(CASE WHEN fresh = 1 THEN nth END) OVER (PARTITION BY function_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM (
      SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY function_id ORDER BY t_us, event_id) <= 60000000 THEN 0 ELSE 1 END AS fresh, row_number() OVER (PARTITION BY function_id ORDER BY t_us, event_id) AS nth, {_GROWN} AS parents FROM {{rows}}
    ) AS gaps"""
_CLAMPED = {"rule_chain": 0.7, "drift_tracker": 0.65, "graph_immunized": 0.6, "semantic_deviation": 0.75}
_SUM = round(sum(_CLAMPED.values()), 6)
MATRIX = f"""
SELECT event_id, function_id, t_us, anomaly_type, label, rule_chain, drift_tracker, graph_immunized, semantic_deviation, round(aggregate + 1e-10, 4) AS aggregate, aggregate >= 0.15 AS indicated, signal_consensus
FROM (
  SELECT *, ({" + ".join(f"{k} * {v}" for k, v in _CLAMPED.items())}) / {_SUM} AS aggregate,
    round(({" + ".join(f"CASE WHEN {k} >= 0.3 THEN 1 ELSE 0 END" for k in _CLAMPED)}) / 4.0, 4) AS signal_consensus
  FROM (
    SELECT event_id, function_id, t_us, anomaly_type, {_case("anomaly_type", NORMALISED, "unknown")} AS label,
      CASE WHEN duration >= 1 THEN 0.2 ELSE 0.0 END + CASE WHEN memory >= 131072 THEN 0.3 ELSE 0.0 END + CASE WHEN cpu >= 80 THEN 0.25 ELSE 0.0 END + CASE WHEN network >= 4096 THEN 0.15 ELSE 0.0 END AS rule_chain,
      least(1.0, 0.25 * drift_markers + economic * 0.25 + silent * 0.25 + 0.15 * (1.0 - {_COMPLETE})) AS drift_tracker, least(1.0, parents / 8.0 + least(0.25, 0.05 * depth)) AS graph_immunized,
      least(1.0, CASE WHEN anomaly_type <> 'benign' THEN 0.45 ELSE 0.0 END + CASE WHEN phase IN ('init', 'invoke') THEN 0.1 ELSE 0.0 END + CASE WHEN anomaly_type = 'execution_failure' THEN 0.1 ELSE 0.0 END
        + CASE WHEN {_case("anomaly_type", SEVERITY, 5)} >= 7 THEN 0.1 ELSE 0.0 END) AS semantic_deviation
    FROM ({_PARENTS}) AS chained
  ) AS signals
) AS weighed"""


def _technique_columns(label: str) -> tuple[str, str]:
    has = lambda parts: "(" + " OR ".join(f"lower({label}) LIKE '%{p.replace('_', '!_')}%' ESCAPE '!'" for p in parts) + ")"
    first = " ".join(f"WHEN {has(p)} THEN '{t}'" for p, t, _ in TECHNIQUES)
    found = ", ".join(f"CASE WHEN {has(p)} THEN '{k}' END" for p, _, k in TECHNIQUES)
    return f"CASE {first} ELSE '{DEFAULT_TECHNIQUE[0]}' END", f"coalesce(nullif(concat_ws(',', {found}), ''), '{DEFAULT_TECHNIQUE[1]}')"


_TACTIC, _FOUND = _technique_columns("anomaly_type")
_TACTICS = {t: "(" + " OR ".join(f"lower(anomaly_type) LIKE '%{q.replace('_', '!_')}%' ESCAPE '!'" for p, u, _ in TECHNIQUES if u == t for q in p) + ")" for t in dict.fromkeys(t for _, t, _ in TECHNIQUES)}
DECIDED = f"""
SELECT event_id, function_id, t_us, anomaly_type, label, aggregate, fused_score, CASE WHEN fused_score >= 0.75 THEN 'high' WHEN fused_score >= 0.3 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN fused_score >= 0.75 THEN 'escalate' WHEN fused_score >= 0.09 THEN 'review' ELSE 'observe' END AS decision,
  rule_chain, drift_tracker, graph_immunized, semantic_deviation, signal_consensus, {_TACTIC} AS tactic, {_FOUND} AS techniques, round(least(1.0, 0.45 + 0.15 * greatest(1, {" + ".join(f"CASE WHEN {v} THEN 1 ELSE 0 END" for v in _TACTICS.values())})), 4) AS alignment
FROM (
  SELECT *, round(greatest(0.0, least(1.0, raw - least(0.15, abs(aggregate - raw)) + least(0.1, signal_consensus * 0.1))) + 1e-10, 4) AS fused_score
  FROM (SELECT *, ({" + ".join(f"{k} * {v}" for k, v in _CLAMPED.items())}) / {_SUM} AS raw FROM {{rows}}) AS weighed
) AS fused"""


def _run(rows: DataFrame, text: str) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)


def fused(votes: DataFrame) -> DataFrame:
    """Weighted vote, confidence, type with most weight, consensus, the decision rule, enrichment scores and overall risk of each record."""
    return _run(votes, FUSED)


def signals(votes: DataFrame) -> DataFrame:
    """What ``matrix`` reads of fused scores, from votes of the detectors in ``READ``."""
    return _run(votes, SIGNALS)


def matrix(scores: DataFrame) -> DataFrame:
    """Four signals of each fused record and their weighted aggregate. The parents' frame is the difference of two that only grow."""
    return _run(scores, MATRIX.replace(_PARENTS, _CHAINS))


def decided(signals: DataFrame) -> DataFrame:
    """Trust-fused score, band, decision and attack techniques; the label is the raw anomaly type, so that techniques can match."""
    return _run(signals, DECIDED)


def _nested(*texts: str) -> str:
    inner = f"({VOTES_SQL}) AS votes"
    for text in texts[:-1]:
        inner = f"({fill(text, DUCKDB).format(rows=inner)}) AS layer"
    return fill(texts[-1], DUCKDB).format(rows=inner)


FUSED_SQL, MATRIX_SQL, DECIDED_SQL = _nested(FUSED), _nested(FUSED, MATRIX), _nested(FUSED, MATRIX, DECIDED)


_SHARES = {n: f"CASE WHEN {n}_detected THEN {weight(n)} * {n}_confidence ELSE 0.0 END / {_TOTAL}" for n in NAMES}
_CONTRIBUTED = ", ".join(f"CASE WHEN {n}_detected THEN concat(lpad(CAST(10000 - CAST(floor({n}_confidence * 10000 + 0.5) AS INT) AS <string>), 5, '0'), '|{n}') END" for n in NAMES)
#: How sure a fusion is: mean and variance of the weighted score over resampled panels (in closed form), its interval, the gap between vote and confidence, and the three detectors that say most.
UNCERTAINTY = f"""
SELECT event_id, round(m + 1e-10, 4) AS mean_score, round(v + 1e-10, 6) AS variance, round(greatest(0.0, m - 1.96 * sqrt(v)) + 1e-10, 4) AS low, round(least(1.0, m + 1.96 * sqrt(v)) + 1e-10, 4) AS high, CASE WHEN m > 0.5 THEN true ELSE false END AS above_half,
  round(abs(votes - m) + 1e-10, 4) AS data_uncertainty, <sub:<joined:<part:said, 1, 3>, ','>, '[0-9]+[|]', ''> AS contributors
FROM (
  SELECT event_id, {" + ".join(_SHARES.values())} AS m, greatest(0.0, ({" + ".join(f"({v}) * ({v})" for v in _SHARES.values())}) - ({" + ".join(_SHARES.values())}) * ({" + ".join(_SHARES.values())}) / {len(NAMES)}.0) AS v,
    {_VOTED} AS votes, <sorted:<kept:<list:{_CONTRIBUTED}>>> AS said FROM {{rows}}
) AS summed"""

#: Trust in a detector by its accuracy against the truth; fewer than ten records tell nothing yet. Fixed values.
_LADDER = "CASE WHEN n < 10 THEN 0.7e0 WHEN right_ >= 0.9 * n THEN 1.0e0 WHEN right_ >= 0.7 * n THEN 0.7e0 WHEN right_ >= 0.5 * n THEN 0.4e0 ELSE 0.1e0 END"


def detector_trust(votes: DataFrame) -> DataFrame:
    """By detector: records, right ones, trust, and the fusion weight times trust as a share of all. One pass over the votes."""
    counts = votes.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"{n}_detected") == F.col("truth")).alias(n) for n in NAMES))
    rows = counts.select("n", F.inline(F.array(*(F.struct(F.lit(n).alias("detector"), F.lit(weight(n)).alias("base"), F.col(n).alias("right_")) for n in NAMES))))
    rated = rows.withColumn("trust", F.expr(_LADDER))
    total = F.sum(F.col("base") * F.col("trust")).over(Window.partitionBy())
    return rated.select("detector", "n", F.col("right_").alias("n_right"), "trust", F.round(F.col("base") * F.col("trust") / total, 6).alias("weight"))


def detector_trust_sql(votes: str) -> str:
    counted = ", ".join(f"count(*) FILTER (WHERE {n}_detected = truth) AS {n}" for n in NAMES)
    rows = " UNION ALL ".join(f"SELECT '{n}' AS detector, {weight(n)!r}::DOUBLE AS base, n, {n} AS right_ FROM counted" for n in NAMES)
    return f"WITH counted AS MATERIALIZED (SELECT count(*) AS n, {counted} FROM ({votes})), rated AS (SELECT *, {_LADDER} AS trust FROM ({rows})) SELECT detector, n, right_ AS n_right, trust, round(base * trust / sum(base * trust) OVER (), 6) AS weight FROM rated"


def feedback_trust(feedback: DataFrame, *, start: float = 0.8, by: str = "function_id", order: str = "t_us", block: int = 1000, rounds: int = 2) -> DataFrame:
    """Trust after all analyst feedback (columns by, order, event_id, confirmed, impact, alignment), clamped to 0.1..1 at every step.

    A clamped step is the map x -> least(hi, greatest(lo, x + d)), and so are several in a row. Steps are composed within blocks of
    ``block`` in order, and the blocks' maps, one row each, are composed in order again until each key has few; so no list grows
    with the feedback. Steps are in hundredths, so that sums are exact.
    """
    step = F.when(F.col("confirmed"), 5).otherwise(-5) + F.when(F.col("impact"), 2).otherwise(0) + F.when(F.col("alignment") >= 0.75, 1).otherwise(0)
    now = numbered(feedback.select(by, F.struct(order, "event_id").alias("o"), F.col(order).alias("t"), step.cast("long").alias("d")), by, "t", "k", ties="o")
    now = now.select(by, "k", F.lit(1).cast("long").alias("n"), "d", F.lit(10).cast("long").alias("lo"), F.lit(100).cast("long").alias("hi"))
    start100 = F.struct(F.lit(0).cast("long").alias("d"), F.lit(-1000).cast("long").alias("lo"), F.lit(1000).cast("long").alias("hi"))

    def then(a: Column, x: Column) -> Column:
        inside = lambda v: F.least(x["hi"], F.greatest(x["lo"], v + x["d"]))
        return F.struct((a["d"] + x["d"]).alias("d"), inside(a["lo"]).alias("lo"), inside(a["hi"]).alias("hi"))

    for _ in range(rounds):
        blocks = now.groupBy(by, F.floor((F.col("k") - 1) / block).alias("b")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "d", "lo", "hi"))).alias("xs"))
        now = blocks.select(by, (F.col("b") + 1).alias("k"), "n", F.aggregate("xs", start100, then).alias("m")).select(by, "k", "n", "m.*")
    last = now.groupBy(by).agg(F.sum("n").alias("n_feedback"), F.sort_array(F.collect_list(F.struct("k", "d", "lo", "hi"))).alias("xs"))
    trust = F.aggregate("xs", F.lit(round(start * 100)).cast("long"), lambda v, x: F.least(x["hi"], F.greatest(x["lo"], v + x["d"])))
    return last.select(by, F.round(trust / 100, 4).alias("trust"), "n_feedback")


def top_decisions(decisions: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` records with the highest fused score of each function."""
    rank = F.row_number().over(Window.partitionBy("function_id").orderBy(F.desc("fused_score"), "event_id"))
    return decisions.withColumn("rank", rank).where(F.col("rank") <= k).select("function_id", "event_id", "fused_score", "decision", "rank")
