"""All queries of the library and their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.functions import registered
from skytally.functions.dialect import DUCKDB, fill
from skytally.operators import analyst, attack, cases, casework, confidence, consent, curves, decisions, detectors, economics, evaluation, formal, governance, graph, intake, likeness, mapping, outliers, panel, privacy, records, rules, sampling, silent, studies, timelines, transforms, versions, views
from skytally.sources.shared import work_path
from skytally.sources.telemetry import ORACLE_VIEW, load
from skytally.streaming import stateful, windows

FLAGSHIP = "fused_scores"
Query = Callable[[SparkSession, str], DataFrame]
_VIEW = f"({ORACLE_VIEW}) AS telemetry"

def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of all events as the analyst store holds them: the decisions over the panel's scores."""
    return decisions.decided(_matrix(spark, sf_dir))


#: Where the store of a folder of tables was written, by Spark application and the state of its events.
_WRITTEN: dict[tuple[str, str, int, int], str] = {}


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a file or folder was last changed, and its bytes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(at).getModificationTime(), files.getContentSummary(at).getLength()


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store as a table: the first query of an application writes the detections of a folder, all others read them until its events change."""
    key = (spark.sparkContext.applicationId, sf_dir, *_state(spark, f"{sf_dir}/events.parquet"))
    if key not in _WRITTEN:
        path = work_path(spark, "store")
        stored(spark, sf_dir).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def _layers(*texts: str, inner: str = _VIEW) -> str:
    for text in texts:
        inner = f"({fill(text, DUCKDB).format(rows=inner)}) AS layer"
    return inner


#: The panel in full, as in the queries: the store's SQL once left it out, and so couldn't tell that the store did.
_STORED = f"({decisions.DECIDED_SQL}) AS layer"
_SCORED = f"(SELECT event_id, fused_score AS score, anomaly_type = 'execution_failure' AS truth FROM {_STORED}) AS scored"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).select("event_id", F.col("fused_score").alias("score"), (F.col("anomaly_type") == "execution_failure").alias("truth"))


def _on_view(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(load(spark, sf_dir))


def _on_store(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_store(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.fused(detectors.votes(load(spark, sf_dir)))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix reads nine detectors, so the others aren't run."""
    read = tuple(d for d in detectors.DETECTORS if d.name in decisions.READ)
    return decisions.matrix(decisions.signals(detectors.votes(load(spark, sf_dir), read)))


def _grid(spark: SparkSession) -> DataFrame:
    rows = [(t, k) for _, t, k in decisions.TECHNIQUES] + [decisions.DEFAULT_TECHNIQUE]
    return spark.createDataFrame(rows, "tactic string, technique string")


def _threat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyst.threat_map(_store(spark, sf_dir), _grid(spark))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir).where("decision <> 'observe'")
    return decisions.feedback_trust(rows.select("function_id", "t_us", "event_id", (F.col("event_id") % 3 != 0).alias("confirmed"), (F.col("tactic") == "impact").alias("impact"), "alignment"))


def _outcomes(store: DataFrame) -> DataFrame:
    return cases.outcomes(casework.run(cases.COMMANDS, store))


def _redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.redaction_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir).select(F.col("function_id").alias("actor"), F.col("t_us").alias("ts"), F.col("event_id").alias("id"), F.concat_ws(",", "event_id", "phase", "anomaly_type").alias("payload"))
    return rows


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyst.audit_chain(_audit_rows(spark, sf_dir))


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with a payload changed in each 97th row, and each 101st row removed."""
    chain = _audit(spark, sf_dir).where("id % 101 <> 50")
    return chain.withColumn("payload", F.when(F.col("id") % 97 == 13, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))


#: Each row's hash goes into the next one's, so the chain is a recursion along each actor's rows.
_CHAIN = f"""WITH RECURSIVE r AS MATERIALIZED (
  SELECT function_id AS actor, t_us AS ts, event_id AS id, concat_ws(',', event_id, phase, anomaly_type) AS payload, row_number() OVER (PARTITION BY function_id ORDER BY t_us, event_id) AS n FROM {_VIEW}
), c AS (
  SELECT actor, ts, id, payload, n, '' AS prev_hash, sha256(concat('|', payload)) AS row_hash FROM r WHERE n = 1
  UNION ALL SELECT r.actor, r.ts, r.id, r.payload, r.n, c.row_hash, sha256(concat(c.row_hash, '|', r.payload)) FROM c JOIN r ON r.actor = c.actor AND r.n = c.n + 1
)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.md5(governance.sanitise(F.col("html"))).alias("digest"), governance.looks_like_sql(F.col("html")).alias("sql_like"), governance.clean_url(F.col("url")).alias("url"))


def _stream(made: Callable[[DataFrame], DataFrame], mode: str = "append") -> Query:
    return lambda spark, sf_dir: windows.drained(made(windows.source(spark, sf_dir)), mode)


def _stream_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors over a stream with carried history: votes of the records that are settled once all has been read."""
    return stateful.settled_votes(windows.source(spark, sf_dir))


#: Windows are given out once the watermark, in whole milliseconds and five seconds behind the latest record, has passed their end.
_PASSED = f"(SELECT max(t_us) // 1000 * 1000 - 5000000 FROM {_VIEW})"
_WINDOW = "count(*) AS n, round(avg(duration) + 1e-10, 4) AS mean_duration, max(duration) AS max_duration, count(*) FILTER (WHERE truth) AS errors"
_DEGREE_VIEW = f"(SELECT function_id, decision, t_us, unnest(string_split(techniques, ',')) AS technique FROM {_STORED}) AS used"
_RANKED = "CASE max(CASE decision WHEN 'observe' THEN 0 WHEN 'review' THEN 1 ELSE 2 END) WHEN 0 THEN 'observe' WHEN 1 THEN 'review' WHEN 2 THEN 'escalate' END"

#: name: (query, SQL or None)
QUERIES: dict[str, tuple[Query, str | None]] = {
    "telemetry_view": (load, ORACLE_VIEW),
    "detector_votes": (_on_view(detectors.votes), detectors.ORACLE_SQL),
    "fused_scores": (_panel, decisions.FUSED_SQL),
    "detection_matrix": (_matrix, decisions.MATRIX_SQL),
    "decisions": (stored, decisions.DECIDED_SQL),
    "stored_detections": (stored, f"SELECT * FROM {_STORED}"),
    "top_decisions": (
        _on_store(decisions.top_decisions),
        f"SELECT * FROM (SELECT function_id, event_id, fused_score, decision, row_number() OVER (PARTITION BY function_id ORDER BY fused_score DESC, event_id) AS rank FROM {_STORED}) WHERE rank <= 3",
    ),
    "feedback_trust": (_feedback, None),
    "list_detections": (
        _on_store(lambda x: analyst.list_detections(x, decision="review", text="failure", technique="T1059.009", limit=40, offset=10)),
        f"SELECT * FROM {_STORED} WHERE decision = 'review' AND (contains(lower(function_id), 'failure') OR contains(lower(anomaly_type), 'failure') OR contains(lower(decision), 'failure')) AND list_contains(string_split(techniques, ','), 'T1059.009') ORDER BY t_us DESC, event_id DESC LIMIT 40 OFFSET 10",
    ),
    "severity_mix": (_on_store(analyst.severity_mix), f"SELECT d AS decision, count(s.event_id) AS n FROM (SELECT unnest(['observe', 'review', 'escalate']) AS d) LEFT JOIN {_STORED.removesuffix(' AS layer')} AS s ON s.decision = d GROUP BY d"),
    "hourly_histogram": (
        _on_store(analyst.histogram),
        f"WITH c AS (SELECT t_us // 3600000000 * 3600000000 AS bin, count(*) FILTER (WHERE decision = 'observe') AS observe, count(*) FILTER (WHERE decision = 'review') AS review, count(*) FILTER (WHERE decision = 'escalate') AS escalate FROM {_STORED} GROUP BY 1), b AS (SELECT unnest(generate_series((SELECT min(bin) FROM c), (SELECT max(bin) FROM c), 3600000000)) AS bin) SELECT b.bin, coalesce(observe, 0) AS observe, coalesce(review, 0) AS review, coalesce(escalate, 0) AS escalate FROM b LEFT JOIN c USING (bin)",
    ),
    "function_rollup": (
        _on_store(analyst.function_rollup),
        f"SELECT function_id, count(*) AS n, count(*) FILTER (WHERE t_us > now - 86400000000) AS n_day, count(*) FILTER (WHERE t_us > now - 604800000000) AS n_week, max(t_us) AS last_us, round(avg(fused_score), 4) AS mean_score, {_RANKED} AS worst, max(t.techniques) AS techniques FROM (SELECT *, max(t_us) OVER () AS now FROM {_STORED}) AS r JOIN (SELECT function_id, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques FROM {_DEGREE_VIEW} GROUP BY 1) AS t USING (function_id) GROUP BY function_id",
    ),
    "threat_map": (
        _threat_map,
        "SELECT tactic, technique, coalesce(n, 0) AS n, worst FROM (VALUES " + ", ".join(f"('{t}', '{k}')" for t, k in [(t, k) for _, t, k in decisions.TECHNIQUES] + [decisions.DEFAULT_TECHNIQUE]) + f") AS g(tactic, technique) LEFT JOIN (SELECT technique, count(*) AS n, {_RANKED} AS worst FROM {_DEGREE_VIEW} GROUP BY 1) AS c USING (technique)",
    ),
    "technique_top": (
        _on_store(analyst.technique_top),
        f"SELECT * FROM (SELECT function_id, technique, count(*) AS n, row_number() OVER (PARTITION BY function_id ORDER BY count(*) DESC, technique) AS rank FROM {_DEGREE_VIEW} GROUP BY 1, 2) WHERE rank <= 5",
    ),
    "audit_chain": (_audit, f"{_CHAIN} SELECT actor, ts, id, payload, prev_hash, row_hash FROM c"),
    "audit_broken_links": (
        lambda s, d: analyst.broken_links(_tampered(s, d)),
        f"{_CHAIN}, t AS (SELECT actor, ts, id, prev_hash, row_hash, CASE WHEN id % 97 = 13 THEN concat(payload, '!') ELSE payload END AS payload FROM c WHERE id % 101 <> 50), l AS (SELECT *, coalesce(lag(row_hash) OVER (PARTITION BY actor ORDER BY ts, id), '') AS before_hash FROM t) SELECT actor, arg_min(id, (ts, id)) AS first_broken, count(*) AS n_broken FROM l WHERE before_hash <> prev_hash OR row_hash <> sha256(concat(prev_hash, '|', payload)) GROUP BY actor",
    ),
    "keep_newest": (
        _on_store(lambda x: analyst.keep_newest(x.select("function_id", "event_id", "t_us"), 5, by="function_id", order="t_us")),
        f"SELECT function_id, event_id, t_us FROM (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY t_us DESC, event_id DESC) AS k FROM {_STORED}) WHERE k <= 5",
    ),
    "threshold_sweep": (lambda s, d: evaluation.threshold_sweep(scored(s, d)), fill(evaluation.SWEEP, DUCKDB).format(rows=_SCORED, steps="range(5, 96) AS r(i)")),
    "roc_auc": (lambda s, d: evaluation.auc(scored(s, d)), fill(evaluation.AUC, DUCKDB).format(rows=_SCORED)),
    "effect_sizes": (lambda s, d: evaluation.effects(scored(s, d)), fill(evaluation.EFFECTS, DUCKDB).format(rows=_SCORED)),
    "outlier_baselines": (_on_view(evaluation.baselines), fill(evaluation.BASELINES, DUCKDB).format(rows=_VIEW)),
    "cost_spikes": (_on_view(economics.spikes), fill(economics.SPIKES, DUCKDB).format(rows=_VIEW)),
    "cost_profile": (_on_view(economics.profile), fill(economics.PROFILE, DUCKDB).format(rows=_VIEW)),
    "economic_risk": (_on_view(economics.risk), fill(economics.RISK, DUCKDB).format(rows=_VIEW)),
    "record_validation": (_on_view(governance.validate), fill(governance.VALIDATE, DUCKDB).format(rows=_VIEW)),
    "batch_quality": (_on_view(governance.batch_quality), fill(governance.QUALITY, DUCKDB).format(rows=_VIEW)),
    "incidents": (_on_view(governance.incidents), fill(governance.INCIDENTS, DUCKDB).format(rows=_VIEW)),
    "repeated_records": (_on_view(governance.repeats), fill(governance.REPEATS, DUCKDB).format(rows=_VIEW)),
    "document_redaction": (
        _redaction,
        "WITH a AS (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[REDACTED_EMAIL]', 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', '[REDACTED_IP]', 'g') AS t FROM a), c AS (SELECT doc_id, regexp_replace(t, '\\b[0-9]{16}\\b', '[REDACTED_CARD]', 'g') AS t FROM b), e AS (SELECT doc_id, regexp_replace(t, '\\+[0-9]{1,3} \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}', '[REDACTED_PHONE]', 'g') AS t FROM c) SELECT doc_id, "
        + ", ".join(f"CAST((length(t) - length(replace(t, '[REDACTED_{k}]', ''))) / {len(f'[REDACTED_{k}]')} AS BIGINT) AS n_{k.lower()}" for k, _ in governance.PATTERNS)
        + ", md5(t) AS digest FROM e",
    ),
    "page_sanitising": (
        _pages,
        "SELECT page_id, md5(replace(replace(replace(replace(replace(translate(regexp_replace(regexp_replace(html, '[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]', '', 'g'), '<script[^>]*>.*?</script>', '', 'gis'), ';&|$`', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest, regexp_matches(html, '(?i)\\b(select|insert|update|delete|drop|create|alter|truncate|union|exec)\\b') AS sql_like, CASE WHEN regexp_matches(lower(url), '^https?://') THEN regexp_replace(url, '^(https?://)[^/?#@]*@', '\\1') END AS url FROM pages",
    ),
    "graph_edges": (_on_view(graph.edges), graph.oracle(graph.EDGES, ORACLE_VIEW)),
    "anomaly_centrality": (_on_view(graph.centrality), graph.oracle(graph.CENTRALITY, ORACLE_VIEW)),
    "previous_record": (_on_view(lambda x: graph.run(graph.AS_OF, x)), graph.oracle(graph.AS_OF, ORACLE_VIEW)),
    "function_transitions": (_on_view(lambda x: graph.run(graph.TRANSITIONS, x)), graph.oracle(graph.TRANSITIONS, ORACLE_VIEW)),
    "function_pagerank": (_on_view(lambda x: graph.pagerank(graph.run(graph.TRANSITIONS, x))), graph.pagerank_sql(graph.oracle(graph.TRANSITIONS, ORACLE_VIEW))),
    "sampling_profile": (_on_view(lambda x: sampling.run(sampling.profile, x)), graph.oracle(sampling.PROFILE, ORACLE_VIEW)),
    "sampling_summary": (_on_view(lambda x: sampling.run(sampling.summary, x)), graph.oracle(sampling.SUMMARY, ORACLE_VIEW)),
    "silent_failures": (_on_view(lambda x: silent.run(silent.PROBABILITY, x)), fill(silent.PROBABILITY, DUCKDB).format(rows=f"({ORACLE_VIEW})")),
    "dialogue_traces": (lambda s, d: silent.run(silent.TRACES, s.read.parquet(f"{d}/conversations.parquet")), fill(silent.TRACES, DUCKDB).format(rows="conversations")),
    "temporal_properties": (_on_view(lambda x: silent.run(silent.PROPERTIES, x)), graph.oracle(silent.PROPERTIES, ORACLE_VIEW)),
    "causal_pairs": (_on_view(lambda x: silent.run(silent.PAIRS_JOINED, x)), fill(silent.PAIRS, DUCKDB).format(rows=_VIEW)),
    "text_entropy": (lambda s, d: silent.run(silent.ENTROPY, s.read.parquet(f"{d}/documents.parquet")), fill(silent.ENTROPY, DUCKDB).format(rows="documents")),
    "perturbed_records": (_on_view(lambda x: transforms.run(transforms.PERTURBED, x)), graph.oracle(transforms.PERTURBED, ORACLE_VIEW)),
    "transform_utility": (_on_view(lambda x: transforms.run(transforms.UTILITY, x)), graph.oracle(transforms.UTILITY, ORACLE_VIEW)),
    "privacy_budget": (_on_view(lambda x: transforms.run(transforms.BUDGET, x)), graph.oracle(transforms.BUDGET, ORACLE_VIEW)),
    "anonymity_groups": (_on_view(lambda x: transforms.run(transforms.ANONYMITY, x)), graph.oracle(transforms.ANONYMITY, ORACLE_VIEW)),
    "stream_tumbling": (_stream(windows.tumbling), f"SELECT t_us // 30000000 * 30000000 AS start_us, t_us // 30000000 * 30000000 + 30000000 AS end_us, function_id, {_WINDOW} FROM {_VIEW} GROUP BY 1, 2, 3 HAVING end_us <= {_PASSED}"),
    "stream_sliding": (
        _stream(windows.sliding),
        f"SELECT start_us, start_us + 30000000 AS end_us, function_id, {_WINDOW} FROM (SELECT *, t_us // 10000000 * 10000000 - o * 10000000 AS start_us FROM {_VIEW}, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY 1, 2, 3 HAVING start_us + 30000000 <= {_PASSED}",
    ),
    "stream_sessions": (
        _stream(windows.sessions),
        f"SELECT min(t_us) AS start_us, max(t_us) + 30000000 AS end_us, function_id, {_WINDOW} FROM (SELECT *, sum(fresh) OVER (PARTITION BY function_id ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY function_id ORDER BY t_us) < 30000000 THEN 0 ELSE 1 END AS fresh FROM {_VIEW})) GROUP BY function_id, k HAVING max(t_us) + 30000000 <= {_PASSED}",
    ),
    "stream_global": (
        _stream(windows.global_window, "complete"),
        f"SELECT CAST(CAST('0x' || substr(md5(function_id), 1, 8) AS BIGINT) % 4 AS INT) AS part, {_WINDOW} FROM {_VIEW} GROUP BY 1",
    ),
    "stream_votes": (_stream_votes, f"SELECT * FROM ({detectors.ORACLE_SQL}) WHERE t_us <= (SELECT max(t_us) FROM {_VIEW}) - {stateful.LATENESS}"),
    "stream_deduplicated": (_stream(lambda x: windows.deduplicated(x).drop("at"), "append"), ORACLE_VIEW),
}


_HOURS = f"SELECT function_id, t_us // 3600000000 * 3600000000 AS bin, count(*) FILTER (WHERE decision = 'observe') AS observe, count(*) FILTER (WHERE decision = 'review') AS review, count(*) FILTER (WHERE decision = 'escalate') AS escalate FROM {_STORED} GROUP BY 1, 2"
QUERIES["function_histogram"] = (
    _on_store(lambda x: analyst.histogram(x, by=["function_id"])),
    f"WITH c AS ({_HOURS}), b AS (SELECT function_id, unnest(generate_series(min(bin), max(bin), 3600000000)) AS bin FROM c GROUP BY function_id) SELECT function_id, bin, coalesce(observe, 0) AS observe, coalesce(review, 0) AS review, coalesce(escalate, 0) AS escalate FROM b LEFT JOIN c USING (function_id, bin)",
)
#: Texts that both engines run, over scores and over the telemetry view.
_ON_SCORES = {"curve_points": curves.POINTS, "curve_areas": curves.AREAS, "alarm_control": curves.ALARMS, "score_gaps": curves.GAPS, "fold_accuracy": curves.FOLDS}
_ON_RECORDS = {
    "latency_profile": curves.LATENCY, "loss_comparison": curves.LOSS, "link_accuracy": curves.LINKS, "covariance_envelope": curves.ENVELOPE,
    "buffer_shedding": timelines.BUFFER, "quality_trend": timelines.TREND, "channel_states": timelines.CHANNELS, "service_ranking": timelines.SERVICE, "incident_overlaps": timelines.OVERLAPS,
    "majority_phase": timelines.MAJORITY, "metric_summary": timelines.METRICS,
    "emission_priority": records.EMISSION, "redacted_forms": records.REDACTED, "field_transforms": records.MAPPED, "latest_consent": records.CONSENT,
}
for _name, _text in _ON_SCORES.items():
    QUERIES[_name] = (lambda s, d, text=_text: curves.run(text, scored(s, d)), fill(_text, DUCKDB).format(rows=_SCORED))
for _name, _text in _ON_RECORDS.items():
    QUERIES[_name] = (lambda s, d, text=_text: curves.run(text, load(s, d)), fill(_text, DUCKDB).format(rows=_VIEW))
QUERIES["page_addresses"] = (lambda s, d: records.run(records.ADDRESSES, s.read.parquet(f"{d}/pages.parquet")), fill(records.ADDRESSES, DUCKDB).format(rows="pages"))
_ON_RECORDS = {
    "adapted_records": intake.ADAPTED, "checked_records": intake.CHECKED, "signed_records": intake.SIGNED, "preserved_records": intake.PRESERVED, "record_context": intake.CONTEXT,
    "accepted_records": intake.ACCEPTED, "schema_inference": intake.INFERRED, "record_routing": intake.ROUTED,
}
for _name, _text in _ON_RECORDS.items():
    QUERIES[_name] = (lambda s, d, text=_text: intake.run(text, load(s, d)), fill(_text, DUCKDB).format(rows=_VIEW))
QUERIES["trigger_types"] = (lambda s, d: intake.run(intake.TRIGGERS, s.read.parquet(f"{d}/events.parquet")), fill(intake.TRIGGERS, DUCKDB).format(rows="events"))
_ON_STORE = {
    "case_list": casework.CASES, "case_of_detection": casework.CASE_OF, "case_comments": casework.COMMENTS, "inbox_summary": casework.INBOX, "function_detail": casework.DETAIL, "ingest_rate": casework.RATE,
    "decision_rollup": casework.ROLLUP, "decision_cube": casework.CUBE, "decision_sets": casework.SETS, "decision_traces": casework.TRACES,
}
for _name, _text in _ON_STORE.items():
    QUERIES[_name] = (_on_store(lambda x, text=_text: casework.run(text, x)), fill(_text, DUCKDB).format(rows=_STORED.removesuffix(" AS layer")))
QUERIES["unattached_detections"] = (_on_store(lambda x: casework.run(casework.UNATTACHED, x)), fill(casework.UNATTACHED_SQL, DUCKDB).format(rows=_STORED.removesuffix(" AS layer")))
QUERIES["saved_view"] = (_on_store(lambda x: casework.apply_view(x, {"decision": "review", "min_score": 0.3, "function_id": "fn-3"})), f"SELECT * FROM {_STORED} WHERE decision = 'review' AND fused_score >= 0.3 AND function_id = 'fn-3'")
_STUDIED = {
    "calibration_sweep": studies.CALIBRATION, "signal_ablation": studies.ABLATION, "class_tests": studies.TESTS, "stratified_folds": studies.FOLDS, "bootstrap_interval": studies.BOOTSTRAP, "cost_benefit": studies.BENEFIT, "paired_tests": studies.paired(studies.PAIRS),
}
for _name, _text in _STUDIED.items():
    QUERIES[_name] = (_on_store(lambda x, text=_text: studies.run(text, x)), fill(_text, DUCKDB).format(rows=_STORED.removesuffix(" AS layer")))
_MEASURED = {
    "failure_correlation": studies.FAILURES, "order_accuracy": studies.ORDER, "model_features": studies.FEATURES, "benign_split": studies.SPLIT, "attack_scores": studies.ATTACKS, "completeness_scores": studies.COMPLETENESS,
    "change_levels": studies.CHANGES, "hourly_fingerprints": studies.FINGERPRINTS, "invocation_metrics": studies.METRICS, "metric_series": studies.SERIES,
    "correlation_edges": graph.CORRELATIONS, "graph_density": graph.DENSITY, "causal_strengths": graph.STRENGTHS, "causal_successors": graph.SUCCESSORS,
}
for _name, _text in _MEASURED.items():
    QUERIES[_name] = (_on_view(lambda x, text=_text: studies.run(text, x)), fill(_text, DUCKDB).format(rows=_VIEW.removesuffix(" AS telemetry")))
#: Spark joins only pairs that can pass.
for _name, _operator in {"correlation_edges": graph.correlations, "graph_density": graph.density_of, "causal_strengths": graph.strengths, "causal_successors": graph.successors}.items():
    QUERIES[_name] = (_on_view(_operator), QUERIES[_name][1])
QUERIES["suspicious_paths"] = (_on_view(graph.suspicious_paths), graph.PATHS_SQL.format(successors=fill(graph.SUCCESSORS, DUCKDB).format(rows=_VIEW.removesuffix(" AS telemetry"))))
_OFTEN = "source <> target AND lift > 1"
QUERIES["function_centralities"] = (_on_view(lambda x: graph.centralities(graph.run(graph.TRANSITIONS, x).where(_OFTEN))), graph.centralities_sql(f"SELECT * FROM ({graph.oracle(graph.TRANSITIONS, ORACLE_VIEW)}) AS t WHERE {_OFTEN}"))
QUERIES["function_eigenvector"] = (_on_view(lambda x: graph.eigenvector(graph.run(graph.TRANSITIONS, x).where(_OFTEN))), graph.eigenvector_sql(f"SELECT * FROM ({graph.oracle(graph.TRANSITIONS, ORACLE_VIEW)}) AS t WHERE {_OFTEN}"))
QUERIES["text_features"] = (lambda s, d: graph.run(graph.TEXTS, graph.run(graph.TEXTS_OF, s.read.parquet(f"{d}/events.parquet"))), _layers(graph.TEXTS, inner=f"({fill(graph.TEXTS_OF, DUCKDB).format(rows='events')}) AS texts").removeprefix("(").removesuffix(") AS layer"))
QUERIES["migrated_records"] = (
    _on_view(lambda x: versions.migrated(graph.run(versions.VERSIONED, x), "2.0")),
    fill(versions.migration("2.0", versions.SCHEMAS, versions.LINKS), DUCKDB).format(rows=f"({fill(versions.VERSIONED, DUCKDB).format(rows=_VIEW)}) AS versioned"),
)
_COMMANDS = fill(cases.COMMANDS, DUCKDB).format(rows=_STORED)
_OUTCOMES = f"({cases.outcomes_sql(_COMMANDS)})"
QUERIES["case_outcomes"] = (_on_store(_outcomes), f"SELECT * FROM {_OUTCOMES}")
QUERIES["case_events"] = (_on_store(lambda x: casework.run_over(cases.EVENTS, outcomes=_outcomes(x))), fill(cases.EVENTS, DUCKDB).format(outcomes=_OUTCOMES))
QUERIES["case_states"] = (_on_store(lambda x: casework.run_over(cases.STATE, outcomes=_outcomes(x))), fill(cases.STATE, DUCKDB).format(outcomes=_OUTCOMES))
QUERIES["attack_paths"] = (_on_view(attack.attack_paths), attack.oracle(_VIEW))
QUERIES["density_clusters"] = (_on_view(graph.density_clusters), None)
QUERIES["chained_records"] = (
    _on_view(lambda x: versions.migrated(graph.run(versions.VERSIONED, x), "3.0")),
    fill(versions.migration("3.0", versions.SCHEMAS, versions.LINKS), DUCKDB).format(rows=f"({fill(versions.VERSIONED, DUCKDB).format(rows=_VIEW)}) AS versioned"),
)
#: The panel with a detector of one's own.
_EXTENDED = panel.Panel().register(panel.EXAMPLE, 0.2)
QUERIES["extended_panel"] = (_on_view(lambda x: _EXTENDED.fused(_EXTENDED.votes(x))), _EXTENDED.fused_sql())
QUERIES["registered_functions"] = (_on_store(registered.technique_spread), registered.SPREAD_SQL.format(rows=_STORED))
QUERIES["normalised_events"] = (lambda s, d: mapping.normalised(mapping.raw_events(s.read.parquet(f"{d}/events.parquet"))), mapping.NORMALISED_SQL)
QUERIES["mapped_fields"] = (_on_view(mapping.example), mapping.example_sql(_VIEW))
QUERIES["payload_changes"] = (lambda s, d: likeness.changes(likeness.payloads(s.read.parquet(f"{d}/events.parquet")), "payload", by="user_id", order="event_id", id_col="event_id"), likeness.ORACLE_SQL)
QUERIES["consent_decisions"] = (lambda s, d: consent.decided(s.read.parquet(f"{d}/events.parquet")), consent.ORACLE_SQL)


def _attached(store: DataFrame) -> DataFrame:
    """The case of each attached detection, as its own commands left it."""
    return casework.run(casework.ATTACHED, store)


#: Pages are opened at the end of January 2024 in the view's time (see ``sources.telemetry``), in whose half day the events lie, and show the last six hours.
_NOW = 1_706_659_200_000_000 // 60
_SINCE, _UNTIL = views.window_of("custom", now_us=_NOW, since_us=_NOW - 6 * views.HOUR, until_us=_NOW)
_ATTACHED = f"({fill(casework.ATTACHED, DUCKDB).format(rows=_STORED.removesuffix(' AS layer'))})"
_LISTED = f"SELECT function_id, technique, count(*) AS n, row_number() OVER (PARTITION BY function_id ORDER BY count(*) DESC, technique) AS place FROM (SELECT function_id, unnest(string_split(techniques, ',')) AS technique FROM {{rows}}) GROUP BY function_id, technique"


def _function_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return views.function_page(store, _attached(store), now_us=_NOW, decision="review", technique="T10", sort="open_case_count_desc", limit=12, offset=2)


def _function_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    found = views.function_detail(store, _attached(store), since_us=_SINCE, until_us=_UNTIL)
    return found.select("function_id", "observe", "review", "escalate", *(F.to_json(c).alias(c) for c in ("techniques", "line", "recent", "cases")))


QUERIES["function_page"] = (
    _function_page,
    f"""WITH store AS MATERIALIZED (SELECT * FROM {_STORED}), held AS MATERIALIZED (SELECT * FROM {_ATTACHED} WHERE status <> 'closed'), picked AS (SELECT * FROM store WHERE decision = 'review' AND len(list_filter(string_split(techniques, ','), lambda t: starts_with(t, 'T10'))) > 0),
counted AS (SELECT function_id, max(t_us) AS last_us, count(*) FILTER (WHERE t_us >= {_NOW - views.DAY}) AS n_day, count(*) FILTER (WHERE t_us >= {_NOW - 7 * views.DAY}) AS n_week, 'review' AS worst FROM picked GROUP BY function_id),
cases AS (SELECT function_id, count(DISTINCT case_id) AS k FROM store JOIN held USING (event_id) GROUP BY function_id), top AS (SELECT function_id, string_agg(technique, ',' ORDER BY place) AS tops FROM ({_LISTED.format(rows="picked")}) WHERE place <= 3 GROUP BY function_id)
SELECT c.function_id, last_us, n_day, n_week, worst, coalesce(k, 0) AS n_open_cases, coalesce(tops, '') AS top_techniques, (SELECT count(*) FROM counted) AS total FROM counted c LEFT JOIN cases USING (function_id) LEFT JOIN top USING (function_id) ORDER BY n_open_cases DESC, last_us DESC, function_id LIMIT 12 OFFSET 2""",
)
QUERIES["function_views"] = (
    _function_views,
    f"""WITH store AS MATERIALIZED (SELECT * FROM {_STORED}), held AS MATERIALIZED (SELECT * FROM {_ATTACHED} WHERE status <> 'closed'), rows_ AS MATERIALIZED (SELECT * FROM store WHERE t_us >= {_SINCE} AND t_us < {_UNTIL}),
mix AS (SELECT function_id, count(*) FILTER (WHERE decision = 'observe') AS observe, count(*) FILTER (WHERE decision = 'review') AS review, count(*) FILTER (WHERE decision = 'escalate') AS escalate FROM rows_ GROUP BY function_id),
top AS (SELECT function_id, list(struct_pack(technique := technique, n := n) ORDER BY place) AS techniques FROM ({_LISTED.format(rows="rows_")}) WHERE place <= 5 GROUP BY function_id),
line AS (SELECT function_id, list(struct_pack(bin := bin, n := n, worst := worst) ORDER BY bin) AS line FROM (SELECT function_id, t_us // 3600000000 * 3600000000 AS bin, count(*) AS n, {_RANKED} AS worst FROM rows_ GROUP BY 1, 2) GROUP BY function_id),
recent AS (SELECT function_id, list(struct_pack(event_id := event_id, t_us := t_us, decision := decision, anomaly_type := anomaly_type) ORDER BY k) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY t_us DESC, event_id DESC) AS k FROM rows_) WHERE k <= 20 GROUP BY function_id),
cases AS (SELECT function_id, list(struct_pack(case_id := case_id, status := status) ORDER BY case_id) AS cases FROM (SELECT DISTINCT function_id, case_id, status FROM store JOIN held USING (event_id)) GROUP BY function_id)
SELECT function_id, observe, review, escalate, {", ".join(f"coalesce(CAST(to_json({c}) AS VARCHAR), '[]') AS {c}" for c in ("techniques", "line", "recent", "cases"))}
FROM mix LEFT JOIN top USING (function_id) LEFT JOIN line USING (function_id) LEFT JOIN recent USING (function_id) LEFT JOIN cases USING (function_id)""",
)
#: All reviews are put into one case at once; what was in another case stays there.
QUERIES["bulk_attach"] = (
    _on_store(lambda x: views.bulk_action(x.where("decision = 'review'"), _attached(x), "attach", case_id="sweep")),
    f"SELECT s.event_id, CASE WHEN a.case_id IS NULL THEN 'sweep' END AS case_id, a.case_id IS NULL AS ok, CASE WHEN a.case_id IS NOT NULL THEN 'already_attached' END AS error FROM {_STORED.removesuffix(' AS layer')} AS s LEFT JOIN {_ATTACHED} AS a USING (event_id) WHERE decision = 'review'",
)
QUERIES["bulk_dismiss"] = (
    _on_store(lambda x: views.bulk_action(x.where("decision <> 'observe'"), _attached(x), "dismiss")),
    f"SELECT s.event_id, a.case_id, true AS ok, CAST(NULL AS VARCHAR) AS error FROM {_STORED.removesuffix(' AS layer')} AS s LEFT JOIN {_ATTACHED} AS a USING (event_id) WHERE decision <> 'observe'",
)
QUERIES["exported_detections"] = (
    _on_store(views.exported),
    f"SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(t_us AS VARCHAR) AS t_us, function_id, anomaly_type, decision, printf('%.4f', round(fused_score + 1e-10, 4)) AS fused_score, band, replace(techniques, ',', ';') AS techniques FROM {_STORED}",
)


def _trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an action of its function on the audit trail."""
    return load(spark, sf_dir).select(F.col("function_id").alias("actor"), F.col("t_us").alias("ts"), F.col("event_id").alias("id"), F.col("phase").alias("action"))


_TRAIL = f"(SELECT function_id AS actor, t_us AS ts, event_id AS id, phase AS action FROM {_VIEW}) AS trail"
QUERIES["audit_page"] = (
    lambda s, d: views.audit_page(_trail(s, d), actor="fn-3", action="invoke", until=_NOW - 2 * views.HOUR, limit=20, offset=5),
    f"SELECT *, count(*) OVER () AS total FROM {_TRAIL} WHERE actor = 'fn-3' AND action = 'invoke' AND ts <= {_NOW - 2 * views.HOUR} ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 5",
)
QUERIES["audit_summary"] = (
    lambda s, d: views.audit_summary(_trail(s, d)),
    f"SELECT actor, action, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts // 86400000000) AS n_days FROM {_TRAIL} GROUP BY ROLLUP (actor, action)",
)
QUERIES["page_rules"] = (
    lambda s, d: rules.checked(s.sql(rules.PAGES + "parquet.`" + d + "/pages.parquet`"), rules.PAGE_RULES, id_col="page_id"),
    rules.checked_sql(f"({rules.PAGES} pages)", rules.PAGE_COLUMNS, rules.PAGE_RULES, id_col="page_id"),
)
QUERIES["anomaly_clusters"] = (_on_view(graph.clusters), None)
QUERIES["temporal_formulas"] = (_on_view(formal.properties), formal.properties_sql(_VIEW))
QUERIES["fusion_uncertainty"] = (lambda s, d: studies.run(decisions.UNCERTAINTY, detectors.votes(load(s, d))), fill(decisions.UNCERTAINTY, DUCKDB).format(rows=f"({detectors.ORACLE_SQL})"))
QUERIES["fusion_confidence"] = (lambda s, d: confidence.confidence(detectors.votes(load(s, d))), confidence.confidence_sql(detectors.ORACLE_SQL))
QUERIES["panel_statistics"] = (lambda s, d: confidence.statistics(detectors.votes(load(s, d))), confidence.statistics_sql(detectors.ORACLE_SQL))
QUERIES["detector_trust"] = (lambda s, d: decisions.detector_trust(detectors.votes(load(s, d))), decisions.detector_trust_sql(detectors.ORACLE_SQL))
QUERIES["document_privacy"] = (lambda s, d: privacy.report(s.read.parquet(f"{d}/documents.parquet")), None)
QUERIES["digest_library"] = (_on_view(privacy.digests), None)
QUERIES["detector_suite"] = (_on_view(outliers.suite), None)
QUERIES["detector_comparison"] = (_on_view(lambda x: outliers.compared(outliers.suite(x))), None)
QUERIES["forest_scores"] = (_on_view(lambda x: decisions.fused(outliers.forest_votes(detectors.votes(x)))), None)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
