"""Records on their way in: adaptation, full validation, cleaning, keyed hashes, preservation, quality, trust, schema inference, routing.

Row by row, in one projection each, so nothing is shuffled. The texts run in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill
from skytally.operators.decisions import NORMALISED

# Phases and labels as they are after adaptation.
PHASES = {"init": "initialization", "invoke": "execution", "shutdown": "completion", "error": "error", "timeout": "timeout"}
LABELS = ("benign", "suspicious", "malicious", "unknown")


def _case(column: str, names: dict[str, str], other: str) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in names.items())} ELSE {other!r} END"


#: Adapted records: an identifier made from the event's, a safe name of 256 characters at most, mapped phase and label. Some rows (every 11th to 17th) arrive broken, as the view itself has no faults.
ADAPTED = f"""
SELECT event_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS record_id, t_us,
  CASE WHEN event_id % 11 = 3 THEN NULL ELSE substr(<sub:coalesce(function_id, 'unknown'), '[^a-zA-Z0-9_.-]', '_'>, 1, 256) END AS function_name, {_case("phase", PHASES, "execution")} AS execution_phase,
  CASE WHEN event_id % 13 = 5 THEN 'odd' ELSE {_case("anomaly_type", NORMALISED, "unknown")} END AS label, anomaly_type AS raw_label, CASE WHEN event_id % 17 = 2 THEN -duration ELSE duration END AS duration, memory, CASE WHEN event_id % 17 = 4 THEN cpu + 100.0 ELSE cpu END AS cpu, network,
  'v2.1' AS schema_version, CASE WHEN phase = 'error' AND event_id % 3 > 0 THEN 'failed' END AS error_message
FROM (SELECT *, md5(CAST(event_id AS <string>)) AS h FROM {{rows}}) AS named"""

_REQUIRED = ("record_id", "t_us", "function_name", "execution_phase", "label", "duration", "schema_version")
_CHECKS = [
    *((f"missing {f}", f"{f} IS NULL") for f in _REQUIRED), *((f"empty {f}", f"{f} = ''") for f in ("record_id", "function_name", "schema_version")),
    ("phase", f"execution_phase NOT IN ({', '.join(map(repr, PHASES.values()))})"), ("label", f"label NOT IN ({', '.join(map(repr, LABELS))})"),
    ("long name", "length(function_name) > 256"), ("long version", "length(schema_version) > 32"), ("long id", "length(record_id) > 128"), ("time", "t_us <= 0"),
    ("duration", "duration < 0"), ("memory", "memory < 0"), ("cpu", "cpu < 0 OR cpu > 100"), ("network", "network < 0"), ("no message", "execution_phase = 'error' AND coalesce(error_message, '') = ''"),
    ("id form", "NOT <matches:record_id, '^[0-9a-f]+-[0-9a-f]+-[0-9a-f]+-[0-9a-f]+-[0-9a-f]+$'>"), ("version form", "NOT <matches:schema_version, '^v[0-9]+([.][0-9]+)*$'>"), ("not finite", "abs(duration) > 1e300 OR duration <> duration"),
]
#: Every fault of each adapted record, and whether it passes.
CHECKED = f"""
SELECT event_id, faults, n_faults, n_faults = 0 AS valid FROM (
  SELECT event_id, concat_ws(',', {", ".join(f"CASE WHEN {c} THEN {n!r} END" for n, c in _CHECKS)}) AS faults, {" + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in _CHECKS)} AS n_faults FROM ({ADAPTED}) AS adapted
) AS checked"""

_CANON = "concat('{{\"anomaly_type\":\"', raw_label, '\",\"duration\":', CAST(CAST(floor(abs(duration) * 1000 + 0.5) AS BIGINT) AS <string>), ',\"function\":\"', coalesce(function_name, ''), '\",\"id\":\"', record_id, '\"}}')"
#: Canonical text (keys in order, numbers in thousandths), its digest, its keyed signature, and whether the signature holds for what arrived: every 50th text was changed on the way.
SIGNED = f"""
SELECT event_id, content_hash, signature, <hmac:arrived> = signature AS verified FROM (
  SELECT event_id, <sha256:text> AS content_hash, <hmac:text> AS signature, CASE WHEN event_id % 50 = 7 THEN concat(text, ' ') ELSE text END AS arrived FROM (SELECT event_id, {_CANON} AS text FROM ({ADAPTED}) AS adapted) AS said
) AS sent"""

#: The nine protected fields before and after cleaning that rounds and masks: share kept (numbers within 1e-9), those at risk, and what to do.
_PROTECTED = {
    "execution_phase": "execution_phase", "label": "CASE WHEN label = 'odd' THEN 'unknown' ELSE label END", "duration": "round(duration, 1)", "memory": "memory", "cpu": "least(cpu, 100.0)", "network": "network",
    "schema_version": "schema_version", "function_name": "lower(function_name)", "raw_label": "raw_label",
}
_NUMBERS = ("duration", "memory", "cpu", "network")
_LOST = {f: (f"abs({f} - ({v})) > 1e-9" if f in _NUMBERS else f"coalesce({f}, '') <> coalesce({v}, '')") for f, v in _PROTECTED.items()}
PRESERVED = f"""
SELECT event_id, score, at_risk, CASE WHEN score >= 0.995 THEN 'none' WHEN score >= 0.8 THEN 'review transforms' ELSE 'bypass transforms' END AS advice FROM (
  SELECT event_id, round(1.0 - ({" + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _LOST.values())}) / {len(_LOST)}.0 + 1e-10, 4) AS score, concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in _LOST.items())}) AS at_risk
  FROM ({ADAPTED}) AS adapted
) AS assessed"""

_KEPT = f"(1.0 - ({' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for c in _LOST.values())}) / {len(_LOST)}.0)"
_CONFIDENCE = "greatest(0.1, CASE WHEN execution_phase = 'error' THEN 0.7 ELSE 1.0 END * CASE WHEN cpu > 95 THEN 0.9 ELSE 1.0 END * CASE WHEN duration > 10 THEN 0.8 ELSE 1.0 END)"
_TRUST = f"round(greatest(0.1, least(1.0, {_CONFIDENCE} * {_KEPT})) + 1e-10, 4)"
_TRACE = "<sha1:concat_ws('|', record_id, coalesce(function_name, ''), CAST(t_us AS <string>))>"
#: Completeness of the seven required fields, trace identifier, and trust (confidence, less for extremes and errors, times the share of protected fields that is preserved, from 0.1 to 1).
CONTEXT = f"""
SELECT event_id, completeness, {_TRACE} AS trace_id, {_TRUST} AS trust FROM (
  SELECT *, round(({" + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in _REQUIRED)}) / {len(_REQUIRED)}.0 + 1e-10, 4) AS completeness FROM ({ADAPTED}) AS adapted
) AS rated"""

#: Names without invisible characters and shell marks; the message's markup is escaped; other fields are critical and pass as they are.
_CLEAN_NAME = "translate(<sub:function_name, '[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]', ''>, ';&|$`', '')"
#: The whole way in for records that pass, in one projection of the record's own columns: adapted, checked, cleaned, its function's name made a keyed pseudonym, preserved, traced, trusted and signed.
ACCEPTED = f"""
SELECT event_id, signature, trace_id, trust, preservation, clean_name, pseudonym, clean_message FROM (
  SELECT *, <hmac:text> AS signature FROM (
    SELECT event_id, {_CANON} AS text, CASE WHEN event_id % 50 = 7 THEN concat({_CANON}, ' ') ELSE {_CANON} END AS arrived, {_TRACE} AS trace_id, {_TRUST} AS trust, round({_KEPT} + 1e-10, 4) AS preservation,
      {_CLEAN_NAME} AS clean_name, substr(<hmac:function_name>, 1, 32) AS pseudonym, <sub:replace(replace(coalesce(error_message, ''), '&', '&amp;'), '\"', '&quot;'), '[;|$`]', ''> AS clean_message
    FROM ({ADAPTED}) AS adapted WHERE {" + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in _CHECKS)} = 0
  ) AS said
) AS sent WHERE <hmac:arrived> = signature"""

# Fixed values of the example: versions with their required fields and all fields.
_SCHEMAS = {"v1": (("event_id",), ("event_id", "duration")), "v2": (("event_id", "function_name"), ("event_id", "function_name", "duration", "memory")), "v3": (("event_id", "function_name", "error_message"), ("event_id", "function_name", "error_message", "cpu", "network"))}
_HAS = lambda f: f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END"
_MATCH = {
    v: f"CASE WHEN {' + '.join(map(_HAS, must))} < {len(must)} THEN 0.0 ELSE 0.6 * ({' + '.join(map(_HAS, fields))}) / {len(fields)}.0 + 0.4 END" for v, (must, fields) in _SCHEMAS.items()
}
#: The version whose fields a record fits best: none if a required one is missing, else .6 x overlap + .4 x matching types (all do here); 0.7 at least.
INFERRED = f"""
SELECT event_id, CASE WHEN best < 0.7 THEN NULL {" ".join(f"WHEN m_{v} >= best THEN '{v}'" for v in _SCHEMAS)} END AS version, round(best + 1e-10, 4) AS score FROM (
  SELECT *, greatest({", ".join(f"m_{v}" for v in _SCHEMAS)}) AS best FROM (SELECT event_id, {", ".join(f"{m} AS m_{v}" for v, m in _MATCH.items())} FROM ({ADAPTED}) AS adapted) AS matched
) AS ranked"""

#: Where a record goes: channel by urgency and verbosity; a primary that is down for that minute fails over, and without a second the record is kept locally.
ROUTED = """
SELECT event_id, urgency, channel, CASE WHEN NOT down THEN channel WHEN channel = 'stream' THEN 'queue' WHEN channel = 'queue' THEN 'store' ELSE 'local' END AS sent_to FROM (
  SELECT *, CASE WHEN urgency >= 8 THEN 'stream' WHEN urgency >= 5 THEN 'queue' ELSE 'store' END AS channel FROM (
    SELECT event_id, t_us <div> 60000000 % 10 = 3 AS down, CASE WHEN anomaly_type = 'execution_failure' THEN 8 WHEN anomaly_type <> 'benign' THEN 5 ELSE 3 END AS urgency FROM {rows} WHERE anomaly_type <> 'benign' OR event_id % 4 = 0
  ) AS weighed
) AS placed"""

#: What set a call off, from its kind and fields.
TRIGGERS = """
SELECT event_id, CASE WHEN lower(event_type) LIKE '%purchase%' THEN 'queue' WHEN json_key IS NULL THEN 'direct' WHEN lower(event_type) LIKE '%sign%' THEN 'api' WHEN lower(event_type) = 'error' THEN 'retry' ELSE 'stream' END AS trigger, event_type = 'error' AND value > 100 AS fallback
FROM (SELECT *, <json_k> AS json_key FROM {rows}) AS read"""


def run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK).replace("{{", "{").replace("}}", "}") if "{rows}" not in text else fill(text, SPARK), rows=rows)
