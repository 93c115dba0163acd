"""Cases over stored detections, decision traces and the views that analysts keep.

A case gathers the detections of a function and hour that aren't merely observed; its history is a table of events by version, so the
latest version of each case and attachment is its state. The texts run in Spark and in DuckDB.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.functions.dialect import SPARK, fill

_OPEN = "('open', 'triage')"
#: Events of the cases: opened, a detection attached (and every 7th detached again), a status; versions rise by one.
EVENTS = """
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY t_us, event_id, step) AS version, step, event_id, t_us, decision,
  CASE WHEN step = 3 THEN CASE event_id % 4 WHEN 0 THEN 'triage' WHEN 1 THEN 'contained' WHEN 2 THEN 'closed' ELSE 'open' END END AS status
FROM (
  SELECT concat(function_id, '-', CAST(t_us <div> 3600000000 AS <string>)) AS case_id, event_id, t_us, decision, step
  FROM (SELECT * FROM {rows} WHERE decision <> 'observe') AS told JOIN (SELECT 1 AS step UNION ALL SELECT 2 UNION ALL SELECT 3) AS steps ON step = 1 OR step = 2 AND event_id % 7 = 0 OR step = 3 AND event_id % 5 = 0
) AS made"""
_HELD = "SELECT case_id, event_id, max(step) AS last_step, max(decision) AS decision FROM ({events}) AS e WHERE step < 3 GROUP BY case_id, event_id"
_STATE = """
SELECT case_id, max(version) AS version, coalesce(<pick_max:status, CASE WHEN status IS NOT NULL THEN version END>, 'open') AS status, min(t_us) AS opened_us FROM ({events}) AS e GROUP BY case_id"""


def _with(text: str) -> str:
    return text.replace("{held}", _HELD).replace("{state}", _STATE).replace("{events}", EVENTS)


#: Each case: state, attached detections, and the worst decision among them.
CASES = _with("""
SELECT s.case_id, status, version, opened_us, coalesce(n, 0) AS n_detections, CASE coalesce(worst, 0) WHEN 2 THEN 'escalate' WHEN 1 THEN 'review' ELSE 'none' END AS severity
FROM ({state}) AS s LEFT JOIN (
  SELECT case_id, count(*) AS n, max(CASE decision WHEN 'escalate' THEN 2 ELSE 1 END) AS worst FROM ({held}) AS h WHERE last_step = 1 GROUP BY case_id
) AS held ON s.case_id = held.case_id""")

#: The open case that a detection is attached to.
CASE_OF = _with("SELECT h.event_id, h.case_id, s.status FROM ({held}) AS h JOIN ({state}) AS s ON h.case_id = s.case_id WHERE h.last_step = 1 AND s.status IN " + _OPEN)

#: The case that each attached detection is in, whatever its state.
ATTACHED = _with("SELECT h.event_id, h.case_id, s.status FROM ({held}) AS h JOIN ({state}) AS s ON h.case_id = s.case_id WHERE h.last_step = 1")

#: Detections that aren't merely observed and are attached to no case.
UNATTACHED = _with("SELECT d.event_id, d.function_id, d.decision FROM {rows} AS d LEFT ANTI JOIN (SELECT event_id FROM ({held}) AS h WHERE last_step = 1) AS a ON d.event_id = a.event_id WHERE d.decision <> 'observe'")
UNATTACHED_SQL = UNATTACHED.replace("LEFT ANTI JOIN", "ANTI JOIN")

#: Each case's events, newest first.
COMMENTS = _with("SELECT case_id, version, step, event_id, row_number() OVER (PARTITION BY case_id ORDER BY version DESC) AS place FROM ({events}) AS e")

#: Inbox: by decision, how many are new, in open cases, and in closed ones.
INBOX = _with("""
SELECT d.decision, count(*) AS n, CAST(sum(CASE WHEN s.status IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_case, CAST(sum(CASE WHEN s.status IN ('open', 'triage') THEN 1 ELSE 0 END) AS BIGINT) AS in_open, CAST(sum(CASE WHEN s.status IN ('contained', 'closed') THEN 1 ELSE 0 END) AS BIGINT) AS in_done
FROM {rows} AS d LEFT JOIN (SELECT * FROM ({held}) AS h WHERE last_step = 1) AS a ON d.event_id = a.event_id LEFT JOIN ({state}) AS s ON a.case_id = s.case_id GROUP BY d.decision""")

#: Functions that have an open case (a semi-join), with their mix of decisions.
DETAIL = _with("""
SELECT function_id, CAST(sum(CASE WHEN decision = 'observe' THEN 1 ELSE 0 END) AS BIGINT) AS observe, CAST(sum(CASE WHEN decision = 'review' THEN 1 ELSE 0 END) AS BIGINT) AS review, CAST(sum(CASE WHEN decision = 'escalate' THEN 1 ELSE 0 END) AS BIGINT) AS escalate, <listed:anomaly_type> AS types
FROM {rows} WHERE event_id IN (SELECT event_id FROM ({held}) AS h JOIN ({state}) AS s ON h.case_id = s.case_id WHERE s.status IN ('open', 'triage')) GROUP BY function_id""")

#: How fast detections come in: those of the last hour, the last one, and all.
RATE = "SELECT CAST(sum(CASE WHEN r.t_us > l.last_us - 3600000000 THEN 1 ELSE 0 END) AS BIGINT) AS last_hour, max(r.t_us) AS last_us, count(*) AS total FROM {rows} AS r JOIN (SELECT max(t_us) AS last_us FROM {rows}) AS l ON true"

#: Roll-up of decisions by function and type with subtotals.
ROLLUP = "SELECT function_id, decision, count(*) AS n, round(avg(fused_score) + 1e-10, 4) AS mean_score FROM {rows} GROUP BY ROLLUP (function_id, decision)"
#: Every combination of type and decision with all margins.
CUBE = "SELECT anomaly_type, decision, count(*) AS n, grouping(anomaly_type) + 2 * grouping(decision) AS margin FROM {rows} GROUP BY CUBE (anomaly_type, decision)"
#: Functions by set algebra: with escalations or reviews, with both, and with reviews alone.
SETS = """
SELECT 'either' AS kind, function_id FROM (SELECT function_id FROM {rows} WHERE decision = 'escalate' UNION SELECT function_id FROM {rows} WHERE decision = 'review') AS u
UNION ALL SELECT 'both', function_id FROM (SELECT function_id FROM {rows} WHERE decision = 'review' INTERSECT SELECT function_id FROM {rows} WHERE fused_score > 0.35) AS i
UNION ALL SELECT 'review_only', function_id FROM (SELECT function_id FROM {rows} WHERE decision = 'review' EXCEPT SELECT function_id FROM {rows} WHERE fused_score > 0.35) AS e"""

# Fields to redact first, and signals with their weight in the matrix.
SENSITIVE = ("payload_hash", "content_hash", "signature", "container_id", "region", "runtime_version", "function_id", "trigger_type")
_SIGNALS = {"rule_chain": 0.7, "drift_tracker": 0.65, "graph_immunized": 0.6, "semantic_deviation": 0.75}
_POINT = {k: f"concat(lpad(CAST(10000 - CAST(floor({k} * 10000 + 0.5) AS INT) AS <string>), 5, '0'), '|{k}: score=', <fixed:'%.4f', round({k} + 1e-10, 4)>, ', confidence={c:.4f}')" for k, c in _SIGNALS.items()}
#: Decision traces, in turn terse, standard (two leading signals) and verbose (all), with a redaction budget of 0 to 3 fields after the caller's own.
TRACES = f"""
SELECT event_id, decision, CASE decision WHEN 'escalate' THEN 'immediate_containment_review' WHEN 'review' THEN 'analyst_triage' ELSE 'monitor' END AS action, verbosity,
  concat('Decision=', decision, ' with fused_score=', <fixed:'%.4f', fused_score>, ' (risk_band=', band, ') from 4 Layer-2 signals; consensus=', <fixed:'%.4f', signal_consensus>, '.') AS summary,
  CASE verbosity WHEN 'terse' THEN '' WHEN 'standard' THEN <sub:<joined:<part:points, 1, 2>, ' / '>, '[0-9]+[|]', ''> ELSE <sub:<joined:points, ' / '>, '[0-9]+[|]', ''> END AS points,
  CASE event_id % 4 {" ".join(f"WHEN {b} THEN '{','.join(dict.fromkeys(['region', *SENSITIVE[:b]]))}'" for b in range(4))} END AS redacted
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'terse' WHEN 1 THEN 'standard' ELSE 'verbose' END AS verbosity, <sorted:<list:{", ".join(_POINT.values())}>> AS points FROM {{rows}}) AS told"""


def run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)


def run_over(text: str, **tables: DataFrame) -> DataFrame:
    """A text over several named tables."""
    return next(iter(tables.values())).sparkSession.sql(fill(text, SPARK), **tables)


def apply_view(detections: DataFrame, view: Mapping[str, object]) -> DataFrame:
    """Detections that a saved view shows: equality on ``decision``, ``function_id``, ``anomaly_type``; ``min_score``; ``since_us`` and ``until_us`` (half open). Other keys are an error."""
    rows = detections
    for key, value in view.items():
        if key in ("decision", "function_id", "anomaly_type"):
            rows = rows.where(F.col(key) == value)
        elif key == "min_score":
            rows = rows.where(F.col("fused_score") >= value)
        elif key in ("since_us", "until_us"):
            rows = rows.where(F.col("t_us") >= value if key == "since_us" else F.col("t_us") < value)
        else:
            raise ValueError(f"a view has no field {key}")
    return rows
