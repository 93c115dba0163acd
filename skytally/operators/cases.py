"""Analyst cases as a log of commands: what each command does, or why it is rejected, and the state that the log leads to.

A command is tried against the state that all earlier ones left. Creating, updating and deleting depend on a case's version alone: absent
is 0, a create takes 0 to 1, an update takes the version that it expects to the next one and leaves others, a delete takes any version to 0.
Such maps compose, so the commands of a case are cut into blocks; each block is summed up as one map from versions to versions, the
blocks' maps, one short row each, are followed in order, and every block then runs again from the version it begins with. A case with
very many commands is thus dealt over as many tasks as it has blocks.

Attaching and detaching depend on who holds the detection, in whatever case, so they follow a detection's commands in order, in one
pass over sorted rows that keeps one holder in mind; a holder's case that is deleted lets go of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytally.operators.order_statistics import numbered
from skytally.sources.shared import work_path

# States of a case.
STATES = ("open", "triage", "contained", "closed")
#: Commands of a case that are summed up as one map.
BLOCK = 5000
#: A version that no command of a block expects stands for itself.
OTHER = -1
_COLUMNS = "command_id long, case_id string, kind string, expected long, status string, assignee string, detection_id long"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def block_map(kinds: list[str], expected: list[int | None]) -> dict[int, int]:
    """Where a block takes each version: 0, each one that an update of it expects, and ``OTHER`` for all the rest.

    Versions that have met move together from then on, so a step is the move of one group into another.
    """
    at: dict[int, list[int]] = {v: [v] for v in {0, OTHER, *(e for k, e in zip(kinds, expected, strict=True) if k == "update" and e is not None and e > 0)}}

    def move(a: int, b: int) -> None:
        mine, theirs = at.pop(a), at.get(b, [])
        small, large = sorted((mine, theirs), key=len)
        large.extend(small)
        at[b] = large

    for kind, e in zip(kinds, expected, strict=True):
        if kind == "create" and 0 in at:
            move(0, 1)
        elif kind == "update" and e is not None and e > 0 and e in at:
            move(e, e + 1)
        elif kind == "delete":
            for v in [v for v in at if v != 0]:
                move(v, 0)
    return {start: v for v, starts in at.items() for start in starts}


def follow(version: int, block: dict[int, int]) -> int:
    """The version after a block that begins with ``version``."""
    end = block.get(version)
    if end is None:
        end = block[OTHER]
    return version if end == OTHER else end


def judged(kinds: list[str], expected: list[int | None], statuses: list[str | None], version: int) -> Iterator[tuple[str, int]]:
    """Outcome and version after each command of a case; of attach and detach, whether the case is there at all."""
    for kind, e, status in zip(kinds, expected, statuses, strict=True):
        outcome = "ok"
        if kind in ("create", "update") and status is not None and status not in STATES:
            outcome = "invalid_status"
        elif kind == "create":
            outcome, version = ("exists", version) if version else ("ok", 1)
        elif kind not in ("update", "delete", "comment", "attach", "detach"):
            outcome = "unknown"
        elif not version:
            outcome = "not_found"
        elif kind == "delete":
            version = 0
        elif kind == "update":
            outcome, version = ("ok", version + 1) if e == version else ("version_conflict", version)
        yield outcome, version


def _moves(kinds: pd.Series, expected: pd.Series, statuses: pd.Series) -> tuple[list[str], list[int | None]]:
    """Kinds and expected versions, without the commands whose status makes them void."""
    void = kinds.isin(["create", "update"]) & statuses.notna() & ~statuses.isin(STATES)
    return kinds.where(~void, "void").tolist(), [None if pd.isna(e) else int(e) for e in expected]


def _held(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcomes of attach and detach in order of detection and command; ``freed`` is when the case that attaches is deleted next."""
    detection, holder, freed = None, None, None
    for part in rows:
        out = []
        for d, command, case, kind, until in zip(part.detection_id, part.command_id, part.case_id, part.kind, part.freed, strict=True):
            if d != detection:
                detection, holder, freed = d, None, None
            if holder is not None and freed is not None and freed < command:
                holder = None
            if kind == "attach":
                outcome = "ok" if holder is None else "duplicate" if holder == case else "already_attached"
                if holder is None:
                    holder, freed = case, None if pd.isna(until) else until
            else:
                outcome = "ok" if holder == case else "not_attached"
                holder = None if holder == case else holder
            out.append((command, outcome))
        yield pd.DataFrame(out, columns=["command_id", "outcome"])


def outcomes(commands: DataFrame, block: int | None = None) -> DataFrame:
    """The commands with outcome and version (the case's, after it), one row each.

    Outcomes: ok, exists, not_found, version_conflict, invalid_status, unknown (kind), duplicate (attached to this case already),
    already_attached (to another), not_attached. Commands are tried in order of their id, which is unique. A null case is never
    found; a null kind is unknown; an update without an expected version is a conflict; a null status keeps the state, and is open at
    creation; a null detection is never attached. An empty table gives no rows.
    """
    spark, path = commands.sparkSession, work_path(commands.sparkSession, "cases")
    size = block or BLOCK
    plain = commands.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in _COLUMNS.split(", "))))
    rows = numbered(plain.where("case_id IS NOT NULL"), "case_id", "command_id", "k").withColumn("b", F.floor((F.col("k") - 1) / size))
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("command_id")
        found = block_map(*_moves(part.kind, part.expected, part.status))
        return pd.DataFrame({"case_id": part.case_id.iloc[:1], "b": part.b.iloc[:1], "starts": [list(found)], "ends": [list(found.values())]})

    maps = rows.groupBy("case_id", "b").applyInPandas(summed, "case_id string, b long, starts array<long>, ends array<long>")
    # One short row a block; a case's blocks are followed in order.
    listed = maps.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("b", "starts", "ends"))).alias("xs"))

    def begins(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in part:
            out = []
            for case, xs in zip(df["case_id"], df["xs"], strict=True):
                version = 0
                for x in xs:
                    out.append((case, x["b"], version))
                    version = follow(version, dict(zip(x["starts"], x["ends"], strict=True)))
            yield pd.DataFrame(out, columns=["case_id", "b", "begin"])

    first = listed.mapInPandas(begins, "case_id string, b long, begin long")

    def run(part: pa.Table, start: pa.Table) -> pa.Table:
        part = part.sort_by("command_id")
        told = list(judged(*(part[c].to_pylist() for c in ("kind", "expected", "status")), start["f_begin"][0].as_py())) if part.num_rows else []
        return pa.table([*(part[c] for c in _NAMES), pa.array([o for o, _ in told], pa.string()), pa.array([v for _, v in told], pa.int64())], [*_NAMES, "outcome", "version"])

    renamed = first.select(*(F.col(c).alias(f"f_{c}") for c in ("case_id", "b", "begin")))
    rows.groupBy("case_id", "b").cogroup(renamed.groupBy("f_case_id", "f_b")).applyInArrow(run, f"{_COLUMNS}, outcome string, version long").write.parquet(f"{path}/judged")
    tried = spark.read.parquet(f"{path}/judged")

    holds = F.col("kind").isin("attach", "detach") & (F.col("outcome") == "ok")
    gone = tried.where("kind = 'delete' AND outcome = 'ok'").select("case_id", "command_id", F.lit(True).alias("gone"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("detection_id"))
    asked = tried.where(holds & F.col("detection_id").isNotNull()).select("case_id", "command_id", F.lit(False).alias("gone"), "kind", "detection_id")
    after = Window.partitionBy("case_id").orderBy("command_id").rowsBetween(1, Window.unboundedFollowing)
    timed = gone.unionByName(asked).withColumn("freed", F.min(F.when(F.col("gone"), F.col("command_id"))).over(after)).where("NOT gone")
    ordered = timed.select("detection_id", "command_id", "case_id", "kind", "freed").repartition("detection_id").sortWithinPartitions("detection_id", "command_id")
    held = ordered.mapInPandas(_held, "command_id long, outcome string").select(F.col("command_id").alias("_id"), F.col("outcome").alias("_held"))
    both = tried.join(held, F.col("command_id") == F.col("_id"), "left")
    final = F.when(holds, F.coalesce("_held", F.lit("not_attached"))).otherwise(F.col("outcome"))
    nobody = plain.where("case_id IS NULL").withColumns({"outcome": F.lit("not_found"), "version": F.lit(0).cast("long")})
    return both.select(*_NAMES, final.alias("outcome"), "version").unionByName(nobody)


#: What every accepted command made of its case, and the cases that are left: over a table of outcomes; both engines run them.
EVENTS = """
WITH kept AS (SELECT *, count(CASE WHEN kind = 'create' THEN 1 END) OVER (PARTITION BY case_id ORDER BY command_id) AS life FROM {outcomes} WHERE outcome = 'ok'),
carried AS (
  SELECT command_id, case_id, kind, version, detection_id, coalesce(status, CASE WHEN kind = 'create' THEN 'open' END) AS status, assignee, life FROM kept),
told AS (
  SELECT *, max(CASE WHEN status IS NOT NULL AND kind IN ('create', 'update') THEN command_id END) OVER w AS s_at, max(CASE WHEN assignee IS NOT NULL AND kind IN ('create', 'update') THEN command_id END) OVER w AS a_at,
    max(CASE WHEN status IS NOT NULL AND kind IN ('create', 'update') THEN command_id END) OVER b AS s_before, max(CASE WHEN assignee IS NOT NULL AND kind IN ('create', 'update') THEN command_id END) OVER b AS a_before
  FROM carried WINDOW w AS (PARTITION BY case_id, life ORDER BY command_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY case_id, life ORDER BY command_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT t.command_id, t.case_id, t.version, t.life, t.detection_id, s.status AS status_after, nullif(a.assignee, '') AS assignee_after,
  CASE WHEN t.kind = 'create' THEN 'created' WHEN t.kind = 'delete' THEN 'deleted' WHEN t.kind = 'comment' THEN 'commented' WHEN t.kind = 'attach' THEN 'detection_attached' WHEN t.kind = 'detach' THEN 'detection_detached'
    WHEN t.status <> os.status THEN CASE WHEN os.status = 'closed' THEN 'reopened' ELSE 'state_changed' END WHEN t.assignee IS NOT NULL AND t.assignee <> coalesce(oa.assignee, '') THEN 'assigned' ELSE 'updated' END AS event
FROM told t LEFT JOIN carried s ON t.s_at = s.command_id LEFT JOIN carried a ON t.a_at = a.command_id LEFT JOIN carried os ON t.s_before = os.command_id LEFT JOIN carried oa ON t.a_before = oa.command_id"""
STATE = f"""
WITH events AS ({EVENTS}), last_ones AS (SELECT case_id, max(command_id) AS command_id, max(life) AS life FROM events GROUP BY case_id),
holds AS (SELECT case_id, count(*) AS n FROM (SELECT detection_id, <pick_max:case_id, command_id> AS case_id, <pick_max:event, command_id> AS event, <pick_max:life, command_id> AS life FROM events WHERE event IN ('detection_attached', 'detection_detached') GROUP BY detection_id) AS h
  WHERE event = 'detection_attached' AND EXISTS (SELECT 1 FROM last_ones l WHERE l.case_id = h.case_id AND l.life = h.life) GROUP BY case_id)
SELECT e.case_id, e.version, e.status_after AS status, e.assignee_after AS assignee, coalesce(h.n, 0) AS n_detections FROM events e JOIN last_ones l ON e.command_id = l.command_id LEFT JOIN holds h ON e.case_id = h.case_id WHERE e.event <> 'deleted'"""

#: A log of commands from the store's detections that aren't merely observed: an analyst's shifts of an hour by function, with stale versions, states that don't exist, and detections that several cases ask for.
COMMANDS = """
SELECT event_id AS command_id, concat(function_id, '/', CAST(t_us <div> 3600000000 AS <string>)) AS case_id,
  CASE WHEN event_id % 23 = 5 THEN 'delete' WHEN event_id % 5 = 0 THEN 'create' WHEN event_id % 5 IN (1, 2) THEN 'update' WHEN event_id % 5 = 3 THEN CASE WHEN event_id % 3 = 0 THEN 'detach' ELSE 'attach' END ELSE CASE WHEN event_id % 2 = 0 THEN 'comment' ELSE 'attach' END END AS kind,
  1 + event_id % 3 AS expected, CASE WHEN event_id % 29 = 1 THEN 'lost' WHEN event_id % 7 = 0 THEN 'closed' WHEN event_id % 4 = 0 THEN 'triage' WHEN event_id % 4 = 1 THEN 'contained' WHEN event_id % 4 = 2 THEN 'open' END AS status,
  CASE WHEN event_id % 6 = 1 THEN concat('analyst-', CAST(event_id % 4 AS <string>)) WHEN event_id % 6 = 2 THEN '' END AS assignee, event_id - event_id % 40 AS detection_id
FROM {rows} WHERE decision <> 'observe'"""


def outcomes_sql(commands: str) -> str:
    """The same, command by command: a recursion along each case, then one along each detection."""
    valid = "(r.status IS NULL OR r.status IN ('open', 'triage', 'contained', 'closed'))"
    step = (
        f"CASE WHEN r.kind IN ('create', 'update') AND NOT {valid} THEN 'invalid_status' WHEN r.kind = 'create' THEN CASE WHEN {{v}} > 0 THEN 'exists' ELSE 'ok' END WHEN {{v}} = 0 THEN 'not_found' "
        f"WHEN r.kind = 'update' AND r.expected <> {{v}} THEN 'version_conflict' ELSE 'ok' END"
    )
    version = f"CASE WHEN r.kind IN ('create', 'update') AND NOT {valid} THEN {{v}} WHEN r.kind = 'create' AND {{v}} = 0 THEN 1 WHEN r.kind = 'delete' THEN 0 WHEN r.kind = 'update' AND {{v}} > 0 AND r.expected = {{v}} THEN {{v}} + 1 ELSE {{v}} END"
    hold = "CASE WHEN {h} IS NOT NULL AND coalesce({f} < r.command_id, false) THEN NULL ELSE {h} END"
    names = ", ".join(f"r.{c}" for c in _NAMES)

    def taken(h: str, f: str) -> tuple[str, str, str]:
        now = hold.format(h=h, f=f)
        outcome = f"CASE WHEN r.kind = 'attach' THEN CASE WHEN ({now}) IS NULL THEN 'ok' WHEN ({now}) = r.case_id THEN 'duplicate' ELSE 'already_attached' END WHEN ({now}) = r.case_id THEN 'ok' ELSE 'not_attached' END"
        holder = f"CASE WHEN r.kind = 'attach' THEN coalesce({now}, r.case_id) WHEN ({now}) = r.case_id THEN NULL ELSE {now} END"
        return outcome, holder, f"CASE WHEN r.kind = 'attach' AND ({now}) IS NULL THEN r.freed ELSE {f} END"

    o0, h0, f0 = taken("CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)")
    o1, h1, f1 = taken("p.holder", "p.held_until")
    return f"""WITH RECURSIVE log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY command_id) AS k FROM ({commands})),
tried AS (
  SELECT {names}, r.k, {step.format(v='0')} AS outcome, CAST({version.format(v='0')} AS BIGINT) AS version FROM log r WHERE k = 1
  UNION ALL SELECT {names}, r.k, {step.format(v='t.version')}, {version.format(v='t.version')} FROM tried t JOIN log r ON r.case_id = t.case_id AND r.k = t.k + 1),
asked AS MATERIALIZED (
  SELECT a.*, row_number() OVER (PARTITION BY detection_id ORDER BY command_id) AS j, (SELECT min(d.command_id) FROM tried d WHERE d.case_id = a.case_id AND d.kind = 'delete' AND d.outcome = 'ok' AND d.command_id > a.command_id) AS freed
  FROM tried a WHERE kind IN ('attach', 'detach') AND outcome = 'ok'),
held AS (
  SELECT r.command_id, r.detection_id, r.j, {o0} AS outcome, {h0} AS holder, {f0} AS held_until FROM asked r WHERE j = 1
  UNION ALL SELECT r.command_id, r.detection_id, r.j, {o1}, {h1}, {f1} FROM held p JOIN asked r ON r.detection_id = p.detection_id AND r.j = p.j + 1)
SELECT {', '.join(f't.{c}' for c in _NAMES)}, coalesce(h.outcome, t.outcome) AS outcome, t.version FROM tried t LEFT JOIN held h ON t.command_id = h.command_id"""
