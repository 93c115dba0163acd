"""Attack paths: what led to each failure, walked back along causes, and what that says of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.functions.dialect import DUCKDB, SPARK, fill
from skytally.operators.graph import _REACH, CAUSAL, STRENGTHS, strengths
from skytally.sources.shared import work_path

#: A walk takes no further step once its path has more nodes than this. Fixed value.
BUDGET = 20
#: What a record is in an attack: failures are security events, ends of work call external services, beginnings take input in.
NODES = "SELECT event_id, t_us, truth, CASE WHEN truth THEN 'security_event' WHEN phase = 'shutdown' THEN 'external_service' WHEN phase = 'init' THEN 'data_input' ELSE 'function_call' END AS kind FROM {rows}"
_FOUND = "PARTITION BY v.target ORDER BY v.level, n.t_us, v.node"
#: By failure: its path, ordered from the node found last, the edges between neighbours on it, and what they amount to. Kinds, weights and thresholds.
PATHS = f"""
WITH placed AS (SELECT v.target, v.node, v.level, n.t_us, n.kind, lag(v.node) OVER ({_FOUND}) AS after_node, row_number() OVER ({_FOUND}) AS place FROM {{visited}} v JOIN {{nodes}} n ON v.node = n.event_id),
linked AS (SELECT p.*, e.strength FROM placed p LEFT JOIN {{edges}} e ON e.source = p.node AND e.target = p.after_node),
counted AS (
  SELECT target, count(*) AS n_nodes, count(strength) AS n_edges, max(level) AS depth, <pick_max:node, place> AS entry, min(t_us) AS first_us, round((max(t_us) - min(t_us)) / 1e6, 3) AS seconds,
    CAST(sum(CASE WHEN kind = 'security_event' THEN 1 ELSE 0 END) AS BIGINT) AS n_security, CAST(sum(CASE WHEN kind = 'external_service' THEN 1 ELSE 0 END) AS BIGINT) AS n_external,
    CAST(sum(CASE WHEN kind IN ('external_service', 'data_input') THEN 1 ELSE 0 END) AS BIGINT) AS n_mitigation, sum(CASE WHEN strength > 0.7 THEN 1e0 ELSE 0e0 END) AS n_strong, avg(least(0.9, strength * 2.0)) AS sure
  FROM linked GROUP BY target)
SELECT target, n_nodes, n_edges, depth, entry, first_us, seconds, n_security, n_external, n_mitigation,
  CASE WHEN n_security >= 2 THEN 'multi_stage' WHEN n_external >= 1 AND n_nodes >= 3 THEN 'external_infiltration' WHEN n_nodes >= 5 THEN 'complex_chain' ELSE 'simple' END AS kind,
  round(least(1.0, least(0.3, n_nodes / 10e0) + least(0.4, 0.2 * n_security) + CASE WHEN n_edges > 0 THEN least(0.3, n_strong / n_edges) ELSE 0.0 END) + 1e-10, 4) AS severity, round(coalesce(sure, 0.0) + 1e-10, 4) AS confidence
FROM counted"""


def _farthest(share: float) -> int:
    """Microseconds between cause and effect at most for a strength of .3, with ``share`` of what errors add; the strength falls with the time."""
    low, high = 0, CAUSAL
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if 0.3 * (1.0 - mid / 3e8) + 0.12 + 0.1 * share >= 0.3 else (low, mid - 1)
    return low


def _first_steps() -> str:
    """By failure with more causes than its walk may go on from: what ``PATHS`` counts of it, from counts along the time; by any other failure, only that.

    The causes of a record are its function's odd records and its others of so many microseconds before it, so there are as many as up to it less
    those up to the span's start, the last one is the last of all, and the first one is what follows the last one before the span. Of the edges between
    neighbours on such a path there is that of the first cause alone, since causes follow each other by time.
    """
    spans = {"both": ("odd", _farthest(0.7)), "odd": ("odd", _farthest(0.3)), "other": ("NOT odd", _farthest(0.0))}
    kinds = {"n": "true", "security": "kind = 'security_event'", "external": "kind = 'external_service'", "mitigation": "kind IN ('external_service', 'data_input')"}
    upto = lambda end: f"OVER (PARTITION BY function_id ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND {end} PRECEDING)"
    at, columns, chosen = "named_struct('t_us', t_us, 'event_id', event_id)", [], []
    for span, (sort, far) in spans.items():
        columns += [f"count(CASE WHEN {sort} AND {k} THEN 1 END) {upto(1)} - count(CASE WHEN {sort} AND {k} THEN 1 END) {upto(far + 1)} AS {span}_{name}" for name, k in kinds.items()]
        columns += [
            f"max(CASE WHEN {sort} THEN {at} END) {upto(1)} AS {span}_last",
            f"coalesce(max(CASE WHEN {sort} THEN named_struct('t_us', t_us, 'event_id', event_id, 'after', after_{'odd' if sort == 'odd' else 'other'}) END) {upto(far + 1)}.after, min(CASE WHEN {sort} THEN {at} END) {upto(1)}) AS {span}_first",
        ]
    after = "OVER (PARTITION BY function_id ORDER BY t_us DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    mine = lambda x: f"CASE WHEN odd THEN both_{x} ELSE odd_{x} END"
    chosen = [f"{mine(name)} + other_{name} AS {name}" for name in kinds]
    chosen += [f"CASE WHEN {mine('n')} > 0 THEN {mine(end)} END AS odd_{end}_one, CASE WHEN other_n > 0 THEN other_{end} END AS other_{end}_one" for end in ("first", "last")]
    return f"""
WITH placed AS (SELECT n.event_id, n.t_us, n.truth, n.kind, n.function_id, n.odd, last_value(CASE WHEN odd THEN {at} END) IGNORE NULLS {after} AS after_odd, last_value(CASE WHEN NOT odd THEN {at} END) IGNORE NULLS {after} AS after_other
  FROM {{nodes}} n WHERE function_id IS NOT NULL AND t_us IS NOT NULL),
counted AS (SELECT event_id, t_us, truth, odd, {", ".join(columns)} FROM placed),
chosen AS (SELECT event_id, t_us, odd, {", ".join(chosen)} FROM counted WHERE truth),
ends AS (SELECT *, least(odd_first_one, other_first_one) AS first_one, greatest(odd_last_one, other_last_one) AS last_one FROM chosen),
weighed AS (SELECT *, round(0.3 * (1.0 - (t_us - first_one.t_us) / 3e8) + 0.12 + 0.1 * CASE WHEN first_one = odd_first_one THEN CASE WHEN odd THEN 0.7 ELSE 0.3 END ELSE 0.0 END + 1e-10, 4) AS strength FROM ends)
SELECT event_id AS target, n + 1 AS n_nodes, 1 AS n_edges, 1 AS depth, last_one.event_id AS entry, first_one.t_us AS first_us, round((t_us - first_one.t_us) / 1e6, 3) AS seconds,
  security + 1 AS n_security, external AS n_external, mitigation AS n_mitigation, CASE WHEN strength > 0.7 THEN 1e0 ELSE 0e0 END AS n_strong, (0.9 * n + least(0.9, strength * 2.0)) / (n + 1) AS sure
FROM weighed WHERE n + 1 > {{budget}}"""


#: Causes of some records alone: these are dealt to the slots that their causes may lie in.
_INTO = f"""
WITH placed AS (SELECT event_id, function_id, t_us, phase, anomaly_type, t_us <div> {_REACH // 2} AS slot FROM {{rows}}),
reach AS (SELECT p.*, <explode:<sequence:slot - 2, slot>> AS meets FROM placed p LEFT SEMI JOIN {{wanted}} w ON p.event_id = w.node)
{STRENGTHS[STRENGTHS.index("SELECT source, target, function_id"):].replace("FROM reach a JOIN placed b", "FROM placed a JOIN reach b").replace("a.meets = b.slot", "a.slot = b.meets").replace(f"b.t_us - a.t_us <= {CAUSAL}", f"b.t_us - a.t_us <= {_REACH}")}"""


def walked(edges: DataFrame | Callable[[DataFrame], DataFrame], targets: DataFrame, path: str, budget: int = BUDGET) -> DataFrame:
    """target, node and level of all nodes found walking back from each target along ``edges`` (source, target), or along those that it gives into a table of nodes.

    Breadth first, all targets at once: a step joins the nodes found last with the edges into them and leaves out what their target
    has seen. A target takes no further step once it has more than ``budget`` nodes. Every step is written under ``path``.
    """
    spark = targets.sparkSession
    targets.select("target", F.col("target").alias("node"), F.lit(0).alias("level")).distinct().write.parquet(f"{path}/level=0")
    schema, level = "target long, node long, level int", 0
    read = lambda *levels: spark.read.schema(schema).parquet(*(f"{path}/level={k}" for k in levels))
    while not read(level).isEmpty():
        seen = read(*range(level + 1)).select("target", "node")
        open_ones = seen.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") <= budget).select("target")
        last = read(level).select("target", "node").join(open_ones, "target")
        into = edges(last.select("node").distinct()) if callable(edges) else edges
        found = last.join(into.select(F.col("target").alias("node"), F.col("source").alias("cause")), "node").select("target", F.col("cause").alias("node")).distinct()
        level += 1
        found.join(seen, ["target", "node"], "left_anti").select("target", "node", F.lit(level).alias("level")).write.parquet(f"{path}/level={level}")
    return read(*range(level + 1))


def attack_paths(telemetry: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row for every failure: its path's size, depth, entry, span, kinds of nodes, type, severity, confidence and points of mitigation.

    A failure with at least ``budget`` causes ends its walk with the first step, which is counted along the time without pairs; the others walk
    along the edges into the nodes found last, so no edges but those on paths are made. Ids that repeat, which name several records, need all edges.
    """
    spark, path = telemetry.sparkSession, work_path(telemetry.sparkSession, "attacks")
    spark.sql(NODES.replace(" AS kind", " AS kind, function_id, coalesce(anomaly_type <> 'benign', false) AS odd"), rows=telemetry).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    targets = nodes.where("truth").select(F.col("event_id").alias("target"))
    if not nodes.groupBy("event_id").count().where("count > 1").isEmpty():
        strengths(telemetry).select("source", "target", "strength").write.parquet(f"{path}/edges")
        edges = spark.read.parquet(f"{path}/edges")
        return spark.sql(fill(PATHS, SPARK), visited=walked(edges, targets, f"{path}/walk", budget), nodes=nodes, edges=edges)
    spark.sql(fill(_first_steps().replace("{budget}", str(budget)), SPARK), nodes=nodes).write.parquet(f"{path}/ended")
    ended = spark.read.parquet(f"{path}/ended")
    known: list[str] = []

    def into(wanted: DataFrame) -> DataFrame:
        before = spark.read.parquet(*(f"{p}/nodes" for p in known)) if known else None
        own = f"{path}/into={len(known)}"
        (wanted.join(before, "node", "left_anti") if known else wanted).write.parquet(f"{own}/nodes")
        spark.sql(fill(_INTO, SPARK), rows=telemetry, wanted=spark.read.parquet(f"{own}/nodes")).select("source", "target", "strength").write.parquet(f"{own}/edges")
        known.append(own)
        return spark.read.parquet(*(f"{p}/edges" for p in known))

    visited = walked(into, targets.join(ended, "target", "left_anti"), f"{path}/walk", budget)
    edges = spark.read.schema("source long, target long, strength double").parquet(*(f"{p}/edges" for p in known)) if known else spark.createDataFrame([], "source long, target long, strength double")
    return spark.sql(fill(PATHS.replace("GROUP BY target)", "GROUP BY target UNION ALL SELECT * FROM {ended})"), SPARK), visited=visited, nodes=nodes, edges=edges, ended=ended)


def oracle(view: str, budget: int = BUDGET) -> str:
    """The walk step by step: each finds a node at least, so no walk takes more than ``budget`` steps before it ends."""
    parts = [
        f"edges AS MATERIALIZED (SELECT source, target, strength FROM ({fill(STRENGTHS, DUCKDB).format(rows=view)}) AS s)", f"nodes AS MATERIALIZED ({NODES.format(rows=view)})",
        "seen0 AS MATERIALIZED (SELECT event_id AS target, event_id AS node, 0 AS level FROM nodes WHERE truth)",
    ]
    for k in range(budget + 1):
        small = f"(SELECT target FROM seen{k} GROUP BY target HAVING count(*) <= {budget})"
        new = f"SELECT DISTINCT s.target, e.source AS node, {k + 1} AS level FROM seen{k} s JOIN edges e ON e.target = s.node WHERE s.level = {k} AND s.target IN {small}"
        parts.append(f"seen{k + 1} AS MATERIALIZED (SELECT * FROM seen{k} UNION ALL SELECT n.* FROM ({new}) AS n ANTI JOIN seen{k} o ON n.target = o.target AND n.node = o.node)")
    return f"WITH {', '.join(parts)}{fill(PATHS, DUCKDB).format(visited=f'seen{budget + 1}', nodes='nodes', edges='edges').strip().replace('WITH ', ', ', 1)}"
