"""Execution graph: edges between records close in time, and centralities by joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.functions.dialect import DUCKDB, SPARK, fill
from skytally.operators import density, neighbours
from skytally.sources.shared import work_path

def edges_within(seconds: int = 20) -> str:
    """Pairs of records of different functions at most so many seconds apart: an equi-join on time buckets (own and next) with the exact condition left over."""
    return _EDGES.replace("20000000", str(seconds * 1_000_000))


_EDGES = """
WITH bucketed AS (SELECT event_id, function_id, t_us, phase, anomaly_type, truth, t_us <div> 20000000 AS bucket FROM {rows}),
both_buckets AS (SELECT event_id, function_id, t_us, phase, truth, bucket AS slot FROM bucketed UNION ALL SELECT event_id, function_id, t_us, phase, truth, bucket + 1 AS slot FROM bucketed)
SELECT a.event_id AS source, b.event_id AS target, round(0.4 * (1.0 - (b.t_us - a.t_us) / 20000000.0) + 0.25 * CASE WHEN a.phase = b.phase THEN 1.0 ELSE 0.0 END + 0.35 * CASE WHEN a.truth AND b.truth THEN 1.0 ELSE 0.0 END, 4) AS strength
FROM both_buckets a JOIN bucketed b ON a.slot = b.bucket AND a.t_us < b.t_us AND b.t_us - a.t_us <= 20000000 AND a.function_id <> b.function_id
WHERE 0.4 * (1.0 - (b.t_us - a.t_us) / 20000000.0) + 0.25 * CASE WHEN a.phase = b.phase THEN 1.0 ELSE 0.0 END + 0.35 * CASE WHEN a.truth AND b.truth THEN 1.0 ELSE 0.0 END > 0.5"""

EDGES = edges_within()

#: Degrees, strength and anomaly centrality (own score and the mean of the successors) of the records with edges out.
CENTRALITY = f"""
WITH edges AS ({EDGES}), own AS (SELECT event_id, 0.5 * CASE WHEN anomaly_type <> 'benign' THEN 1 ELSE 0 END + 0.2 * CASE WHEN duration > 5 THEN 1 ELSE 0 END + 0.2 * CASE WHEN memory > 100000 THEN 1 ELSE 0 END + 0.1 * CASE WHEN cpu > 80 THEN 1 ELSE 0 END AS score FROM {{rows}})
SELECT source AS event_id, count(*) AS out_degree, round(sum(strength), 4) AS out_strength, round(0.7 * max(a.score) + 0.3 * avg(b.score), 4) AS anomaly_centrality
FROM edges JOIN own a ON source = a.event_id JOIN own b ON target = b.event_id GROUP BY source"""

_OWN = "0.5 * CASE WHEN anomaly_type <> 'benign' THEN 1 ELSE 0 END + 0.2 * CASE WHEN duration > 5 THEN 1 ELSE 0 END + 0.2 * CASE WHEN memory > 100000 THEN 1 ELSE 0 END + 0.1 * CASE WHEN cpu > 80 THEN 1 ELSE 0 END"


def _linked(telemetry: DataFrame, seconds: int, made, schema: str, more: str = "") -> DataFrame:
    """What ``made`` makes of the edges: places of both records among those held, and strength.

    Only pairs that can pass .5 are met, which are failures, or records of one phase in the first three eighths of the span. ``more`` are columns over the records.
    """
    span = seconds * 1_000_000

    def edges_of(r: neighbours.Columns, a: np.ndarray, b: np.ndarray, dt: np.ndarray, failures: bool) -> tuple:
        both = r["truth"][a] & r["truth"][b]
        strength = 0.4 * (1.0 - dt / span) + 0.25 * neighbours.alike(r, "phase", a, b) + 0.35 * both
        kept = np.flatnonzero((strength > 0.5) & (both == failures) & (r["function_id"][a] != r["function_id"][b]))
        return r, a[kept], b[kept], neighbours.to_places(strength[kept])

    rows = run(f"SELECT event_id, function_id, t_us, phase, truth{more} FROM {{rows}} WHERE function_id IS NOT NULL", telemetry)
    failed = neighbours.pairs(rows.where("truth"), span, lambda r, a, b, dt, words: made(*edges_of(r, a, b, dt, True)), schema)
    return failed.unionByName(neighbours.pairs(rows, seconds * 375_000 + 1, lambda r, a, b, dt, words: made(*edges_of(r, a, b, dt, False)), schema, by=["phase"]))


def _summed(r: neighbours.Columns, a: np.ndarray, b: np.ndarray, strength: np.ndarray) -> list:
    """A row for each record that edges leave: their number, strength in ten thousandths, and their ends' scores in tenths."""
    first = np.flatnonzero(np.append(len(a) > 0, a[1:] != a[:-1]))
    total = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
    return [r["event_id"][a[first]], r["score"][a[first]], total(np.ones(len(a), np.int64)), total(np.rint(strength * 1e4).astype(np.int64)), total(r["tenths"][b])]


def centrality(telemetry: DataFrame) -> DataFrame:
    """``CENTRALITY`` with both records' scores beside them, so that edges are summed up where they are found; sums are of whole numbers."""
    parts = _linked(telemetry, 20, _summed, "event_id long, score double, n long, strength long, after long", more=f", {_OWN} AS score, CAST(round(10 * ({_OWN})) AS BIGINT) AS tenths")
    return run(f"SELECT event_id, sum(n) AS out_degree, sum(strength) / 10000.0 AS out_strength, {_PLACES('0.7 * max(score) + 0.3 * (sum(after) / 10.0 / sum(n))')} AS anomaly_centrality FROM {{rows}} GROUP BY event_id", parts)


#: Previous record of the same function (as of), and of an error in any phase before it.
AS_OF = """
SELECT event_id, function_id, lag(event_id) OVER (PARTITION BY function_id ORDER BY event_id) AS previous_id, (t_us - lag(t_us) OVER (PARTITION BY function_id ORDER BY event_id)) / 1e6 AS inter_arrival,
  max(CASE WHEN truth THEN event_id END) OVER (PARTITION BY function_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error_id
FROM {rows}"""

#: Function transitions: how often one function's record follows another's in arrival order, with lift.
TRANSITIONS = """
WITH steps AS (SELECT function_id AS source, lead(function_id) OVER (PARTITION BY t_us <div> 3600000000 ORDER BY event_id) AS target FROM {rows}),
counts AS (SELECT source, target, count(*) AS n FROM steps WHERE target IS NOT NULL GROUP BY source, target)
SELECT source, target, n, round(n * 1e0 / sum(n) OVER (PARTITION BY source), 4) AS share, round(n * 1e0 * sum(n) OVER () / (sum(n) OVER (PARTITION BY source) * sum(n) OVER (PARTITION BY target)), 4) AS lift FROM counts"""


def run(text: str, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(fill(text, SPARK), rows=rows)


def edges(telemetry: DataFrame, seconds: int = 20) -> DataFrame:
    return _linked(telemetry, seconds, lambda r, a, b, strength: [r["event_id"][a], r["event_id"][b], strength], "source long, target long, strength double")


def pagerank(links: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """node and rank from weighted links (source, target, n), by iterated joins; nodes without links out spread nothing."""
    nodes = links.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    total = nodes.agg(F.count("*").alias("total"))
    out = links.groupBy("source").agg(F.sum("n").alias("out"))
    shares = links.join(out, "source").select("source", "target", (F.col("n") / F.col("out")).alias("share"))
    base = nodes.join(F.broadcast(total))
    ranks = base.select("node", (1 / F.col("total")).alias("rank"))
    for _ in range(rounds):
        came = shares.join(ranks, F.col("source") == F.col("node")).groupBy("target").agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        ranks = base.join(came, F.col("node") == F.col("target"), "left").select("node", ((1 - damping) / F.col("total") + damping * F.coalesce("came", F.lit(0.0))).alias("rank"))
    return ranks.select("node", F.round("rank", 6).alias("rank"))


def pagerank_sql(links: str, rounds: int = 5, damping: float = 0.85) -> str:
    parts = [f"links AS ({links})", "nodes AS (SELECT source AS node FROM links UNION SELECT target FROM links)", "shares AS (SELECT source, target, n * 1e0 / sum(n) OVER (PARTITION BY source) AS share FROM links)", "r0 AS (SELECT node, 1e0 / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS (SELECT node, {1 - damping} / (SELECT count(*) FROM nodes) + {damping} * coalesce((SELECT sum(share * rank) FROM shares JOIN r{k} p ON source = p.node WHERE target = nodes.node), 0) AS rank FROM nodes)")
    return f"WITH {', '.join(parts)} SELECT node, round(rank, 6) AS rank FROM r{rounds}"


def oracle(text: str, view: str) -> str:
    return fill(text, DUCKDB).format(rows=f"({view}) AS telemetry")


_SLOTTED = """
WITH placed AS (SELECT *, t_us <div> {span} AS slot, row_number() OVER (PARTITION BY function_id ORDER BY event_id) AS n, (t_us - lag(t_us) OVER (PARTITION BY function_id ORDER BY event_id)) / 1e6 AS gap FROM {rows}),
reach AS (SELECT *, slot AS meets FROM placed UNION ALL SELECT *, slot + 1 AS meets FROM placed)"""
_PAIRED = "FROM reach a JOIN placed b ON a.function_id = b.function_id AND a.meets = b.slot AND b.t_us > a.t_us AND b.t_us - a.t_us <= {span}"
#: Microseconds between cause and effect, and between records that correlate, at most. Fixed values.
CAUSAL, CORRELATED = 300_000_000, 600_000_000
_within = lambda text, span: text.replace("{span}", str(span))
_ODD = "{x}.anomaly_type <> 'benign'"
#: Causes and effects: records of one function at most five minutes apart, an equi-join on function and time slot. Strength: nearness in time .3, the function's own tie .15 x .8, and .1 for errors that go on (.7) or end (.3); 0.3 at least. Pairs grow with the square of a function's rate, as the relation itself does. Fixed values.
STRENGTHS = f"""{_within(_SLOTTED, CAUSAL)}
SELECT source, target, function_id, t_us, round(strength + 1e-10, 4) AS strength, kind FROM (
  SELECT a.event_id AS source, b.event_id AS target, a.function_id, b.t_us, 0.3 * (1.0 - (b.t_us - a.t_us) / 3e8) + 0.12 + 0.1 * CASE WHEN {_ODD.format(x="a")} AND {_ODD.format(x="b")} THEN 0.7 WHEN {_ODD.format(x="a")} THEN 0.3 ELSE 0.0 END AS strength,
    CASE WHEN {_ODD.format(x="a")} AND {_ODD.format(x="b")} THEN 'error_propagation' WHEN a.phase = b.phase THEN 'same_phase' ELSE 'temporal' END AS kind {_within(_PAIRED, CAUSAL)}
) AS weighed WHERE strength >= 0.3"""

_NEAR = lambda x, scale: f"1.0 / (1.0 + abs(a.{x} - b.{x}) / {scale})"
#: Edges of a function's records within ten minutes: temporal, semantic, behavioural and causal correlation, the kinds that pass their thresholds, and the edge's confidence (more where several are strong). Fixed values.
#: Of one function's records the names are alike, so semantic correlation is .8, and .1 more each for equal payloads and outcomes.
CORRELATIONS = f"""{_within(_SLOTTED, CORRELATED)}
SELECT source, target, round(temporal + 1e-10, 4) AS temporal, round(semantic + 1e-10, 4) AS semantic, round(behavioural + 1e-10, 4) AS behavioural, round(causal + 1e-10, 4) AS causal, concat_ws(',', CASE WHEN temporal >= 0.2 THEN 'temporal' END, CASE WHEN semantic >= 0.3 THEN 'semantic' END, CASE WHEN behavioural >= 0.25 THEN 'behavioural' END, CASE WHEN causal >= 0.15 THEN 'causal' END) AS kinds,
  round(least(1.0, (temporal + semantic + behavioural + causal) / 4.0 * CASE WHEN strong >= 2 THEN 1.2 WHEN strong = 1 AND fair >= 2 THEN 1.1 ELSE 1.0 END) + 1e-10, 4) AS confidence
FROM (SELECT *, CASE WHEN temporal > 0.7 THEN 1 ELSE 0 END + CASE WHEN semantic > 0.7 THEN 1 ELSE 0 END + CASE WHEN behavioural > 0.7 THEN 1 ELSE 0 END + CASE WHEN causal > 0.7 THEN 1 ELSE 0 END AS strong, CASE WHEN temporal BETWEEN 0.4 AND 0.7 THEN 1 ELSE 0 END + CASE WHEN behavioural BETWEEN 0.4 AND 0.7 THEN 1 ELSE 0 END + CASE WHEN causal BETWEEN 0.4 AND 0.7 THEN 1 ELSE 0 END AS fair FROM (
  SELECT a.event_id AS source, b.event_id AS target,
    0.4 * (1.0 - (b.t_us - a.t_us) / 6e8) + 0.25 * CASE WHEN a.phase = b.phase THEN 1.0 ELSE 0.0 END + 0.2 * CASE WHEN coalesce(a.gap, 0) <= 0 OR coalesce(b.gap, 0) <= 0 THEN 0.5 ELSE least(a.gap, b.gap) / greatest(a.gap, b.gap) END + 0.15 / (1.0 + abs(a.n - b.n)) AS temporal,
    0.8 + 0.1 * CASE WHEN a.memory = b.memory THEN 1.0 ELSE 0.0 END + 0.1 * CASE WHEN a.anomaly_type = b.anomaly_type THEN 1.0 ELSE 0.0 END AS semantic,
    0.2 * {_NEAR("duration", "1.0")} + 0.2 * {_NEAR("memory", "10000.0")} + 0.15 * {_NEAR("cpu", "100.0")} + 0.1 * {_NEAR("network", "10000.0")} + 0.15 * CASE WHEN a.phase = b.phase THEN 1.0 ELSE 0.5 END + 0.1 * CASE WHEN a.anomaly_type = b.anomaly_type THEN 1.0 ELSE 0.0 END AS behavioural,
    least(1.0, exp(-(b.t_us - a.t_us) / 6e7) * CASE WHEN a.memory > 50000 OR a.cpu > 80 THEN 1.5 ELSE 1.0 END * CASE WHEN {_ODD.format(x="a")} AND {_ODD.format(x="b")} THEN 1.3 ELSE 1.0 END) AS causal {_within(_PAIRED, CORRELATED)}
) AS correlated) AS counted"""

#: Four places, halves up, of a number that isn't negative: rounding a double in Spark goes by its decimal text, which takes longer than all else of a pair.
_PLACES = lambda x: f"floor(({x}) * 10000.0 + 0.5) / 10000.0"
#: The same of a number that is moved off the halves.
_MOVED = lambda x: f"rint(({x} + 1e-10) * 10000.0) / 10000.0"


def _passed(kinds: dict[str, str], found: tuple[str, ...] = ()) -> str:
    """The names of the conditions that hold, as one of all texts there can be."""
    if not kinds:
        return f"'{','.join(found)}'"
    (name, holds), more = next(iter(kinds.items())), dict(list(kinds.items())[1:])
    return f"CASE WHEN {holds} THEN {_passed(more, (*found, name))} ELSE {_passed(more, found)} END"


def _correlations_joined() -> str:
    """``CORRELATIONS`` for Spark: slots of half the span, what a record has alone computed once, and neither texts nor decimals made for a pair."""
    head, tail = CORRELATIONS.index("FROM (SELECT *, CASE WHEN temporal"), CORRELATIONS.index("FROM reach a JOIN")
    body = CORRELATIONS[head:tail].replace("coalesce(a.gap, 0)", "a.gap").replace("coalesce(b.gap, 0)", "b.gap").replace("CASE WHEN a.memory > 50000 OR a.cpu > 80 THEN 1.5 ELSE 1.0 END", "a.boost")
    body = body.replace(f"{_ODD.format(x='a')} AND {_ODD.format(x='b')}", "a.odd AND b.odd")
    confidence = "least(1.0, (temporal + semantic + behavioural + causal) / 4.0 * CASE WHEN strong >= 2 THEN 1.2 WHEN strong = 1 AND fair >= 2 THEN 1.1 ELSE 1.0 END)"
    kinds = _passed({"temporal": "temporal >= 0.2", "semantic": "semantic >= 0.3", "behavioural": "behavioural >= 0.25", "causal": "causal >= 0.15"})
    return f"""
WITH placed AS (SELECT event_id, function_id, t_us, phase, anomaly_type, duration, memory, cpu, network, {_ODD.format(x="telemetry")} AS odd, CASE WHEN memory > 50000 OR cpu > 80 THEN 1.5 ELSE 1.0 END AS boost, t_us <div> {CORRELATED // 2} AS slot,
  row_number() OVER (PARTITION BY function_id ORDER BY event_id) AS n, coalesce((t_us - lag(t_us) OVER (PARTITION BY function_id ORDER BY event_id)) / 1e6, 0.0) AS gap FROM {{rows}} AS telemetry),
reach AS (SELECT *, <explode:<sequence:slot, slot + 2>> AS meets FROM placed)
SELECT source, target, {", ".join(f"{_MOVED(x)} AS {x}" for x in ("temporal", "semantic", "behavioural", "causal"))}, {kinds} AS kinds, {_MOVED(confidence)} AS confidence
{body}{CORRELATIONS[tail:]}"""


_CORRELATIONS_JOINED = _correlations_joined()


def correlations(telemetry: DataFrame) -> DataFrame:
    """Edges as in ``CORRELATIONS``."""
    return run(_CORRELATIONS_JOINED, telemetry)


#: Records, causal edges and density of each function's graph.
DENSITY = f"""
SELECT n.function_id, n.n, coalesce(m, 0) AS m, round(coalesce(m, 0) * 1e0 / (n.n * (n.n - 1e0)), 8) AS density FROM (SELECT function_id, count(*) AS n FROM {{rows}} GROUP BY function_id) AS n
LEFT JOIN (SELECT function_id, count(*) AS m FROM ({STRENGTHS}) AS s GROUP BY function_id) AS e ON n.function_id = e.function_id"""

#: Effects reach .3 only within so many microseconds (.4 of the span, .63 where errors go on), so Spark joins no others, in slots of half as much.
_REACH = 190_000_002
_JOINED = f"""
WITH placed AS (SELECT event_id, function_id, t_us, phase, anomaly_type, t_us <div> {_REACH // 2} AS slot FROM {{rows}}), reach AS (SELECT *, <explode:<sequence:slot, slot + 2>> AS meets FROM placed)
{STRENGTHS[STRENGTHS.index("SELECT source, target, function_id"):].replace(f"b.t_us - a.t_us <= {CAUSAL}", f"b.t_us - a.t_us <= {_REACH}")}"""


_SORTS = pa.array(["error_propagation", "same_phase", "temporal"])


def _weighed(r: neighbours.Columns, a: np.ndarray, b: np.ndarray, dt: np.ndarray, words: pa.Array) -> list:
    odd, both = r["odd"][a], r["odd"][a] & r["odd"][b]
    strength = 0.3 * (1.0 - dt / 3e8) + 0.12 + 0.1 * np.where(both, 0.7, np.where(odd, 0.3, 0.0))
    kept = np.flatnonzero(strength >= 0.3)
    a, b, both = a[kept], b[kept], both[kept]
    sort = np.where(both, 0, np.where(neighbours.alike(r, "phase", a, b), 1, 2))
    return [r["event_id"][a], r["event_id"][b], neighbours.texts(r["function_id"][a], words), r["t_us"][b], neighbours.to_places(strength[kept] + 1e-10), neighbours.texts(sort, _SORTS)]


def strengths(telemetry: DataFrame) -> DataFrame:
    """Causes and effects as in ``STRENGTHS``."""
    rows = run("SELECT event_id, function_id, t_us, phase, coalesce(anomaly_type <> 'benign', false) AS odd FROM {rows}", telemetry)
    return neighbours.pairs(rows, _REACH, _weighed, "source long, target long, function_id string, t_us long, strength double, kind string", by=["function_id"])


def density_of(telemetry: DataFrame) -> DataFrame:
    """Records, causal edges and density of each function's graph as in ``DENSITY``."""
    return run(DENSITY.replace(STRENGTHS, _JOINED), telemetry)


#: Each record's strongest effect, the earliest of several.
SUCCESSORS = f"SELECT source, target, strength FROM (SELECT source, target, strength, row_number() OVER (PARTITION BY source ORDER BY strength DESC, t_us, target) AS place FROM ({STRENGTHS}) AS s) AS r WHERE place = 1"

#: The same from each record's nearest later odd and other record of its function: of effects of either sort the nearest is the strongest, so no others need be met.
_FOLLOWED = """
WITH placed AS (SELECT event_id, function_id, t_us, coalesce(anomaly_type <> 'benign', false) AS odd FROM {rows} WHERE function_id IS NOT NULL AND t_us IS NOT NULL),
met AS (SELECT event_id, t_us, odd, min(CASE WHEN odd THEN named_struct('t_us', t_us, 'event_id', event_id) END) OVER later AS after_odd, min(CASE WHEN NOT odd THEN named_struct('t_us', t_us, 'event_id', event_id) END) OVER later AS after_other FROM placed
  WINDOW later AS (PARTITION BY function_id ORDER BY t_us DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pairs AS (SELECT event_id AS source, t_us AS from_us, odd, inline(array(named_struct('b', after_odd, 'b_odd', true), named_struct('b', after_other, 'b_odd', false))) FROM met),
weighed AS (SELECT source, b.event_id AS target, b.t_us AS t_us, 0.3 * (1.0 - (b.t_us - from_us) / 3e8) + 0.12 + 0.1 * CASE WHEN odd AND b_odd THEN 0.7 WHEN odd THEN 0.3 ELSE 0.0 END AS strength FROM pairs WHERE b.t_us - from_us <= {span}),
ranked AS (SELECT source, target, strength, row_number() OVER (PARTITION BY source ORDER BY strength DESC, t_us, target) AS place FROM (SELECT source, target, t_us, round(strength + 1e-10, 4) AS strength FROM weighed WHERE strength >= 0.3) AS s)
SELECT source, target, strength FROM ranked WHERE place = 1"""


def successors(telemetry: DataFrame) -> DataFrame:
    """Each record's strongest effect as in ``SUCCESSORS``, without its pairs."""
    return run(_within(_FOLLOWED, CAUSAL), telemetry)


_RISK = "round(0.9 * total / (length - 1) + 0.02 * length + 1e-10, 4)"
PATHS_SQL = f"""
WITH RECURSIVE next AS MATERIALIZED ({{successors}}), walk AS (
  SELECT source AS start, target AS last, 2 AS length, strength AS total FROM next UNION ALL SELECT start, target, length + 1, total + strength FROM walk JOIN next ON last = source WHERE length < 15
), ended AS (SELECT start, max(length) AS length, max(total) AS total FROM walk GROUP BY start)
SELECT start, length, {_RISK} AS risk FROM ended WHERE length >= 3 AND {_RISK} > 0.5"""


def suspicious_paths(telemetry: DataFrame, depth: int = 15) -> DataFrame:
    """start, length and risk of the paths along strongest effects, of three to ``depth`` records, whose risk passes 0.5.

    All paths grow by one join a step; the table of successors is written once. A path ends where its last record has no effect.
    """
    spark, path = telemetry.sparkSession, work_path(telemetry.sparkSession, "successors")
    successors(telemetry).write.parquet(path)
    following = spark.read.parquet(path)
    steps = following.select(F.col("source").alias("at"), F.col("target").alias("to"), F.col("strength").alias("more"))
    walk = following.select(F.col("source").alias("start"), F.col("target").alias("last"), F.lit(2).alias("length"), F.col("strength").alias("total"))
    for _ in range(depth - 2):
        walk = walk.join(steps, F.col("last") == F.col("at"), "left").select(
            "start", F.when(F.col("to").isNotNull(), F.col("to")).alias("last"), (F.col("length") + F.col("to").isNotNull().cast("int")).alias("length"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")
        )
    return walk.selectExpr("start", "length", f"{_RISK} AS risk").where("length >= 3 AND risk > 0.5")


def clusters(telemetry: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Odd records in ``k`` groups by their standardised measures: cluster, size and mean measures. Fewer distinct records give fewer groups."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    fields = ["duration", "memory", "cpu", "network"]
    odd = telemetry.where("anomaly_type <> 'benign'").dropna(subset=fields)
    if odd.isEmpty():
        return telemetry.sparkSession.createDataFrame([], "cluster int, n long, " + ", ".join(f"{f} double" for f in fields))
    raw = VectorAssembler(inputCols=fields, outputCol="raw").transform(odd)
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(raw).transform(raw)
    found = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster").fit(scaled).transform(scaled)
    return found.groupBy("cluster").agg(F.count("*").alias("n"), *(F.round(F.avg(f), 4).alias(f) for f in fields))


def density_clusters(telemetry: DataFrame, eps: float = 0.5, least: int = 3) -> DataFrame:
    """event_id, cluster and core of all odd records with all four measures, by density over their standardised measures (see ``density``)."""
    fields = ["duration", "memory", "cpu", "network"]
    odd = telemetry.where("anomaly_type <> 'benign'").select("event_id", *fields)
    return density.density_clusters(density.standardised(odd, fields), fields, eps=eps, least=least)


def distances(links: DataFrame) -> DataFrame:
    """origin, node, steps and number of shortest paths between the nodes of ``links`` (source, target), as far as one reaches another.

    One join a step, over the pairs found in the step before; each step is written, and the last one finds no new pair. Pairs grow
    with the square of the nodes (functions, not records). Loops and repeated links count once, null ends not at all.
    """
    spark, path = links.sparkSession, work_path(links.sparkSession, "distances")
    links.select("source", "target").where("source <> target").distinct().write.parquet(f"{path}/links")
    linked = spark.read.parquet(f"{path}/links")
    linked.selectExpr("source AS origin", "target AS node", "1 AS steps", "1D AS paths").write.parquet(f"{path}/steps=1")
    known, step = spark.read.parquet(f"{path}/steps=1"), 1
    while True:
        step += 1
        ends = spark.read.parquet(f"{path}/steps={step - 1}").join(linked, F.col("node") == F.col("source")).where("origin <> target")
        new = ends.groupBy("origin", F.col("target").alias("node")).agg(F.lit(step).alias("steps"), F.sum("paths").alias("paths")).join(known.select("origin", "node"), ["origin", "node"], "left_anti")
        new.write.parquet(f"{path}/steps={step}")
        found = spark.read.parquet(f"{path}/steps={step}")
        if found.isEmpty():
            return known
        known = known.unionByName(found)


#: Of each node of the links: closeness by the ways that lead to it, betweenness as a share of all pairs, and its flow, the least node of those that it reaches and that reach it.
_CENTRAL = """
WITH nodes AS (SELECT source AS node FROM {links} WHERE source <> target UNION SELECT target FROM {links} WHERE source <> target), total AS (SELECT count(*) AS m FROM nodes),
near AS (SELECT node, count(*) AS reached, sum(steps) AS far FROM {pairs} GROUP BY node),
inside AS (SELECT a.node, sum(a.paths * b.paths / c.paths) AS share FROM {pairs} a JOIN {pairs} b ON a.node = b.origin JOIN {pairs} c ON c.origin = a.origin AND c.node = b.node AND c.steps = a.steps + b.steps GROUP BY a.node),
mutual AS (SELECT a.origin AS node, min(a.node) AS least FROM {pairs} a JOIN {pairs} b ON a.origin = b.node AND a.node = b.origin GROUP BY a.origin)
SELECT n.node, round(coalesce(reached * 1e0 / far * reached / (m - 1), 0e0) + 1e-10, 6) AS closeness, round(CASE WHEN m > 2 THEN coalesce(share, 0e0) / ((m - 1e0) * (m - 2e0)) ELSE 0e0 END + 1e-10, 6) AS betweenness, least(n.node, coalesce(least, n.node)) AS flow
FROM nodes n CROSS JOIN total LEFT JOIN near ON n.node = near.node LEFT JOIN inside ON n.node = inside.node LEFT JOIN mutual ON n.node = mutual.node"""


def centralities(links: DataFrame) -> DataFrame:
    """node, closeness, betweenness and flow (strongly connected part) of each node of ``links`` (source, target); no links, no rows."""
    return links.sparkSession.sql(_CENTRAL, links=links, pairs=distances(links))


def centralities_sql(links: str, steps: int = 8) -> str:
    """The same for graphs whose longest shortest path has fewer than ``steps`` steps."""
    parts = [f"links AS MATERIALIZED (SELECT DISTINCT source, target FROM ({links}) AS l WHERE source <> target)", "k1 AS MATERIALIZED (SELECT source AS origin, target AS node, 1 AS steps, 1e0 AS paths FROM links)"]
    for k in range(1, steps):
        grown = f"SELECT origin, target AS node, {k + 1} AS steps, sum(paths) AS paths FROM k{k} JOIN links ON node = source WHERE steps = {k} AND origin <> target GROUP BY origin, target"
        parts.append(f"k{k + 1} AS MATERIALIZED (SELECT * FROM k{k} UNION ALL SELECT g.* FROM ({grown}) AS g ANTI JOIN k{k} AS o ON g.origin = o.origin AND g.node = o.node)")
    return f"WITH {', '.join(parts)}{_CENTRAL.format(links='links', pairs=f'k{steps}').replace('WITH ', ', ', 1)}"


def eigenvector(links: DataFrame, rounds: int = 100, tolerance: float = 1e-6, every: int = 10) -> DataFrame:
    """node and score of each node of ``links`` (source, target): the leading eigenvector of who links to whom, of length one, by power iteration.

    A round adds to a node's score those of the nodes that link to it: one join and one sum, as every node also links to itself. After
    ``every`` so many rounds the scores, one row a node, are scaled to length one and written; it ends once they together move by
    less than ``tolerance`` a node from one writing to the next. Loops count, repeated links once, null ends not at all; not settled in
    ``rounds`` is an error, no links give no rows.
    """
    spark, path = links.sparkSession, work_path(links.sparkSession, "eigenvector")
    links.select("source", "target").dropna().distinct().write.parquet(f"{path}/links")
    linked = spark.read.parquet(f"{path}/links")
    nodes = linked.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    linked.unionByName(nodes.selectExpr("node AS source", "node AS target")).write.parquet(f"{path}/steps")
    steps = spark.read.parquet(f"{path}/steps")
    nodes.select("node", F.lit(1.0).alias("score")).write.parquet(f"{path}/rounds=0")
    now = spark.read.parquet(f"{path}/rounds=0")
    n, moved = now.count(), None
    for done in range(every, rounds + 1, every):
        before = now.select(F.col("node").alias("_node"), F.col("score").alias("before"))
        for _ in range(every):
            now = steps.join(now, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.sum("score").alias("score"))
        now.write.parquet(f"{path}/grown={done}")
        grown = spark.read.parquet(f"{path}/grown={done}")
        length = grown.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("length"))
        grown.join(F.broadcast(length)).select("node", (F.col("score") / F.col("length")).alias("score")).write.parquet(f"{path}/rounds={done}")
        now = spark.read.parquet(f"{path}/rounds={done}")
        moved = now.join(before, F.col("node") == F.col("_node")).agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("moved")).first()["moved"]
        if moved is None or moved < n * tolerance:
            return now.select("node", F.round("score", 6).alias("score"))
    raise ValueError(f"scores still move by {moved} in {rounds} rounds")


def eigenvector_sql(links: str, rounds: int = 100, tolerance: float = 1e-6) -> str:
    """The same with every round as a row of all scores, in the order of their names."""
    return f"""WITH RECURSIVE links AS MATERIALIZED (SELECT DISTINCT source, target FROM ({links}) AS l WHERE source IS NOT NULL AND target IS NOT NULL),
nodes AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS k FROM (SELECT source AS node FROM links UNION SELECT target FROM links) AS u),
weights AS MATERIALIZED (SELECT list(CASE WHEN a.k = b.k THEN 1e0 ELSE 0e0 END + CASE WHEN l.source IS NULL THEN 0e0 ELSE 1e0 END ORDER BY a.k, b.k) AS w, (SELECT count(*) FROM nodes) AS n FROM nodes a CROSS JOIN nodes b LEFT JOIN links l ON l.target = a.node AND l.source = b.node),
steps AS (
  SELECT 0 AS r, list_transform(range(n), lambda i: 1e0) AS x, list_transform(range(n), lambda i: 1e0) AS b, false AS settled FROM weights
  UNION ALL SELECT r + 1, y, CASE WHEN (r + 1) % 10 = 0 THEN y ELSE b END, (r + 1) % 10 = 0 AND list_sum(list_transform(list_zip(y, b), lambda z: abs(z[1] - z[2]))) < n * {tolerance!r}
  FROM (SELECT *, list_transform(g, lambda v: v / sqrt(list_dot_product(g, g))) AS y FROM (SELECT r, b, n, list_transform(range(n), lambda i: list_dot_product(w[i * n + 1:i * n + n], x)) AS g FROM steps, weights WHERE NOT settled AND r < {rounds}) AS grown) AS scaled
)
SELECT node, round(x[k], 6) AS score FROM nodes, steps WHERE settled"""


_BRACES = "replace(<sub:<sub:coalesce(payload, ''), '\"[^\"]*\"', ''>, '[^{{}}]', ''>, '{{}}', '')"
_UNIT = ", ".join(f"round(CASE WHEN norm > 0 THEN {x} / norm ELSE 0.0 END + 1e-10, 6) AS {x}" for x in ("n_parts", "is_handler", "is_api", "depth", "n_keys", "nested", "failed", "failure_kind"))
#: Features of a record's texts as a vector of length one: parts of the function's name, its flags, depth and names of the payload (JSON; objects in lists count too), whether there is a message and its kind (fixed values). Null texts give zeros; escaped quotes within a payload's strings aren't parsed.
TEXTS = f"""
SELECT event_id, {_UNIT} FROM (
  SELECT *, sqrt(n_parts * n_parts + is_handler + is_api + depth * depth + n_keys * n_keys + nested + failed + failure_kind * failure_kind) AS norm FROM (
    SELECT event_id, n_parts, is_handler, is_api, CAST(<depth:braces> AS DOUBLE) AS depth, n_keys, CASE WHEN <depth:braces> > 1 THEN 1.0 ELSE 0.0 END AS nested, failed,
      CASE WHEN failed = 0 THEN 0.0 WHEN message LIKE '%timeout%' THEN 1.0 WHEN message LIKE '%memory%' THEN 2.0 WHEN message LIKE '%permission%' OR message LIKE '%auth%' THEN 3.0 WHEN message LIKE '%network%' OR message LIKE '%connection%' THEN 4.0 ELSE 0.5 END AS failure_kind
    FROM (
      SELECT event_id, CASE WHEN function_id IS NULL THEN 0.0 ELSE length(function_id) - length(replace(function_id, '-', '')) + 1.0 END AS n_parts, CASE WHEN lower(function_id) LIKE '%handler%' THEN 1.0 ELSE 0.0 END AS is_handler, CASE WHEN lower(function_id) LIKE '%api%' THEN 1.0 ELSE 0.0 END AS is_api,
        {_BRACES} AS braces, CAST(<keys:payload> AS DOUBLE) AS n_keys, CASE WHEN message <> '' THEN 1.0 ELSE 0.0 END AS failed, lower(message) AS message
      FROM {{rows}}
    ) AS parsed
  ) AS measured
) AS weighed"""
#: Names, payloads and messages of the event tables.
TEXTS_OF = "SELECT event_id, concat('fn-', CAST(user_id % 20 AS <string>)) AS function_id, props AS payload, CASE WHEN event_type = 'error' THEN event_type END AS message FROM {rows}"
