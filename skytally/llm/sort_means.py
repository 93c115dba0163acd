"""Centroid clusters of embeddings in exact integers, by sort-means.

In each round the other centroids are sorted by their distance from each centroid. A vector begins at the centroid that it was
assigned to and looks at the others in that order; it stops at the first that lies strictly beyond twice its distance from where it
began, since by the triangle inequality neither that one nor any later one can be nearer or tie. All distances are squared integers.

Every round is one pass: tasks assign the vectors of their files, write them with their assignments to the shared folder, and add to
them one row of sums for each centroid that they met. The driver reads those sums alone, already added up by centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, IntegerType, LongType, StringType, StructField, StructType

from skytally.llm.common import discard, give_back, mapped, work_path

SCALE, SEED = 1024, 3
#: Integers are held within this bound, so that squared distances of 64 components fit a long.
BOUND = 1 << 27
#: Vectors that are assigned at once in a task.
ROWS = 4096
_FIELDS = [
    StructField("kind", StringType()), StructField("vec_id", LongType()), StructField("v", ArrayType(IntegerType())), StructField("cluster", IntegerType()),
    StructField("distance", LongType()), StructField("sums", ArrayType(LongType())),
]


def integers(vectors: DataFrame, *, id_col: str, vec_col: str, dim: int, scale: int = SCALE) -> DataFrame:
    """vec_id and v: the vectors with exactly ``dim`` components, none null or non-finite, as integers floor(scale * x)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where((F.size("v") == dim) & finite)
    held = lambda x: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x * float(scale)))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(held(x)).cast("int")).alias("v"))


def ranked(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others from near to far, and their squared distances."""
    apart = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    others = np.argsort(apart + np.where(np.eye(len(apart), dtype=bool), -1, 0), axis=1, kind="stable")[:, 1:]
    return others, np.take_along_axis(apart, others, 1)


def assign(v: np.ndarray, start: np.ndarray, centroids: np.ndarray, others: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of each row of ``v``, beginning at ``start``."""
    best, least = start.copy(), np.empty(len(v), np.int64)
    for c in np.unique(start):
        rows = np.flatnonzero(start == c)
        own = ((v[rows] - centroids[c]) ** 2).sum(1)
        nearest, number = own.copy(), np.full(len(rows), c)
        on = np.arange(len(rows))
        for other, gap in zip(others[c], apart[c], strict=True):
            on = on[gap <= 4 * own[on]]
            if not len(on):
                break
            d = ((v[rows[on]] - centroids[other]) ** 2).sum(1)
            wins = (d < nearest[on]) | ((d == nearest[on]) & (other < number[on]))
            nearest[on[wins]], number[on[wins]] = d[wins], other
        best[rows], least[rows] = number, nearest
    return best, least


def _round(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``state`` (vec_id, v, cluster) assigned anew, and its sums, as a written table; ``kind`` tells them apart.

    A row of sums holds a centroid's components, its count, and the upper and lower halves of its distances, so that none overflows.
    """
    others, apart = ranked(centroids)
    k, dim = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        names = [f.name for f in _FIELDS]
        sums = np.zeros((k, dim + 3), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                v = batch.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.int64)
                cluster, distance = assign(v, batch.column(2).to_numpy().astype(np.int64), centroids, others, apart)
                added = np.column_stack([v, np.ones(len(v), np.int64), distance >> 32, distance & 0xFFFFFFFF])
                for c in np.unique(cluster):
                    sums[c] += added[cluster == c].sum(0)
                columns = [pa.array(["row"] * len(v)), batch.column(0), batch.column(1), pa.array(cluster), pa.array(distance), pa.nulls(len(v))]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(columns, types, strict=True)], names)
        met = np.flatnonzero(sums[:, dim])
        if len(met):
            columns = [["sums"] * len(met), None, None, met, None, list(sums[met])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(met), t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        give_back()

    spark, path = state.sparkSession, work_path(state.sparkSession, "clusters")
    mapped(state.select("vec_id", "v", "cluster"), work, _FIELDS).write.partitionBy("kind").parquet(path)
    out = spark.read.schema(StructType([*_FIELDS[1:], _FIELDS[0]])).parquet(path)
    out.written_at = path
    return out


def _totals(written: DataFrame, dim: int) -> dict[int, tuple[int, list[int], int]]:
    """Count, sums of components and of distances by centroid, added up by Spark: one small row a centroid and place comes to the driver."""
    places = written.where("kind = 'sums'").select("cluster", F.posexplode("sums").alias("i", "x"))
    found: dict[int, list[int]] = {}
    for c, i, x in places.groupBy("cluster", "i").agg(F.sum(F.col("x").cast(DecimalType(38, 0))).alias("x")).collect():
        found.setdefault(c, [0] * (dim + 3))[i] = int(x)
    return {c: (s[dim], s[:dim], (s[dim + 1] << 32) + s[dim + 2]) for c, s in found.items()}


def _start_order(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def clusters(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept.

    Kept are vectors with ``dim`` components, none null or non-finite. The first centroids are the k kept vectors with the smallest
    hash of their id; of repeated ids the smallest vectors come first, and a null id is hashed as nothing. Fewer vectors give fewer
    centroids, none give no rows. Equal centroids are taken by number, so the later of two stays empty. Components beyond 131,072
    times 1024 / scale in size are held at that bound; inertias beyond a long are its largest value. Repeated rows each count; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    kept = integers(vectors, id_col=id_col, vec_col=vec_col, dim=dim)
    first = kept.orderBy(_start_order(F.col("vec_id")), "v").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    centroids = np.array([r["v"] for r in sorted(first, key=lambda r: (sha256(f"{SEED}:{'' if r['vec_id'] is None else r['vec_id']}".encode()).hexdigest(), r["v"]))], np.int64)
    state = _round(kept.withColumn("cluster", F.lit(0)), centroids)
    for _ in range(rounds):
        for c, (n, sums, _) in _totals(state, dim).items():
            centroids[c] = [s // n for s in sums]
        before, state = state, _round(state.where("kind = 'row'"), centroids)
        discard(before)
    found, most = _totals(state, dim), 2**63 - 1
    text = lambda c: sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    total = min(most, sum(d for _, _, d in found.values()))
    told = spark.createDataFrame([(int(c), min(most, d), total, text(c)) for c, (_, _, d) in found.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.where("kind = 'row'").select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Every vector against every centroid, round by round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS line, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS c, v FROM kept QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v AS vec, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT line, vec_id, kept.v, c{r}.c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM kept, c{r}) GROUP BY line, vec_id, v)"""
        )
        if r < rounds:
            floors = "list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i)"
            steps.append(
                f"""m{r} AS (SELECT c, {floors} AS v FROM (
    SELECT c, i, sum(vec[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)"""
            )
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} ON a.c = c{rounds}.c
"""


ORACLE_SQL = _oracle()
