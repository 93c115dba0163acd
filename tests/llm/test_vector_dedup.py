"""Links and components of embeddings against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.llm import vector_dedup as vd


def brute(rows, cosine=0.95):
    usable = [i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    unit = [vd.units(np.array([v]))[0] if ok else None for ok, (_, v) in zip(usable, rows, strict=True)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and len(unit[a]) == len(unit[b]) and (rows[a][1] == rows[b][1] or float(unit[a] @ unit[b]) >= cosine):
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if usable[k]:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        component = least[find(k)] if usable[k] else i
        out.append(repr((i, n[k], component, i is None or i == component)))
    return sorted(out)


def found(spark, rows, kind="double", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("e", "fp", "fq", "node", "list", "links", "copies", "component", "ok")})
    return sorted(repr(tuple(r)) for r in vd.near_duplicates(df.repartition(5), **more).collect())


def clouds(seed, groups, size, dim=16, spread=0.3):
    """Groups whose members lie about the threshold from each other, among single vectors."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        out += [(centre + spread * rng.standard_normal(dim)).tolist() for _ in range(size)]
    return out + [rng.standard_normal(dim).tolist() for _ in range(300)]


@pytest.mark.parametrize("block", [(8, 8), (256, 4096)])
def test_all_pairs(spark, monkeypatch, block):
    """Groups about the threshold, lists in many blocks and in one; scaled copies; copies."""
    monkeypatch.setattr(vd, "BLOCK", block)
    vectors = clouds(1, 12, 25)
    vectors += [[x * 1e30 for x in vectors[0]], [x * 1e-200 for x in vectors[1]], vectors[2], vectors[2], [-x for x in vectors[3]]]
    rows = list(zip((int(i) for i in np.random.default_rng(3).permutation(10 * len(vectors))), vectors))
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Nulls, zeros, non-finite components, other lengths, repeated ids, null ids, huge and tiny components."""
    v = clouds(2, 2, 6)[:20]
    rows = [(k, x) for k, x in enumerate(v)] + [(3, v[3]), (3, v[4]), (None, v[0]), (None, None)]
    rows += [(50, None), (51, []), (52, [0.0] * 16), (53, [1.0, None] * 8), (54, [float("nan")] * 16), (55, [float("inf")] + [0.0] * 15), (56, v[0][:7]), (57, v[0][:7]), (58, [x * 1.01 for x in v[0][:7]]), (59, v[0][:5])]
    rows += [(60, [1e308] * 16), (61, [1e-320] * 16), (62, [-0.0] * 15 + [1.0]), (63, [0.0] * 15 + [1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == brute([(1, None)]) and found(spark, [(2, [1.0])]) == brute([(2, [1.0])])


def test_candidates_lose_nothing():
    """No pair within reach is left out by the codes, whatever they leave out."""
    rng = np.random.default_rng(4)
    x = vd.units(np.array(clouds(5, 40, 20, dim=64, spread=0.2)))
    index = vd.fit(x, 16)
    of = vd.nearest(x, index.coarse)[0]
    for c in range(4):
        u = x[of == c]
        codes, left = index.code(u - index.coarse[c])
        maybe = vd._candidates(index, c, u, slice(0, len(u)), codes, left, math.sqrt(0.1))
        assert maybe[(u @ u.T) >= 0.95].all() and maybe.sum() < maybe.size
    assert rng is not None


def test_recall_at_the_threshold():
    """Pairs of a cosine of 0.95 in random directions share a list."""
    rng = np.random.default_rng(6)
    x = vd.units(rng.standard_normal((6000, 64)))
    a, o = x[:2000], rng.standard_normal((2000, 64))
    o = vd.units(o - (o * a).sum(1, keepdims=True) * a)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * o
    index = vd.fit(np.concatenate([x, b])[rng.permutation(8000)], vd.centroids_for(8000))
    near = lambda u: (d := (index.coarse**2).sum(1) - 2 * u @ index.coarse.T) <= d.min(1, keepdims=True) + vd.MARGIN
    assert (near(a) & near(b)).any(1).mean() >= 0.999


def test_sql(spark, tables, duck, same):
    """The table, and one with links, chains, copies and odd rows."""
    import duckdb

    from skytally.llm.registry import op12_vector_dedup

    same(op12_vector_dedup(spark, tables), duck, vd.ORACLE_SQL)
    v = clouds(7, 6, 8, dim=16)[:60]
    rows = [*enumerate(v), (900, v[3]), (901, v[3]), (902, None), (903, [0.0] * 16), (904, [float("nan")] * 16), (905, v[0][:5])]
    con = duckdb.connect()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    same(vd.near_duplicates(df), con, vd.ORACLE_SQL)


def test_table(spark, tables):
    from skytally.llm.registry import op12_vector_dedup

    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in op12_vector_dedup(spark, tables).collect()) == brute(rows)
