"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node that has an edge and isn't the smallest itself.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest of its neighbours. The smallest
    neighbour is aggregated before the shuffle, and joined back; a node with very many edges is thus spread by Spark's skew
    join. Every round is written to the shared folder, and the one before it deleted. Edges with null ends and loops are ignored; repeated edges are one.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = materialise(ends.where("u <> v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    seen = mark(now)
    while seen["n"]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.inline(pairs)).where("u <> v").distinct()
        last, now = now, materialise(small, "edges")
        discard(last)
        before, seen = seen, mark(now)
        if before == seen:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.written_at = now.written_at
    return out
