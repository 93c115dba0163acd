"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.sources.shared import work_path


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the smallest node that can be reached, of every node of ``links``.

    Every node points at the smallest one known to it. A round lowers both ends' pointers to the smaller of the two, then follows each
    pointer's own; pointers that changed are counted, and rounds end when none did. Each round is written to the shared folder, so
    that no plan grows. The smallest neighbour is aggregated before rows are sent, so a node with very many links is no hot key.
    Links with a null end are ignored; loops make their node a part of its own.
    """
    spark, path = links.sparkSession, work_path(links.sparkSession, "connected")
    links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct().write.parquet(f"{path}/links")
    ends = spark.read.parquet(f"{path}/links")
    ends.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")).write.parquet(f"{path}/round=0")
    number, changed = 0, True
    while changed:
        now = spark.read.parquet(f"{path}/round={number}")
        left, right = now.select(F.col("node").alias("u"), F.col("root").alias("ru")), now.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        # Roots are lowered with their nodes, so whole trees meet.
        met = ends.join(left, "u").join(right, "v").where("ru <> rv").select(F.inline(F.array(*(F.struct(F.col(x).alias("node"), F.least("ru", "rv").alias("low")) for x in ("u", "v", "ru", "rv")))))
        low = met.groupBy("node").agg(F.min("low").alias("low"))
        lowered = now.join(low, "node", "left").select("node", F.least("root", F.coalesce("low", "root")).alias("root"), F.col("root").alias("was"))
        number += 1
        lowered.write.parquet(f"{path}/low={number}")
        held = spark.read.parquet(f"{path}/low={number}")
        jumped = held.join(held.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root"), "was")
        jumped.select("node", "root").write.parquet(f"{path}/round={number}")
        changed = not held.where("root <> was").isEmpty()
    return spark.read.parquet(f"{path}/round={number}")
