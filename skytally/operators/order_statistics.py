"""Percentiles of the last rows of each key, kept in order as rows come and go.

A frame's percentiles can't be carried from row to row by an aggregate, which would sort every frame anew. Here each row is
numbered within its key and goes to a block of numbers; a block's task also gets the rows of the frame before it, reads its rows in
order and keeps the frame's values sorted. So a key with very many rows is dealt over as many tasks as it has blocks, and a task
holds one frame.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window


def numbered(rows: DataFrame, by: str, order: str, into: str, slot: int = 100_000, ties: str | None = None) -> DataFrame:
    """``rows`` with their number within ``by`` in ``order`` (a whole number; ``ties`` orders equal ones), from 1.

    Rows are numbered within slots of the order's range and the slots' counts are added up, so that no key's rows need one task.
    """
    cut = rows.withColumn("_slot", F.floor(F.col(order) / slot))
    counts = cut.groupBy(by, "_slot").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inner = cut.withColumn("_own", F.row_number().over(Window.partitionBy(by, "_slot").orderBy(ties or order)))
    same = inner[by].eqNullSafe(before[by]) & inner["_slot"].eqNullSafe(before["_slot"])
    return inner.join(before, same).select(*(inner[c] for c in rows.columns), (F.col("_own") + F.col("_before")).alias(into))


class Frame:
    """The last ``size`` values, nulls included, and the others among them in order."""

    def __init__(self, size: int):
        self.size, self.recent, self.ordered = size, deque(), []

    def add(self, value: float | None) -> None:
        self.recent.append(value)
        if value is not None:
            insort(self.ordered, value)
        if len(self.recent) > self.size and (old := self.recent.popleft()) is not None:
            del self.ordered[bisect_left(self.ordered, old)]

    def at(self, share: float) -> float | None:
        """Percentile with linear interpolation; null of no values."""
        if not self.ordered:
            return None
        place = share * (len(self.ordered) - 1)
        k = int(place)
        low = self.ordered[k]
        return low if k + 1 == len(self.ordered) else low + (self.ordered[k + 1] - low) * (place - k)


def running_percentiles(
    rows: DataFrame, wanted: Mapping[str, tuple[str, float]], *, by: str = "function_id", order: str = "event_id", frame: int = 10_000, block: int = 50_000
) -> DataFrame:
    """``rows`` with a column for each of ``wanted`` (name: column, share): that percentile over the last ``frame`` rows of the key.

    Nulls are left out; a frame of nulls has null. Rows keep their columns; a null key is a key; an empty table stays empty.
    """
    columns, made = rows.columns, numbered(rows, by, order, "_n")
    own = F.floor((F.col("_n") - 1) / block)
    also = F.when((F.col("_n") - 1) % block >= block - (frame - 1), F.array(own, own + 1)).otherwise(F.array(own))
    dealt = made.withColumn("_block", F.explode(also)).withColumn("_fresh", F.col("_block") == own)
    sources: Sequence[str] = sorted({c for c, _ in wanted.values()})
    out = StructType([*rows.schema.fields, *(StructField(name, DoubleType()) for name in wanted)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, frames = None, {}
        for batch in batches:
            at = {c: batch.schema.names.index(c) for c in (by, "_block", "_fresh", *sources)}
            values = {c: batch.column(at[c]).to_pylist() for c in at}
            got: dict[str, list] = {name: [] for name in wanted}
            for k in range(batch.num_rows):
                if key != (now := (values[by][k], values["_block"][k])):
                    key, frames = now, {c: Frame(frame) for c in sources}
                for c in sources:
                    frames[c].add(values[c][k])
                if values["_fresh"][k]:
                    for name, (c, share) in wanted.items():
                        got[name].append(frames[c].at(share))
            kept = batch.filter(batch.column(at["_fresh"]))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(len(columns))), *(pa.array(v, pa.float64()) for v in got.values())], out.names)

    return dealt.repartition(by, "_block").sortWithinPartitions(by, "_block", "_n").mapInArrow(work, out)
