"""Pairs of records close in time: rows are dealt once by key and slot of time and sorted, and a task makes its pairs in blocks along the time.

A row goes to the slot it lies in and, as a follower alone, to those before it that reach so far. A task holds the rows of one span and
one block of pairs, whatever the pairs' number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are made at once.
BLOCK = 32_768
Columns = dict[str, np.ndarray]
Work = Callable[[Columns, np.ndarray, np.ndarray, np.ndarray, pa.Array], Sequence]


def to_places(x: np.ndarray) -> np.ndarray:
    """Four places, halves up."""
    return np.floor(x * 1e4 + 0.5) / 1e4


def texts(codes: np.ndarray, words: pa.Array) -> pa.Array:
    return words.take(pa.array(codes))


def alike(columns: Columns, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether texts are equal; a null text equals none."""
    left = columns[name][a]
    return (left == columns[name][b]) & (left >= 0)


def pairs(rows: DataFrame, span: int, work: Work, schema: str, *, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """What ``work`` makes of each row and all later rows of its key at most ``span`` microseconds after it in t_us.

    ``work`` gets the columns held, the places of both rows of each pair, their distance in time, and the texts that text columns
    number (null: -1). Pairs are made ``block`` at once.
    """
    width, stride = 2 * span, 8 * span
    own = F.expr(f"t_us DIV {width}")
    dealt = rows.dropna(subset=["t_us", *by]).withColumn("_slot", F.explode(F.sequence(F.expr(f"(t_us - {span}) DIV {width}"), own)))
    dealt = dealt.withColumn("_own", F.col("_slot") == own).repartition(*by, "_slot").sortWithinPartitions(*by, "_slot", "t_us")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        held: Columns = {}
        group, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _columns(batch, words)
            keys = np.stack([new[k] for k in (*by, "_slot")])
            changed = np.append(last is not None and bool((keys[:, 0] != last).any()), (keys[:, 1:] != keys[:, :-1]).any(0))
            groups = group + np.cumsum(changed)
            group, last = int(groups[-1]), keys[:, -1]
            # Along this line of time two groups lie further apart than a span.
            new["_at"] = new["t_us"] - new["_slot"] * width + groups * stride
            held = {c: np.concatenate([held[c], x]) for c, x in new.items()} if held else new
            done = int(np.searchsorted(held["_at"], held["_at"][-1] - span))
            yield from _blocks(held, done, span, work, words, names, block)
            held = {c: x[done:] for c, x in held.items()}
        if held:
            yield from _blocks(held, len(held["_at"]), span, work, words, names, block)

    names = [part.split()[0] for part in schema.split(",")]
    return dealt.mapInArrow(run, schema)


def _columns(batch: pa.RecordBatch, words: dict[str, int]) -> Columns:
    out: Columns = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            coded = column.dictionary_encode()
            numbers = np.array([words.setdefault(w, len(words)) for w in coded.dictionary.to_pylist()] + [-1])
            out[name] = numbers[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
        elif pa.types.is_boolean(column.type):
            out[name] = column.fill_null(False).to_numpy(zero_copy_only=False)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def _blocks(held: Columns, done: int, span: int, work: Work, words: dict[str, int], names: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose first row is one of the first ``done`` rows; a row's followers may fall on several blocks."""
    at, first = held["_at"], np.flatnonzero(held["_own"][:done])
    low, high = np.searchsorted(at, at[first], "right"), np.searchsorted(at, at[first] + span, "right")
    ends = np.cumsum(high - low)
    told = pa.array(list(words), pa.string())
    for begin in range(0, int(ends[-1]) if len(ends) else 0, block):
        end = min(begin + block, int(ends[-1]))
        some = slice(int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, end)) + 1)
        starts = ends[some] - (high - low)[some]
        n = np.minimum(ends[some], end) - np.maximum(starts, begin)
        a = np.repeat(first[some], n)
        b = np.arange(begin, end) + np.repeat(low[some] - starts, n)
        made = work(held, a, b, at[b] - at[a], told)
        if len(made[0]):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names)
