"""Audit of how five filters interact: what each removes, alone, after the others, and in every order.

Texts are scanned in their Arrow buffers. A table of byte classes tells spaces, capitals, symbols and the bytes that continue a code
point; prefix sums over a piece of the buffer give each document's counts as differences at its ends. A prefix sum of weighted bytes
gives every word's hash the same way, so words are never made into strings. A document's word hashes are sorted, neighbours with
equal hashes are compared byte by byte, and runs in which two words differ are told apart by their bytes, so counts of distinct words
are exact. Pieces are cut between documents, or after a space within a long one, so memory does not grow with the length of a text.

Each document's failures are a mask of five bits. Masks are counted by part before anything is shuffled; every order and step is then a
sum over the 32 counts of a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField

from skytally.llm.common import SPACES, blank_null, give_back, mapped, materialise

FILTERS = "ABCDE"
#: A: fewer words. B: distinct words under a share of all. C: capitals over a share of the code points. D: any of the symbols. E: an earlier copy.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "#$%&*|"
#: Bytes of a buffer that are scanned at once, and the documents that may lie in them.
PIECE, DOCS = 1 << 20, 1 << 20

SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in SPACES]] |= SPACE
_CLASS[ord("A") : ord("Z") + 1] |= CAPITAL
_CLASS[[ord(c) for c in SYMBOLS]] |= SYMBOL
_CLASS[0x80:0xC0] |= INNER
#: The base of word hashes (odd, so that it can be divided by), the multiplier that mixes them, and a number for each byte.
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n - 1, and their inverses, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _cut(data: np.ndarray, ends: np.ndarray, at: int, first: int) -> int:
    """Where the piece that begins at byte ``at`` of document ``first`` ends: between documents, or before a space of a long one.

    What is left of a long document is a piece of its own.
    """
    last = min(int(np.searchsorted(ends, at + PIECE, "right")) - 1, first + (1 if at > ends[first] else DOCS))
    if ends[last] > at:
        return int(ends[last])
    stop, to = int(ends[first + 1]), at + PIECE
    while to < stop:
        spaces = np.flatnonzero(_CLASS[data[to : min(to + 65536, stop)]] & SPACE)
        if len(spaces):
            return to + int(spaces[0])
        to += 65536
    return stop


def _words(data: np.ndarray, lo: int, hi: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and document of the words in a piece; ``edges`` are the documents' ends within it."""
    bytes_ = data[lo:hi]
    gap = np.ones(hi - lo + 2, bool)
    gap[1:-1] = (_CLASS[bytes_] & SPACE) != 0
    before, after = gap[:-2].copy(), gap[2:].copy()
    before[edges[:-1][edges[:-1] < hi - lo]] = True
    inner = edges[1:][edges[1:] > 0]
    after[inner - 1] = True
    start, end = np.flatnonzero(~gap[1:-1] & before), np.flatnonzero(~gap[1:-1] & after) + 1
    power, inverse = _powers(PIECE) if hi - lo <= PIECE else _powers.__wrapped__(hi - lo)
    sums = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(_BYTE[bytes_] * power[: hi - lo], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h >> np.uint64(20), start + lo, end + lo, np.searchsorted(edges, start, "right") - 1


def _unlike(data: np.ndarray, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] differ."""
    out = length[a] != length[b]
    if len(pick := np.flatnonzero(~out)):
        a, b, n = a[pick], b[pick], length[a[pick]]
        at = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(at, n)
        off = data[np.repeat(start[a], n) + inner] != data[np.repeat(start[b], n) + inner]
        out[pick] = np.logical_or.reduceat(off, at)
    return out


def distinct(data: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One word of each distinct (upper 20 bits of ``key``, bytes): positions in the arrays. Equal keys are verified."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    new = np.ones(len(order), bool)
    new[1:] = ~same
    at = np.flatnonzero(same)
    odd = at[_unlike(data, start, end - start, order[at], order[at + 1])]
    if len(odd):  # different words with one hash: their whole run goes by the bytes
        heads = np.flatnonzero(new)
        for head in np.unique(heads[np.searchsorted(heads, odd, "right") - 1]):
            stop, seen = np.searchsorted(key[order], key[order[head]], "right"), set()
            for i in range(head, stop):
                word = data[start[order[i]] : end[order[i]]].tobytes()
                new[i] = word not in seen
                seen.add(word)
    return order[new]


def scan(text: pa.Array) -> np.ndarray:
    """Words, distinct words, capitals, symbols and code points of each text; null is empty."""
    text = text.fill_null("")
    out = np.zeros((len(text), 5), np.int64)
    if not len(text):
        return out
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, values = text.buffers()
    ends = np.frombuffer(offsets, width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    at, cut_words = int(ends[0]), []
    while at < ends[-1]:
        first = int(np.searchsorted(ends, at, "right")) - 1
        hi = _cut(data, ends, at, first)
        last = int(np.searchsorted(ends, hi, "left"))
        edges = np.clip(ends[first : last + 1], at, hi) - at
        kinds = _CLASS[data[at:hi]]
        for column, kind in ((2, CAPITAL), (3, SYMBOL), (4, INNER)):
            sums = np.zeros(hi - at + 1, np.int64)
            np.cumsum((kinds & kind) != 0, out=sums[1:])
            out[first:last, column] += np.diff(sums[edges])
        h, start, end, doc = _words(data, at, hi, edges)
        out[first:last, 0] += np.bincount(doc, minlength=last - first)
        some = distinct(data, h | (doc.astype(np.uint64) << np.uint64(44)), start, end)
        went_on, goes_on = at > ends[first], hi < ends[last]
        if went_on or goes_on:  # such a piece lies in one document
            cut_words.append((h[some], start[some], end[some]))
            if not goes_on:
                h, start, end = (np.concatenate(x) for x in zip(*cut_words, strict=True))
                out[first, 1], cut_words = len(distinct(data, h, start, end)), []
        else:
            out[first:last, 1] = np.bincount(doc[some], minlength=last - first)
        at = hi
    out[:, 4] = np.diff(ends) - out[:, 4]
    return out


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, key (the text's SHA-256) and mask: bit k is set where the text fails filter k of A to D.

    Null texts are empty ones, null parts the empty string; other columns are ignored; every row is scanned, repeated or not.
    """
    text = blank_null(F.col(text_col))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), blank_null(F.col(part_col).cast("string")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, different, capitals, symbols, chars = scan(batch.column(3)).T
            failed = (words < LEAST_WORDS, 100 * different < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * chars, symbols > 0)
            mask = sum(x.astype(np.int32) << k for k, x in enumerate(failed))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mask, pa.int32())], ["doc_id", "part", "key", "mask"])
        give_back()

    return mapped(slim, work, [StructField("doc_id", LongType()), StructField("part", StringType()), StructField("key", BinaryType()), StructField("mask", IntegerType())])


def _steps() -> list[tuple[str, int, int, int]]:
    """Order, step, bit of its filter and bits of those before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; 600 rows a part.

    A document fails E where a smaller id has the same text anywhere in the table; a null id neither fails E nor makes others fail. Of
    several labels of one id, any 1 counts. Repeated rows count each. An empty table has no parts and gives no rows.
    """
    rows = materialise(masks(docs, id_col=id_col, text_col=text_col, part_col=part_col), "masks")
    # The first id of each text: joined on text and id, so that no text's copies meet in one task.
    firsts = rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    full = rows.join(firsts, ["key", "doc_id"], "left").withColumn("mask", F.col("mask").bitwiseOR(copy)).join(known, "doc_id", "left")
    counted = full.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("m"))  # at most 32 a part

    steps = _steps()
    pairs = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in sorted({s[2:] for s in steps})))
    each = parts.select("part", "m", F.inline(pairs))
    has = lambda x, bits: x["mask"].bitwiseAND(bits) != 0

    def total(column: str, test) -> Column:  # noqa: ANN001
        return F.aggregate(F.filter("m", test), F.lit(0).cast("long"), lambda a, x: a + x[column])

    bit, before = F.col("bit"), F.col("before")
    removed = lambda x: has(x, bit) & ~has(x, before)
    orders = factorial(len(FILTERS))
    # Among the filters that a document fails, each comes first in equally many orders.
    share = F.aggregate(F.filter("m", lambda x: has(x, bit)), F.lit(0).cast("long"), lambda a, x: a + x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("long"))
    sums = each.select(
        "part", "bit", "before", total("n", lambda x: ~has(x, bit.bitwiseOR(before))).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda x: has(x, bit) & has(x, before)).alias("redundant"), total("n", lambda x: x["mask"] == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("bad", removed).alias("toxic_lost"), share.alias("shapley"),
    )
    named = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, before int")  # 600 rows
    return sums.join(F.broadcast(named), ["bit", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS head FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, doc_id > head AS E
  FROM w LEFT JOIN l USING (doc_id)),
fails AS (
  SELECT part, good, bad, CASE WHEN A THEN 'A' ELSE '' END || CASE WHEN B THEN 'B' ELSE '' END || CASE WHEN C THEN 'C' ELSE '' END
    || CASE WHEN D THEN 'D' ELSE '' END || CASE WHEN E THEN 'E' ELSE '' END AS failed FROM f),
m AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM fails GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
s AS (
  SELECT *, contains(failed, own) AS fails_own, before <> '' AND regexp_matches(failed, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS gone
  FROM m, steps),
r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails_own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails_own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails_own AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails_own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails_own AND NOT gone THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
