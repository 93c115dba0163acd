"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with runs of white space as one space. An item of m characters may occur with up to
``rate * m`` edits. Cut into one piece more than that, it has a piece without an edit in every such occurrence. All pieces of
all items are searched for at once by the hashes of their first characters, and around each exact hit Myers' bit-parallel
algorithm computes the least edit distance between the item and any stretch of the text. An item under ``LEAST_CHARS``
characters must occur exactly and as whole words, for with edits it would be found nearly everywhere. One over ``LONG`` is first cut into
nearly equal parts of at most that length, for wherever it occurs within its budget one of its parts does within its own; around each
such part the whole item is compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import discard, give_back, mapped, materialise, sliced

#: Errors allowed by character of the item, and the length under which an item must occur without any.
RATE, LEAST_CHARS = 0.08, 40
#: Bytes of items that are sent to the tasks at once; larger sets go in blocks, each against all documents.
BLOCK_BYTES = 32_000_000
#: Characters of a piece that are hashed at most, of text that are hashed at once, and of a part of an item that is looked for by itself.
HEAD, CHUNK, LONG = 12, 500_000, 4000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(length: int, pieces: int) -> list[tuple[int, int]]:
    """(start, end) of nearly equal pieces of so many characters."""
    at = [k * length // pieces for k in range(pieces + 1)]
    return list(zip(at, at[1:], strict=False))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(codes: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(q, hash of the q characters from each place on) for the lengths asked for; each comes from the one before it."""
    h = codes.astype(np.uint64) + np.uint64(1)
    for q in range(1, max(lengths, default=0) + 1):
        if q > 1:
            if len(h) < 2:
                return
            h = h[:-1] * BASE + codes[q - 1 :]
        if q in lengths:
            yield q, h


def best_match(item: str, text: str, start: int, end: int, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the stretch of text[start:end] nearest to the item, the first of several; None if over the budget."""
    m = len(item)
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, where = full, 0, m, budget + 1, -1
    for k in range(start, end):
        eq = masks.get(text[k], 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp = down | (full & ~(d0 | up))
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        up, down = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, where = score, k + 1
            if not best:
                break
    return None if where < 0 else (best, where)


class Index:
    """The pieces of a block of items by the hash of their first characters.

    Hashes of all windows of a text are computed at once; a bit table passes over nearly all of them, and what is left is looked up
    among the sorted hashes and compared character by character. Pieces of one item that begin alike are one entry, which stands
    for the stretch of places where they may lie, so an item that repeats itself costs no more than another.
    """

    def __init__(self, items: Sequence[tuple[int, str]], rate: float):
        allowed = lambda t: 0 if len(t) < LEAST_CHARS else int(rate * len(t))
        self.wholes = [(i, t, allowed(t)) for i, t in dict.fromkeys(items)]
        #: Of each part the item's identifier, the part, its edits, the item's place among ``wholes`` and the part's place in it.
        self.items = [(i, t[a:z], allowed(t[a:z]), w, a) for w, (i, t, _) in enumerate(self.wholes) for a, z in cut(len(t), -(-len(t) // LONG))]
        owner, at, size, where, begin = [], [], [], [], 0
        for k, (_, text, budget, _, _) in enumerate(self.items):
            for a, z in cut(len(text), budget + 1):
                owner.append(k)
                at.append(a)
                size.append(z - a)
                where.append(begin + a)
            begin += len(text)
        owner, at, size, place = (np.array(x, np.int64) for x in (owner, at, size, where))
        first, codes, self.heads = np.minimum(size, HEAD), codes_of("".join(t for _, t, *_ in self.items)), {}
        for q in sorted(set(first.tolist())):
            own = np.flatnonzero(first == q)
            h = codes[place[own]].astype(np.uint64) + np.uint64(1)
            for k in range(1, q):
                h = h * BASE + codes[place[own] + k]
            order = np.lexsort((at[own], owner[own], h))
            h, own = h[order], own[order]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[own[1:]] != owner[own[:-1]])])
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(h)) - 1
            # Of pieces that are alone in their entry the length is kept, so that the whole piece is compared.
            entry = np.stack([owner[own[starts]], at[own[starts]], at[own[ends]], np.where(starts == ends, size[own[starts]], q)])
            hashes = h[starts]
            bits = max(16, int(16 * len(hashes)).bit_length())
            table = np.zeros(1 << bits, bool)
            table[(hashes * MIX) >> np.uint64(64 - bits)] = True
            self.heads[q] = (hashes, entry, table, np.uint64(64 - bits))

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(where, entry) of all windows that hash like a piece's first characters, ``CHUNK`` at a time."""
        most = max(self.heads, default=0)
        for a in range(0, len(codes), CHUNK):
            part = codes[a : a + CHUNK + most - 1]
            for q, h in window_hashes(part, set(self.heads)):
                hashes, entry, table, shift = self.heads[q]
                h = h[: min(len(h), CHUNK)]
                maybe = np.flatnonzero(table[(h * MIX) >> shift])
                lo, n = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
                n -= lo
                cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(CHUNK, n.sum() + CHUNK, CHUNK), "left") + 1)
                for own in np.split(np.arange(len(n)), cuts[cuts < len(n)]):
                    inner = np.arange(n[own].sum()) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                    yield np.repeat(maybe[own] + a, n[own]), entry[:, np.repeat(lo[own], n[own]) + inner]

    def search(self, texts: Sequence[str]) -> Iterator[Iterator[tuple[int, int, int, int]]]:
        """For each normalised text (item_id, edits, start at the latest, end) of the items that occur in it, by their best occurrence."""
        spots: list[dict[int, list[tuple[int, int]]]] = [defaultdict(list) for _ in texts]
        begins = np.cumsum([0, *(len(t) for t in texts)])
        for where, (owner, low, high, size) in self.hits(codes_of("".join(texts))) if self.heads else ():
            doc = np.searchsorted(begins, where, "right") - 1
            for d, p, k, a, z, n in zip(doc.tolist(), (where - begins[doc]).tolist(), owner.tolist(), low.tolist(), high.tolist(), size.tolist(), strict=True):
                if texts[d][p : p + n] == self.items[k][1][a : a + n]:
                    own, lo, hi = spots[d][k], p - z, p - a
                    if own and own[-1][0] <= lo <= own[-1][1] + 1:
                        own[-1] = (own[-1][0], max(hi, own[-1][1]))
                    else:
                        own.append((lo, hi))
        for text, own in zip(texts, spots, strict=True):
            yield self.verified(text, own)

    def verified(self, text: str, spots: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int, int, int]]:
        """``spots``: by part the first and last places where it may begin."""
        found: dict[int, tuple[int, int, int]] = {}
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k in sorted(spots):
            item_id, part, budget, w, at = self.items[k]
            whole, most = self.wholes[w][1:]
            if len(whole) < LEAST_CHARS:
                if got := whole_words(whole, text):
                    found[item_id] = min(got, found.get(item_id, got))
            elif len(part) == len(whole):
                near[w] += spots[k]
            else:
                for lo, hi in joined(sorted(spots[k]), len(part), budget, len(text)):
                    if best_match(part, text, lo, hi, budget):
                        near[w].append((lo - at - most, hi - at + most))
        for w, begins in near.items():
            item_id, item, budget = self.wholes[w]
            for lo, hi in joined(sorted(begins), len(item), budget, len(text)):
                at = text.find(item, lo, hi)
                got = (0, at + len(item)) if at >= 0 else best_match(item, text, lo, hi, budget)
                if got:
                    new = (got[0], got[1], max(lo, got[1] - len(item) - got[0]))
                    found[item_id] = min(new, found.get(item_id, new))
        yield from ((i, e, start, end) for i, (e, end, start) in found.items())

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        return next(self.search([text]))


def whole_words(item: str, text: str) -> tuple[int, int, int] | None:
    """(0, end, start) of the first place where the item stands in the text and no letter or digit goes on across either end."""
    start = text.find(item)
    while start >= 0:
        end = start + len(item)
        left = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
        if not left and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum()):
            return 0, end, start
        start = text.find(item, start + 1)
    return None


def joined(begins: list[tuple[int, int]], size: int, budget: int, length: int) -> Iterator[tuple[int, int]]:
    """Stretches of text around the places (first, last) where an item may begin; those that overlap are one."""
    lo = hi = None
    for first, last in begins:
        a, z = max(0, first - budget), min(length, last + size + budget)
        if hi is not None and a <= hi:
            hi = max(hi, z)
        else:
            if hi is not None:
                yield lo, hi
            lo, hi = a, z
    if hi is not None:
        yield lo, hi


_built: dict[str, Index] = {}


def index_of(items: tuple[tuple[int, str], ...], rate: float) -> Index:
    """One index is kept in each Python worker, until its task ends."""
    key = sha1(repr((items, rate)).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Index(items, rate)
    return _built[key]


def searched(index: Index, texts: Sequence[str | None]) -> Iterator[tuple[int, Iterator[tuple[int, int, int, int]]]]:
    """(place, matches) of the texts that aren't empty, normalised and searched by blocks of about ``CHUNK`` characters."""
    at = 0
    while at < len(texts):
        places, block, chars = [], [], 0
        while at < len(texts) and chars < CHUNK:
            if texts[at]:
                places.append(at)
                block.append(normal(texts[at]))
                chars += len(block[-1])
            at += 1
        yield from zip(places, index.search(block), strict=True)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, tuple[tuple[int, str], ...]]]:
    """Whether it is the last, and the items of each bounded block, normalised, without null ids and empty texts."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield b == n - 1, tuple(sorted((r["i"], x) for r in part if (x := normal(r["t"]))))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = RATE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document and item that occurs in it: doc_id, item_id, edits, start, end (in the normalised text).

    The nearest occurrence is given, the first of several. Null and empty texts hold nothing; items with a null id or a null or
    blank text match nothing; items that share an id but not their text may give a row each, repeated items count once. Repeated
    documents give their rows again, null ids too; an empty table of either gives no rows; other columns are ignored. Nothing is
    shuffled, and a document of any length is searched as a whole.
    """
    out = "doc_id long, item_id long, edits long, start long, end long"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def found(items: tuple[tuple[int, str], ...]) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(items, rate)
            for batch in sliced(batches):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(ids[k], *m) for k, found in searched(index, texts) for m in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "edits", "start", "end"])
            _built.clear()
            give_back()

        return slim.mapInArrow(work, out)

    result = None
    for last, items in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        # One of several blocks is run and written before the next one is read, so one alone is held.
        part = found(items) if last and result is None else materialise(found(items), "found")
        result = part if result is None else result.unionAll(part)
    return docs.sparkSession.createDataFrame([], out) if result is None else result


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold an item (see ``contaminated``).

    Null and empty texts and null ids stay, repeated rows stay or go together, an empty table stays empty, and all columns, whatever
    their names, stay as they are.
    """
    at = docs.columns.index(text_col)

    def kept(df: DataFrame, items: tuple[tuple[int, str], ...]) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(items, rate)
            for batch in sliced(batches):
                held = {k for k, found in searched(index, batch.column(at).to_pylist()) if next(found, None)}
                yield batch.filter(pa.array([k not in held for k in range(batch.num_rows)], pa.bool_()))
            _built.clear()
            give_back()

        return mapped(df, work, docs.schema.fields)

    before = None
    for last, items in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        docs = kept(docs, items) if last else materialise(kept(docs, items), "clean")
        if not last:
            if before is not None:
                discard(before)
            before = docs
    return docs
