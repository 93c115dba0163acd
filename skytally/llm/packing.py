"""Vector bin packing of token sequences.

Each example has a demand vector (tokens, segments, loss-bearing tokens) and each training sequence has limits on all three.
A sequence is filled greedily: of the waiting examples that fit whole, the one whose demand has the largest dot product with
what is left of the limits goes in. When none fits and room is left, one example is cut to fill it; the rest waits on.

Every Spark task packs the rows of its own input split over a pool of bounded size, so nothing is shuffled and memory does not
grow with the input. A task's last, unfilled sequences are split at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import give_back, sliced

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """What one training sequence may hold at most."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


class Encoder:
    """Text to little-endian 32-bit token ids, as the tokenizer file gives them without special tokens.

    Words of a byte-level BPE are encoded apart, so a cache by space-separated chunk, bounded in bytes, saves most of the work. That holds
    unless two spaces meet; such texts, and those that spell a special token, go to the tokenizer whole.
    """

    #: Bytes of chunks and ids that are kept, by a generous estimate, and characters of a chunk that is.
    CACHE, CHUNK = 48_000_000, 32

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.json_path = json_path
        with open(json_path, encoding="utf-8") as spec:
            self.special = [t["content"] for t in json.load(spec)["added_tokens"]]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.kept = 0

    @cached_property
    def whole(self):
        """The tokenizer itself, loaded when a text spells a special token."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def chunk(self, text: str) -> bytes:
        got = self.cache.get(text)
        if got is None:
            got = np.array(self.words.encode_ordinary(text), "<u4").tobytes()
            if len(text) <= self.CHUNK and self.kept < self.CACHE:
                self.cache[text] = got
                self.kept += 250 + 4 * len(text) + len(got)
        return got

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text:
            return np.array(self.words.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        get, chunk = self.cache.get, self.chunk
        return chunk(first) + b"".join([get(c) or chunk(c) for c in [" " + w for w in rest]])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of a public byte-level vocabulary, made once in each Python worker."""
    import public_tokenizers as files

    key = (files.path(f"{name}.json"), files.path(f"{name}.tiktoken"))
    if key not in _encoders:
        _encoders[key] = Encoder(*key, files.PATTERN)
    return _encoders[key]


@dataclass
class Packer:
    """Fills sequences from a pool of pieces; ``rows`` gathers what is placed."""

    limits: Limits
    pool_size: int
    first_sequence: int
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.caps = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        if min(self.caps) < 1:
            raise ValueError("limits must be positive")
        self.pool: list[list] = []  # doc_id, start, ids, doc_tokens, bears loss
        self.next = self.first_sequence

    def add(self, doc_id: int | None, ids: bytes, loss: bool) -> None:
        n, at = len(ids) // 4, 0
        most = min(self.limits.tokens, self.limits.loss_tokens) if loss else self.limits.tokens
        while n - at > most or (n - at == most == self.limits.tokens):
            piece = [doc_id, at, ids[4 * at : 4 * (at + most)], n, loss]
            at += most
            if most == self.limits.tokens:
                self.close([piece])
            else:
                self.pool.append(piece)
        if at < n:
            self.pool.append([doc_id, at, ids[4 * at :], n, loss])
        if len(self.pool) >= self.pool_size:
            self.fill(self.pool_size // 2)

    def fill(self, keep: int) -> None:
        """Pack until at most ``keep`` pieces wait."""
        pool = self.pool
        tokens = np.array([len(p[2]) // 4 for p in pool], float)
        loss = np.where(np.array([p[4] for p in pool], bool), tokens, 0.0)
        left, caps = len(pool), self.caps
        while left > keep:
            room, bin_ = caps.copy(), []
            while room[0] >= 1 and room[1] >= 1:
                fits = (tokens > 0) & (tokens <= room[0]) & (loss <= room[2])
                weight = room / caps / caps
                gain = np.where(fits, tokens * weight[0] + weight[1] + loss * weight[2], -1.0)
                k = int(gain.argmax()) if left else -1
                if k >= 0 and fits[k]:
                    bin_.append(pool[k])
                    room -= (tokens[k], 1, loss[k])
                    tokens[k] = loss[k] = 0
                    left -= 1
                    continue
                # None fits whole: cut the longest piece that may still give something.
                able = np.where(loss > 0, tokens if room[2] >= 1 else 0, tokens)
                if not left or able.max() < 1:
                    break
                k = int(able.argmax())
                doc_id, start, ids, total, bears = pool[k]
                take = int(min(room[0], room[2]) if bears else room[0])
                bin_.append([doc_id, start, ids[: 4 * take], total, bears])
                pool[k] = [doc_id, start + take, ids[4 * take :], total, bears]
                room -= (take, 1, take if bears else 0)
                tokens[k] -= take
                loss[k] -= take if bears else 0
            self.close(bin_)
        self.pool = [p for p, n in zip(pool, tokens, strict=True) if n > 0]

    def close(self, pieces: list[list]) -> None:
        """Emit one sequence; one that isn't full is emitted as sequences of power-of-two lengths."""
        total = sum(len(p[2]) // 4 for p in pieces)
        room = self.limits.tokens if total == self.limits.tokens else 1 << (total.bit_length() - 1)
        offset = 0
        for doc_id, start, ids, doc_tokens, loss in pieces:
            while ids:
                take = min(room - offset, len(ids) // 4)
                own = ids[: 4 * take]
                self.rows.append((doc_id, start, take, zlib.crc32(own), doc_tokens, self.next, offset, take if loss else 0))
                ids, start, offset, total = ids[4 * take :], start + take, offset + take, total - take
                if offset == room:
                    self.next, offset = self.next + 1, 0
                    room = 1 << (total.bit_length() - 1) if total else 0

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows, strict=True))
            names = [c.split()[0] for c in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            self.rows = []


def pack(
    rows: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bears_loss: Column | None = None,
    end_id: int = 1,
    limits: Limits = Limits(),
    tokenizer: str = "byte_bpe_50k",
    pool_size: int = 512,
) -> DataFrame:
    """Pack every row of ``rows`` into training sequences; one output row per piece.

    A row's tokens are those of its text (null: none), then ``end_id``; ``bears_loss`` says whether they count towards the
    limit on loss-bearing tokens (all do by default; for dialogue turns, say ``role = 'assistant'``). Each token lies in exactly
    one piece. Repeated rows and null ids are packed like any others; an empty table gives no rows; other columns are ignored.
    ``sequence_id`` is unique over the table: the task's number above 40 bits, and a running number below.
    """
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(limits, pool_size, TaskContext.get().partitionId() << 40)
        for batch in sliced(batches):
            for doc_id, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer.add(doc_id, encode(text or "") + end, bool(loss))
                if len(packer.rows) >= 20_000:
                    yield from packer.drain()
        packer.fill(0)
        yield from packer.drain()
        encode.forget()
        give_back()

    loss = F.lit(True) if bears_loss is None else F.coalesce(bears_loss, F.lit(False))
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), loss.alias("loss")).mapInArrow(work, OUT)
