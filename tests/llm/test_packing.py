import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as files
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skytally.llm import packing


def check(rows, texts, limits=packing.Limits()):
    """Pieces tile every row, ids are the tokenizer's, sequences are gapless, within limits and little padded."""
    whole = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    of, by = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        by[r.sequence_id].append(r)
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert set(of) == set(ids)
    for i, pieces in of.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss_tokens
        assert at == limits.tokens or at & (at - 1) == 0
    return by


def test_documents(documents):
    check(packing.pack(documents).collect(), {r.doc_id: r.text for r in documents.collect()})


def test_edges(docs_of):
    texts = ["", None, "a", "  two  spaces   three\n\n x", "<|endoftext|> special", "long word " * 4000, "\x00\t\u00a0é ", " lead", "trail ", "it's 12 o'clock\r\n"] + [""] * 150
    check(packing.pack(docs_of(texts)).collect(), dict(enumerate(texts)))


def test_empty_table_null_ids_and_other_columns(docs_of):
    assert packing.pack(docs_of([])).count() == 0
    docs = docs_of(["one two", "one two"], [None, None]).withColumn("length", F.lit(1)).withColumn("start", F.lit(2))
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows) == 2 * 3 and all(r.doc_id is None for r in rows)


def test_limits_on_segments_and_loss(spark):
    texts = {k: "word " * (k % 60) for k in range(400)}
    rows = spark.createDataFrame([(k, t, "assistant" if k % 3 else "user") for k, t in texts.items()], "doc_id long, text string, role string")
    limits = packing.Limits(tokens=256, segments=5, loss_tokens=100)
    got = packing.pack(rows, bears_loss=F.col("role") == "assistant", limits=limits).collect()
    check(got, texts, limits)
    assert all(r.loss_tokens == (r.length if r.doc_id % 3 else 0) for r in got)


def test_bad_limits():
    with pytest.raises(ValueError):
        packing.Packer(packing.Limits(tokens=0), 4, 0)


def placements(pieces, limits):
    """The rule stated plainly, for pieces that need no cutting: of those that fit, the largest dot product of demand and room, both as shares of the limits; then the next sequence."""
    waiting, out = list(enumerate(pieces)), []
    while waiting:
        room, own = [limits.tokens, limits.segments, limits.loss_tokens], []
        while True:
            fit = [(k, (n, 1, n if loss else 0)) for k, (n, loss) in waiting if n <= room[0] and 1 <= room[1] and (not loss or n <= room[2])]
            if not fit:
                break
            caps = (limits.tokens, limits.segments, limits.loss_tokens)
            k, d = max(fit, key=lambda f: (round(sum(x * r / c / c for x, r, c in zip(f[1], room, caps, strict=True)), 12), -f[0]))
            own.append(k)
            room = [r - x for r, x in zip(room, d, strict=True)]
            waiting = [w for w in waiting if w[0] != k]
        out.append(own)
    return out


def test_placements_are_the_dot_product_choices():
    """Segments bind in the first case, loss in the second: room may be left on tokens, and nothing fits that waits."""
    import random

    for limits, seed in ((packing.Limits(64, 3, 64), 1), (packing.Limits(64, 64, 16), 2), (packing.Limits(64, 4, 24), 3)):
        rng = random.Random(seed)
        pieces = [(rng.randint(9, 15), rng.random() < 0.6) for _ in range(20)]
        packer = packing.Packer(limits, 1000, 0)
        for k, (n, loss) in enumerate(pieces):
            packer.add(k, np.arange(n, dtype="<u4").tobytes(), loss)
        first = placements(pieces, limits)[0]
        packer.fill(len(pieces) - len(first))
        got = list(dict.fromkeys(r[0] for r in packer.rows))
        assert got[: len(first)] == first


def test_dialogue_turns_under_binding_limits(spark):
    """Conversations: only what the assistant says bears loss, and both other limits bind."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("key", F.xxhash64("conv_id", "turn"))
    limits = packing.Limits(tokens=2048, segments=24, loss_tokens=512)
    rows = packing.pack(turns, id_col="key", bears_loss=F.col("role") == "assistant", limits=limits).collect()
    by = check(rows, {r.key: r.text for r in turns.select("key", "text").collect()}, limits)
    sums = [(len(p), sum(r.loss_tokens for r in p)) for p in by.values()]
    assert max(s for s, _ in sums) == 24 or max(x for _, x in sums) == 512
