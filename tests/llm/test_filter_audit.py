"""Scans against regular expressions, audits against a brute-force run of every order."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skytally.llm import filter_audit as fa


def plainly(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)]


def noise(rng, n):
    return "".join(rng.choice(["a", "B", "ab", "é", "語", "𝕏", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "#", "|", "\x00", "\x85", " "]) for _ in range(n))


TEXTS = [None, "", " ", "a", " a", "a ", "a a", "A" * 50, "\n\n", "x" * 3000, "a b " * 999, " ", "é è é", "|", "w" * 70_000 + " " + "w" * 70_000]


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 1 << 20])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_scan(monkeypatch, piece, kind):
    """Pieces of any length, cut between and within documents; slices of a buffer."""
    monkeypatch.setattr(fa, "PIECE", piece)
    fa._powers.cache_clear()
    rng = random.Random(piece)
    texts = (TEXTS if piece >= 64 else TEXTS[:8]) + [noise(rng, rng.randrange(60)) for _ in range(60)]
    array = pa.array(["skipped", *texts], kind)
    assert fa.scan(array.slice(1)).tolist() == [plainly(t) for t in texts]
    assert fa.scan(array.slice(2, 0)).tolist() == [] and fa.scan(pa.array([None, ""], kind)).tolist() == [[0] * 5] * 2
    fa._powers.cache_clear()


def test_equal_hashes_are_verified(monkeypatch):
    """With one hash for all words, distinct words are still told apart by their bytes."""
    made = fa._words

    def alike(*args):
        h, start, end, doc = made(*args)
        return np.zeros_like(h), start, end, doc

    monkeypatch.setattr(fa, "_words", alike)
    texts = ["a b a b a", "a", "", "ab ba ab", "b a b a c c a"]
    assert fa.scan(pa.array(texts)).tolist() == [plainly(t) for t in texts]


def brute(rows, labels):
    good, bad = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = {}
    for part in {p or "" for _, _, p in rows}:
        docs = []
        for i, t, p in rows:
            if (p or "") == part:
                n, different, capitals, symbols, chars = plainly(t)
                failed = {"A": n < 200, "B": 100 * different < 50 * n, "C": 100 * capitals > 2 * chars, "D": symbols > 0, "E": i is not None and i > first[t or ""]}
                docs.append((i, {k for k, v in failed.items() if v}))
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[f] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), sum(f in d[1] for d in docs) - len(lost), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in lost), sum(d[0] in bad for d in lost), f]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shares[out[key][-1]]
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("part", "mask", "key", "first", "good", "n", "m", "bit", "step", "kept")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = fa.audit(docs.repartition(3), known).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_audit(spark):
    """Copies across parts, repeated rows, null ids, texts and parts, several labels of one id, columns with clashing names."""
    rng = random.Random(2)
    long = [" ".join(f"w{rng.randrange(k)}" for _ in range(250)) for k in (40, 400, 4000)]
    texts = [None, "", "Short Text", "a | b", *long, long[1] + " |", long[2].upper(), long[1] + " HELLO" * 20]
    rows = [(None if k % 17 == 5 else k - k % 19 % 2, rng.choice(texts), rng.choice([None, "", "s", "s", "t"])) for k in range(160)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(120)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, None, None)], []) == brute([(1, None, None)], [])


def test_sql(spark, tables, duck, same):
    from skytally.llm.registry import op11_filter_audit

    same(op11_filter_audit(spark, tables), duck, fa.ORACLE_SQL)
