import random
import re

import pytest
from pyspark.sql import functions as F

from skytally.llm import near_dedup
from skytally.llm.components import components

LOWER = str.maketrans(near_dedup.UPPER, near_dedup.LOWER)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(texts, size, percent=80):
    sets, root = {i: shingles(t, size) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(docs, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, **more).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_documents(documents, size):
    assert found(documents, words=size) == brute({r.doc_id: r.text for r in documents.collect()}, size)


def test_chains_of_copies(docs_of):
    """Copies of copies, each a little further away, and short texts at the threshold."""
    rng = random.Random(4)
    texts, base = [], [f"w{k}" for k in range(120)]
    for _ in range(40):
        base = list(base)
        for _ in range(3):
            base[rng.randrange(len(base))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(base))
    for n in (1, 2, 4, 5, 6, 7, 11):
        words = [f"s{n}x{k}" for k in range(n)]
        texts += [" ".join(words), " ".join(words).upper(), " ".join([*words, "more"]), " ".join(words[1:])]
    texts += ["", None, " \t\n", "", "one", "ONE"]
    assert found(docs_of(texts), words=2) == brute(dict(enumerate(texts)), 2)


def test_small_sketches_agree(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert found(documents, words=2, k=64) == brute(texts, 2)


def test_null_and_repeated_ids(docs_of):
    docs = docs_of(["a b c d e f", "a b c d e f", "a b c d e f", "a b c d e f"], [None, 7, 7, 9]).withColumn("component_id", F.lit(1)).withColumn("node", F.lit(2))
    rows = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, words=2).collect())
    assert rows == [("7", 7, True), ("7", 7, True), ("9", 7, False), ("None", None, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(docs_of):
    docs = docs_of(["a b c d e f g"] * 3 + ["other words here and more of them", None], [5, 3, 4, 6, 8])
    out = near_dedup.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [3, 6, 8]


def test_bounds():
    assert near_dedup.shared_at_least(48, 0.8) == 19 and near_dedup.neighbours_at_least(96, 0.8) == 23
    from math import comb

    assert sum(comb(96, j) * 0.8**j * 0.2 ** (96 - j) for j in range(near_dedup.shared_at_least(96, 0.8))) <= near_dedup.MISS


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root) if find(x) != x}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_of_large_groups_are_dealt(docs_of, monkeypatch):
    """With every hub counted as hot the groups are the same."""
    monkeypatch.setattr(near_dedup, "HOT", 1)
    rng, base, texts = random.Random(11), [f"w{k}" for k in range(150)], []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"x{j}y{k}" for k in range(30)) for j in range(5)]
    assert found(docs_of(texts), words=2) == brute(dict(enumerate(texts)), 2)
