import random

import numpy as np
from pyspark.sql import functions as F

from skytally.llm import quality_pu, toxicity
from skytally.llm.common import fold_of, labelled_sample, table

SF = "/root/testdata/sf0.01"


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(9)]
    net = toxicity.Network({w: k + 1 for k, w in enumerate(words)})
    net.p = {k: rng.standard_normal(v.shape) * 0.5 for k, v in net.p.items()}
    ids, mask = rng.integers(0, 9, (3, 5)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)

    def loss(kept=None):
        x, _ = net.inputs(words)
        return net.forward(x @ net.p["wx"] + net.p["bx"], ids, mask, kept).sum()

    kept = {}
    loss(kept)
    g, *_ = net.backward(kept, np.ones(3))
    for name in ("uf", "ub", "attend", "out"):
        flat = net.p[name].reshape(-1)
        for k in rng.choice(len(flat), 5):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[k]) < 2e-2 * max(1, abs(g[name].reshape(-1)[k]))


def test_windows_cover_and_overlap():
    doc, first, size = toxicity.windows_of(np.array([0, 1, 48, 49, 300]))
    assert 0 not in doc
    for d, n, begin in ((1, 1, 0), (2, 48, 1), (3, 49, 49), (4, 300, 98)):
        mine = [(f - begin, f - begin + s) for x, f, s in zip(doc, first, size, strict=True) if x == d]
        assert mine[0][0] == 0 and mine[-1][1] == n and all(a[1] > b[0] and a[0] < b[0] for a, b in zip(mine, mine[1:], strict=False))


def planted(n, seed):
    rng, rows = random.Random(seed), []
    for k in range(n):
        words = [rng.choice(["la", "to", "mi", "ran", "ou", "ster"]) + rng.choice(["n", "s", "t", ""]) for _ in range(rng.randint(20, 200))]
        if k % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "Rotten,", "GHASTLY"])
        rows.append((" ".join(words), int(k % 3 == 0)))
    return rows


def test_toxicity_held_out_accuracy_and_place():
    net = toxicity.train(planted(300, 1), rounds=6)
    scorer, rows = toxicity.Scorer(net), planted(150, 2)
    got = scorer.scores([t for t, _ in rows])
    assert np.mean((got >= 0.5) == np.array([y for _, y in rows])) > 0.95
    clean = " ".join(["la ton mis"] * 3000)
    assert scorer.scores([clean])[0] < 0.5 <= scorer.scores([clean + " vile rotten"])[0]
    assert list(scorer.scores([None, "", " \n", "la"])[:3]) == [0, 0, 0]
    assert toxicity.train([("a", 1)]) is None and toxicity.train([]) is None


def test_toxicity_scores_in_spark(spark, docs_of):
    net = toxicity.train(planted(120, 1), rounds=3)
    docs = docs_of(["vile rotten ghastly", None, "", "la to mi"]).withColumn("label", F.lit("clash"))
    out = toxicity.score(docs, net).orderBy("doc_id").collect()
    assert out[1].score == out[2].score == 0 and 0 <= out[0].score <= 1 and out[0].label == "clash"
    assert toxicity.score(docs.limit(0), net).count() == 0 and toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0


def test_sample_leaves_the_fold_out(spark, docs_of):
    docs = docs_of([f"t{k}" for k in range(40)] + ["x" * 100, None], [*range(40), 40, None])
    labels = spark.createDataFrame([(k, k % 2) for k in range(41)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", folds=5, held=0, rows={1: 7, 0: 100}, max_chars=50).collect()
    held = {r.doc_id for r in docs.where(fold_of(F.col("doc_id"), 5) == 0).collect()}
    assert sum(r.label for r in rows) == 7 and not {int(r.text[1:]) for r in rows} & held


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, 4)), rng.normal(-2, 1, (900, 4))
    unlabelled = np.concatenate([rng.normal(1, 1, (2100, 4)), bad])
    net, prior = quality_pu.train(good, unlabelled[rng.permutation(3000)])
    assert abs(prior - 0.7) < 0.07
    fresh = np.concatenate([rng.normal(1, 1, (500, 4)), rng.normal(-2, 1, (500, 4))])
    assert np.mean((net.logit(fresh) > 0) == (np.arange(1000) < 500)) > 0.97
    assert quality_pu.train(np.zeros((0, 4)), unlabelled) is None


def test_quality_features():
    for text in (None, "", " ", "\n\n", "é", "x" * 100_000, "#### !!!!"):
        x = quality_pu.features(text)
        assert x.shape == (quality_pu.N_FEATURES,) and np.isfinite(x).all()


def test_quality_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    net, prior = quality_pu.fitted(docs, labels)
    held = quality_pu.score(docs, net).join(labels, "doc_id").where(fold_of(F.col("doc_id"), 4) == 2)
    rows = held.select("score", "quality").collect()
    assert 0.6 < prior < 1 and np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) > 0.93


def test_quality_edges(spark, docs_of):
    docs = docs_of(["", None, "some words here", "some words here"]).withColumn("x", F.lit(1))
    net, _ = quality_pu.train(np.random.default_rng(0).normal(0, 1, (50, quality_pu.N_FEATURES)), np.random.default_rng(1).normal(0, 1, (50, quality_pu.N_FEATURES)))
    rows = quality_pu.score(docs, net).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score and rows[2].score == rows[3].score
    assert quality_pu.score(docs.limit(0), net).count() == 0 and quality_pu.score(docs, None).first().score == 0.5
    assert quality_pu.fitted(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")) is None


def slow_toxicity(net, text):
    """The definition, word by word: windows of 48 words every 32, both directions, attention, the largest sigmoid."""
    words, best, n = (text or "").lower().split(), 0.0, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    for first in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if words else ():
        vectors = []
        for w in words[first : first + toxicity.WINDOW]:
            w = w.strip(toxicity._MARKS) or w
            data = [1, *w.encode(), 2]
            codes = [((a * 2654435761 ^ b * 2246822519 ^ c * 3266489917) % 2**32 >> 7) % toxicity.CHAR_ROWS for a, b, c in zip(data, data[1:], data[2:], strict=False)]
            vectors.append(np.concatenate([net.p["word"][net.vocabulary.get(w, 0)], np.mean([net.p["char"][k] for k in codes], 0)]))
        states = []
        for u, part, order in (("uf", slice(0, 3 * n), 1), ("ub", slice(3 * n, 6 * n), -1)):
            h, out = np.zeros(n), []
            for x in vectors[::order]:
                a, g = (x @ net.p["wx"] + net.p["bx"])[part], h @ net.p[u]
                z, r = sig(a[:n] + g[:n]), sig(a[n : 2 * n] + g[n : 2 * n])
                h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :])
                out.append(h)
            states.append(out[::order])
        both = np.concatenate([np.array(states[0]), np.array(states[1])], 1)
        weight = np.exp(both @ net.p["attend"])
        best = max(best, float(sig(weight / weight.sum() @ both @ net.p["out"] + net.p["b"])[0]))
    return best


def test_toxicity_query_by_brute_force(spark):
    """The registered query's scores against the definition, one word at a time."""
    docs = table(spark, SF, "documents")
    net = toxicity.fitted(docs, table(spark, SF, "labels"))
    some = {r.doc_id: r.text for r in docs.where("length(text) < 3000").orderBy(F.xxhash64("doc_id")).limit(25).collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs.where(F.col("doc_id").isin(list(some))), net).collect()}
    assert all(abs(got[i] - slow_toxicity(net, t)) < 1e-4 for i, t in some.items())


def test_quality_query_by_brute_force(spark):
    """The registered query's scores against features written out by hand for the shares, and the network's sums one by one."""
    docs = table(spark, SF, "documents")
    net, _ = quality_pu.fitted(docs, table(spark, SF, "labels"))
    for r in quality_pu.score(docs.orderBy(F.xxhash64("doc_id")).limit(40), net).collect():
        x, data = quality_pu.features(r.text), (r.text or "").encode()
        for k, group in enumerate(quality_pu._GROUPS):
            assert abs(x[k] - (sum(chr(b) in group for b in data if b < 128) / max(1, len(data))) ** 0.5) < 1e-5
        z = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(x.astype(float), net.mean, net.spread, strict=True)]
        hidden = [np.tanh(sum(z[i] * net.p[0][i, j] for i in range(len(z))) + net.p[1][j]) for j in range(len(net.p[1]))]
        assert abs(r.score - 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) + net.p[3][0])))) < 1e-6
