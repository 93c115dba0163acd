"""Quality scores by positive-unlabelled learning.

Training sees trusted good documents and unlabelled ones, never a bad label. A first network tells the trusted from the
unlabelled; on rows it hasn't seen, the share of the unlabelled above a cutoff over that of the trusted bounds the class prior from
above, and the best bound over all cutoffs estimates it. A second network then minimises the non-negative unbiased risk under
that prior: prior x loss of the trusted as good + max(0, loss of the unlabelled as bad - prior x loss of the trusted as bad).
Both read a short vector of features of the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from skytally.llm.common import fold_of, give_back, mapped, sliced

#: Rows that training reads at most.
TRUSTED_ROWS, UNLABELLED_ROWS = 4000, 8000
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "#*$%&", "|<>", "(){}[]\"'", "-_/\\=+@^~`")
_GROUP_OF = np.zeros((256, len(_GROUPS) + 1), np.float32)
for _k, _g in enumerate(_GROUPS):
    for _c in _g.encode():
        _GROUP_OF[_c, _k] = 1
_GROUP_OF[128:, -1] = 1
N_FEATURES = len(_GROUPS) + 1 + 14


def features(text: str | None) -> np.ndarray:
    """Of the whole text; square roots of shares, so that small shares count. An empty text has zeros but for its length."""
    text = text or ""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(data, minlength=256).astype(np.float32)
    shares = counts / len(data)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, g = max(1, len(words)), len(_GROUPS) + 1
    out[:g] = np.sqrt(shares @ _GROUP_OF)
    used = shares[shares > 0]
    common = Counter(words)
    sizes = np.array([len(w) for w in words] or [0], np.float32)
    same = sum(map(str.__eq__, words, words[1:]))
    marked = sum(1 for w in words if not w[-1].isalnum())
    ends = sum(1 for x in lines if x.rstrip()[-1:] in ".!?:;\"»”")
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    out[g:] = (
        log(1 + len(words)) / 8, log(1 + len(lines)) / 5, sizes.mean() / 8, sizes.std() / 8, sqrt(len(common) / n), sqrt(max(common.values(), default=0) / n), sqrt(same / n),
        sqrt(marked / n), sqrt(1 - len(set(lines)) / max(1, len(lines))), sqrt(ends / max(1, len(lines))), sqrt(sum(map(str.isupper, words)) / n),
        sqrt(sum(map(str.istitle, words)) / n), float(-(used * np.log(used)).sum()) / 4, sqrt(letters / len(data)),
    )
    return out


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.p = [rng.standard_normal((len(mean), hidden)) / sqrt(len(mean)), np.zeros(hidden), rng.standard_normal(hidden) / sqrt(hidden), np.zeros(1)]

    def logit(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(z @ self.p[0] + self.p[1])
        if keep is not None:
            keep += [z, h]
        return h @ self.p[2] + self.p[3]

    def grads(self, keep: list, d: np.ndarray) -> list[np.ndarray]:
        z, h = keep
        dh = d[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def descend(net: Network, trusted: np.ndarray, unlabelled: np.ndarray, prior: float | None, rounds: int, seed: int = 7, rate: float = 0.01, ridge: float = 1e-4) -> Network:
    """Adam on the non-negative risk under ``prior``; without one, on telling trusted from unlabelled rows."""
    rng, step = np.random.default_rng(seed), 0
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    parts = max(1, (len(trusted) + len(unlabelled)) // 512)
    for _ in range(rounds):
        for a, b in zip(np.array_split(rng.permutation(len(trusted)), parts), np.array_split(rng.permutation(len(unlabelled)), parts), strict=True):
            if not len(a) or not len(b):
                continue
            kp, ku = [], []
            gp, gu = net.logit(trusted[a], kp), net.logit(unlabelled[b], ku)
            up, uu = (sigmoid(gp) - 1) / len(a), sigmoid(gu) / len(b)  # of the losses as good, as bad
            if prior is None:
                dp, du = up, uu
            else:
                bad = softplus(gu).mean() - prior * softplus(gp).mean()
                if bad >= 0:
                    dp, du = prior * up - prior * sigmoid(gp) / len(a), uu
                else:  # the bad part has gone below zero: undo it
                    dp, du = prior * sigmoid(gp) / len(a), -uu
            g = [x + y + ridge * p for x, y, p in zip(net.grads(kp, dp), net.grads(ku, du), net.p, strict=True)]
            step += 1
            for k in range(4):
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def estimated_prior(trusted: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """Best bound over cutoffs from scores of rows not trained on: share of the unlabelled above over that of the trusted.

    Each share's uncertainty (Hoeffding, at ``risk``) enters the choice of the cutoff, not the estimate.
    """
    su, st = np.sort(unlabelled)[::-1], np.sort(trusted)[::-1]
    cutoffs = np.unique(np.concatenate([su, st]))
    qu = np.searchsorted(-su, -cutoffs, "right") / len(su)
    qt = np.searchsorted(-st, -cutoffs, "right") / len(st)
    slack = sqrt(log(4 / risk) / (2 * len(su))) + sqrt(log(4 / risk) / (2 * len(st)))
    ok = qt > 0.05
    bound = np.where(ok, (qu + slack) / np.maximum(qt, 1e-9), np.inf)
    k = int(np.argmin(bound))
    return float(np.clip(qu[k] / max(qt[k], 1e-9), 0.01, 0.999))


def train(trusted: np.ndarray, unlabelled: np.ndarray, rounds: int = 60, seed: int = 5) -> tuple[Network, float] | None:
    """The fitted network and the prior; None without rows of either kind."""
    if not len(trusted) or not len(unlabelled):
        return None
    both = np.concatenate([trusted, unlabelled])
    mean, spread = both.mean(0), both.std(0) + 1e-3
    first = descend(Network(mean, spread, seed=seed), trusted[::2], unlabelled[::2], None, rounds)
    rest = (trusted[1::2], unlabelled[1::2]) if len(trusted) > 1 and len(unlabelled) > 1 else (trusted, unlabelled)
    prior = estimated_prior(first.logit(rest[0]), first.logit(rest[1]))
    return descend(Network(mean, spread, seed=seed), trusted, unlabelled, prior, rounds), prior


def feature_rows(docs: DataFrame, text_col: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float32()))], ["x"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(work, "x array<float>")


def fitted(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[Network, float] | None:
    """Trained from the features of bounded samples outside the held-out fold: ids are chosen by hash and broadcast, no text leaves the executors.

    The trusted are documents with label 1; the unlabelled are any documents, their labels unread.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text")).where("i IS NOT NULL")
    free = fold_of(F.col("i"), folds) != held
    good = labels.where(F.col(label_col) == 1).select(F.col("doc_id").cast("long").alias("i")).where("i IS NOT NULL").where(free).distinct()

    def rows(ids: DataFrame, n: int) -> np.ndarray:
        chosen = ids.orderBy(F.xxhash64("i"), "i").limit(n)
        found = feature_rows(texts.join(F.broadcast(chosen), "i", "left_semi"), "text").limit(2 * n).collect()
        return np.array(sorted(r["x"] for r in found), np.float64).reshape(-1, N_FEATURES)

    shuffled = np.random.default_rng(1).permutation
    trusted, unlabelled = rows(good, TRUSTED_ROWS), rows(texts.where(free).select("i"), UNLABELLED_ROWS)
    return train(trusted[shuffled(len(trusted))], unlabelled[shuffled(len(unlabelled))])


def score(docs: DataFrame, net: Network | None, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with each whole text's score from 0 to 1; null and empty texts are scored alike. Without a network all have 0.5.

    Rows (repeated ones too), nulls and other columns stay as they are; an empty table stays empty; ``into`` must be a new name.
    """
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    if net is None:
        return docs.withColumn(into, F.lit(0.5))
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            x = np.array([features(t) for t in texts], np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(net.logit(x)), pa.float64())], [*batch.schema.names, into])
        give_back()

    return mapped(docs, work, [*docs.schema.fields, StructField(into, DoubleType())])
