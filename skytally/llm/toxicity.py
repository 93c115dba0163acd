"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words; every window is scored and the document's score is the largest. A word's input
is its own vector, if it was met in training, beside the mean of its hashed character trigrams, which any word has. One gated
unit reads the window forwards and one backwards; attention weighs their states into one vector, from which a logistic unit
scores. Training knows the labels of documents only: of a toxic document the window that scores highest counts as toxic (at first
the one with the most telling word), and every window of the others as clean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from skytally.llm.common import give_back, labelled_sample, mapped, sliced

WINDOW, STRIDE = 48, 32
HIDDEN, WORD_SIZE, CHAR_SIZE, CHAR_ROWS = 8, 8, 8, 4096
#: Documents of each label, and characters of each, that training reads at most; words that get a vector.
TRAIN_ROWS, TRAIN_CHARS, VOCABULARY = {1: 600, 0: 1400}, 20_000, 20_000
#: Share of the toxic documents, those that score lowest, that each training round leaves out as mislabelled.
TRIMMED = 0.08
_MARKS = ".,;:!?\"'()[]{}*#$%&|<>~-_/\\¡¿«»“”"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams within each word, its ends marked, and where each word's begin; words may hold any character."""
    marked = [b"\x01" + w.encode() + b"\x02" for w in words]
    data = np.frombuffer(b"".join(marked) + b"\x00\x00", np.uint8).astype(np.uint32)
    code = (data[:-2] * np.uint32(2654435761) ^ data[1:-1] * np.uint32(2246822519) ^ data[2:] * np.uint32(3266489917)) >> np.uint32(7)
    ends = np.cumsum([len(m) for m in marked], dtype=np.int64)
    inside = np.ones(len(code), bool)
    inside[np.concatenate([ends - 1, ends - 2])] = False
    return (code[inside] % CHAR_ROWS).astype(np.int64), np.concatenate([[0], ends - 2 * np.arange(1, len(ends) + 1)]).astype(np.int64)[: len(words)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, scoring and training."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 3):
        rng = np.random.default_rng(seed)
        norm = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.vocabulary, size = vocabulary, WORD_SIZE + CHAR_SIZE
        self.p = {
            "word": norm(len(vocabulary) + 1, WORD_SIZE, by=0.1), "char": norm(CHAR_ROWS, CHAR_SIZE, by=0.1), "wx": norm(size, 6 * HIDDEN, by=0.4), "bx": np.zeros(6 * HIDDEN, np.float32),
            "uf": norm(HIDDEN, 3 * HIDDEN, by=0.3), "ub": norm(HIDDEN, 3 * HIDDEN, by=0.3), "attend": norm(2 * HIDDEN, by=0.3), "out": norm(2 * HIDDEN, by=0.5), "b": np.full(1, -2, np.float32),
        }
        self.p["word"][0] = 0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Vectors of distinct words, and what the gradient needs."""
        stripped = [w.strip(_MARKS) or w for w in words]
        own = np.array([self.vocabulary.get(w, 0) for w in stripped], np.int64)
        code, starts = trigrams(stripped)
        counts = np.diff(np.append(starts, len(code))).astype(np.float32)
        chars = np.add.reduceat(self.p["char"][code], starts) / counts[:, None]
        return np.concatenate([self.p["word"][own], chars], 1), (own, code, counts)

    def projected(self, words: list[str]) -> np.ndarray:
        return self.inputs(words)[0] @ self.p["wx"] + self.p["bx"]

    @staticmethod
    def run(table: np.ndarray, ids: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> list[np.ndarray]:
        """States after each column of ``ids`` (rows of ``table``), in the order given."""
        h, out, n = np.zeros((len(ids), HIDDEN), np.float32), [], HIDDEN
        for t in range(ids.shape[1]):
            a, g = table[ids[:, t]], h @ u
            zr = sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            new = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            m = mask[:, t, None]
            after = (new + z * (h - new)) * m
            if keep is not None:
                keep.append((h, z, r, new, g[:, 2 * n :], m))
            h = after
            out.append(h)
        return out

    def forward(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: ``ids`` (windows, words) are rows of ``table``, ``mask`` is 0 past a window's end."""
        n = HIDDEN
        kf, kb = ([], []) if keep is not None else (None, None)
        fore = self.run(table[:, : 3 * n], ids, mask, self.p["uf"], kf)
        back = self.run(table[:, 3 * n :], ids[:, ::-1], mask[:, ::-1], self.p["ub"], kb)[::-1]
        states = np.concatenate([np.stack(fore, 1), np.stack(back, 1)], 2)
        weight = states @ self.p["attend"] + (mask - 1) * 1e9
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = (weight[:, None, :] @ states)[:, 0]
        if keep is not None:
            keep.update(kf=kf, kb=kb, states=states, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["b"]

    def backward(self, keep: dict, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients from the logits' gradient ``d``; the last two are of the projected inputs, forwards and backwards."""
        states, weight, pooled, n = keep["states"], keep["weight"], keep["pooled"], HIDDEN
        g = {"out": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        dp = d[:, None] * self.p["out"]
        dw = np.einsum("bth,bh->bt", states, dp)
        dl = weight * (dw - (weight * dw).sum(1, keepdims=True))
        g["attend"] = np.einsum("bth,bt->h", states, dl)
        ds = weight[:, :, None] * dp[:, None, :] + dl[:, :, None] * self.p["attend"]
        outs = []
        for u, kept, part in (("uf", keep["kf"], ds[:, :, :n]), ("ub", keep["kb"], ds[:, ::-1, n:])):
            gu, dh, da = np.zeros_like(self.p[u]), np.zeros((len(d), n), np.float32), [None] * len(kept)
            for t in range(len(kept) - 1, -1, -1):
                h, z, r, new, gn, m = kept[t]
                dh = (dh + part[:, t]) * m
                dn = dh * (1 - z) * (1 - new * new)
                dz, dr = dh * (h - new) * z * (1 - z), dn * gn * r * (1 - r)
                da[t] = np.concatenate([dz, dr, dn], 1)
                dg = np.concatenate([dz, dr, dn * r], 1)
                gu += h.T @ dg
                dh = dh * z + dg @ self.p[u].T
            g[u] = gu
            outs.append(np.stack(da, 1))
        return g, outs[0], outs[1][:, ::-1]


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of so many words that lie end to end: document, first word, words. All overlap; the last one ends a text."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(counts) - counts
    return doc, begin[doc] + k * STRIDE, np.minimum(WINDOW, counts[doc] - k * STRIDE)


def laid_out(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word ids, and their masks."""
    span = np.arange(int(size.max()))
    mask = span < size[:, None]
    return flat[np.where(mask, first[:, None] + span, 0)], mask.astype(np.float32)


def train(rows: list[tuple[str, int]], rounds: int = 12, seed: int = 3, rate: float = 0.01) -> Network | None:
    """A network fitted to (text, label) rows; None if they don't hold both labels."""
    texts, labels = [words_of(t) for t, _ in rows], np.array([y for _, y in rows], np.int64)
    keep = [k for k, w in enumerate(texts) if w]
    texts, labels = [texts[k] for k in keep], labels[keep]
    if not len(labels) or labels.min() == labels.max():
        return None
    rng, counted = np.random.default_rng(seed), {0: Counter(), 1: Counter()}
    for words, y in zip(texts, labels, strict=True):
        counted[y].update({w.strip(_MARKS) or w for w in words})
    n1, n0 = labels.sum(), (1 - labels).sum()
    least = 2 + len(labels) // 500
    odds = {w: np.log((counted[1][w] + 0.5) / (n1 + 1)) - np.log((counted[0][w] + 0.5) / (n0 + 1)) for w in counted[0] | counted[1] if counted[0][w] + counted[1][w] >= least}
    chosen = sorted(odds, key=lambda w: (-abs(odds[w]) * np.sqrt(counted[0][w] + counted[1][w]), w))[:VOCABULARY]
    net = Network({w: k + 1 for k, w in enumerate(chosen)}, seed)
    net.p["word"][1:, 0] = [np.clip(odds[w] / 3, -1, 2) for w in chosen]

    distinct: dict[str, int] = {}
    flat = np.array([distinct.setdefault(w, len(distinct)) for words in texts for w in words], np.int64)
    names = list(distinct)
    telling = np.array([odds.get(w.strip(_MARKS) or w, 0.0) * np.log1p(counted[1][w.strip(_MARKS) or w]) for w in names])
    doc, first, size = windows_of(np.array([len(w) for w in texts]))
    del texts, counted
    ids, mask = laid_out(flat, first, size)
    best = np.where(mask > 0, telling[ids], -9).max(1)
    clean = np.flatnonzero(labels[doc] == 0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def top_of(score: np.ndarray) -> np.ndarray:
        order = np.lexsort((score, doc))
        last = np.append(np.flatnonzero(np.diff(doc[order])), len(order) - 1)
        return np.array([w for w in order[last] if labels[doc[w]]], np.int64)

    for r in range(rounds):
        if r >= 3:
            table = net.projected(names)
            best = np.concatenate([net.forward(table, ids[k : k + 2048], mask[k : k + 2048]) for k in range(0, len(ids), 2048)])
        toxic = top_of(best)
        toxic = toxic[np.argsort(-best[toxic], kind="stable")][: max(1, round((1 - TRIMMED) * len(toxic)))]
        hard = clean[np.argsort(-best[clean], kind="stable")[: 2 * len(toxic)]] if r >= 3 else clean[:0]
        others = rng.choice(clean, min(len(clean), 4 * len(toxic)), replace=False)
        # Clean words over and over are clean too: without such windows one slightly suspect word, repeated, would add up.
        said = rng.choice(ids[others][mask[others] > 0], 2 * len(toxic))
        all_ids, all_mask = np.concatenate([ids, np.repeat(said[:, None], ids.shape[1], 1)]), np.concatenate([mask, np.ones((len(said), ids.shape[1]), np.float32)])
        all_y = np.concatenate([labels[doc], np.zeros(len(said), np.int64)])
        used = rng.permutation(np.concatenate([toxic, hard, others, len(ids) + np.arange(len(said))]))
        for part in np.array_split(used, max(1, len(used) // 128)):
            own, inverse = np.unique(all_ids[part], return_inverse=True)
            x, (word, code, counts) = net.inputs([names[k] for k in own])
            kept: dict = {}
            y = all_y[part]
            logit = net.forward(x @ net.p["wx"] + net.p["bx"], inverse.reshape(len(part), -1), all_mask[part], kept)
            weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
            g, df, db = net.backward(kept, ((sigmoid(logit) - y) * weight).astype(np.float32))
            da = np.concatenate([df, db], 2).reshape(-1, 6 * HIDDEN) * all_mask[part].reshape(-1, 1)
            sums = np.zeros((len(own), 6 * HIDDEN), np.float32)
            np.add.at(sums, inverse.reshape(-1), da)
            g["wx"], g["bx"], dx = x.T @ sums, sums.sum(0), sums @ net.p["wx"].T
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], word, dx[:, :WORD_SIZE])
            np.add.at(g["char"], code, np.repeat(dx[:, WORD_SIZE:] / counts[:, None], counts.astype(int), 0))
            g["word"][0] = 0
            step += 1
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores texts by blocks of ``CHARS`` characters, with a table of the inputs of at most ``WORDS`` words met before a block."""

    WORDS, WINDOWS, CHARS = 120_000, 2048, 300_000

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        got = list(map(rows.get, words))
        if new := {w for w, k in zip(words, got, strict=True) if k is None}:
            fresh = sorted(new)
            need = len(rows) + len(fresh)
            if need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), 6 * HIDDEN), np.float32)])
            self.table[len(rows) : need] = self.net.projected(fresh)
            rows.update(zip(fresh, range(len(rows), need), strict=True))
            got = [rows[w] if k is None else k for w, k in zip(words, got, strict=True)]
        return np.array(got, np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Largest window score of each text; 0 for those without words."""
        out, k = np.zeros(len(texts)), 0
        while k < len(texts):
            if len(self.rows) > self.WORDS:
                self.clear()
            j, chars = k, 0
            while j < len(texts) and (j == k or chars + len(texts[j] or "") <= self.CHARS):
                chars += len(texts[j] or "")
                j += 1
            words = [words_of(t) for t in texts[k:j]]
            doc, first, size = windows_of(np.array([len(w) for w in words]))
            if len(doc):
                flat = self.ids([w for ws in words for w in ws])
                for part in np.array_split(np.argsort(size, kind="stable"), -(-len(doc) // self.WINDOWS)):
                    logit = self.net.forward(self.table, *laid_out(flat, first[part], size[part]))
                    np.maximum.at(out, k + doc[part], sigmoid(logit.astype(float)))
            k = j
        return out


def fitted(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0) -> Network | None:
    """A network trained on the driver from a bounded sample (``TRAIN_ROWS``, ``TRAIN_CHARS``) of labelled documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, "toxic", folds=folds, held=held, rows=TRAIN_ROWS, max_chars=TRAIN_CHARS).collect()
    net = train(sorted((r["text"], r["label"]) for r in rows))
    del rows
    give_back()  # the driver, too, lives on
    return net


def score(docs: DataFrame, net: Network | None, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with each whole text's score from 0 to 1; null, empty and blank texts have 0, as has everything without a network.

    Rows (repeated ones too), nulls and other columns stay as they are; an empty table stays empty; ``into`` must be a new name.
    Long texts are scored whole, by all windows. Words may hold any character. A task's tables go with it.
    """
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    if net is None:
        return docs.withColumn(into, F.lit(0.0))

    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.scores(texts), pa.float64())], [*batch.schema.names, into])
        del scorer
        give_back()

    return mapped(docs, work, [*docs.schema.fields, StructField(into, DoubleType())])
