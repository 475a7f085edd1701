"""Quality scores by positive-unlabelled learning (non-negative risk).

Trusted positives are documents labelled 1; unlabelled documents stand for the web. A first
classifier of positive against unlabelled gives a class prior: the smallest ratio, over score
thresholds, of the unlabelled to the positive share above it (with a confidence margin, on rows
not used to fit it). A small network then minimises
prior * R(P, +) + max(0, R(U, -) - prior * R(P, -)) with the logistic loss, so its sigmoid is the
probability of label 1. Inputs are statistics of the whole text; never its id, source or labels.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateflow.llm import common, rows

_BYTES = np.arange(256)


def _among(marks: bytes) -> np.ndarray:
    return np.isin(_BYTES, np.frombuffer(marks, dtype=np.uint8))


_CLASSES = np.stack([
    _among(b"#$%&*^~@+=<>{}[]\\/_`"),
    _BYTES == ord("!"),
    _BYTES == ord("|"),
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 48) & (_BYTES <= 57),
    _among(b".,;:?"),
    _BYTES == 10,
    _BYTES >= 128,
]).astype(float)

N_FEATURES = len(_CLASSES) + 9


def features(text: bytes) -> np.ndarray:
    """Statistics of a whole text; an empty text gives zeros."""
    out = np.zeros(N_FEATURES)
    words = text.split()
    if not words:
        return out
    n = len(words)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    k = len(_CLASSES)
    out[:k] = np.sqrt((_CLASSES @ counts) / len(text))
    freq = Counter(words)
    lines = text.split(b"\n")
    out[k] = np.log1p(n) / 10
    out[k + 1] = len(freq) / n
    out[k + 2] = np.log(len(freq) + 1) / np.log(n + 1)
    out[k + 3] = sum(map(eq, words, words[1:])) / n
    out[k + 4] = max(freq.values()) / n
    out[k + 5] = len(text) / n / 10
    out[k + 6] = len(set(lines)) / len(lines)
    out[k + 7] = np.log1p(n / len(lines)) / 5
    out[k + 8] = min(n, 20) / 20
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x)) if len(x) else np.empty(0)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * g))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 24, steps: int = 1500, batch: int = 512, rate: float = 5e-3, seed: int = 0) -> Network:
    """The network of least non-negative risk; ``prior`` None fits positive against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-2, rng.normal(0, 0.3, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), batch)]
        u = unlabelled[rng.integers(0, len(unlabelled), batch)]
        x = np.clip((np.concatenate([p, u]) - net.mean) / net.scale, -6, 6)
        h = np.tanh(x @ params[0] + params[1])
        g = h @ params[2] + params[3][0]
        s = _sigmoid(g)
        up, down = (s - 1) / batch, s / batch  # derivatives of the losses of + and of -
        d = np.empty(2 * batch)
        if prior is None:
            d[:batch], d[batch:] = up[:batch], down[batch:]
        else:
            negative = np.logaddexp(0, g[batch:]).mean() - prior * np.logaddexp(0, g[:batch]).mean()
            if negative >= 0:
                d[:batch] = prior * (up[:batch] - down[:batch])
                d[batch:] = down[batch:]
            else:  # undo the overfit part of the negative risk only
                d[:batch] = prior * down[:batch]
                d[batch:] = -down[batch:]
        back = np.outer(d, params[2]) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
        for q, gr, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (gr - m)
            v += 0.001 * (gr * gr - v)
            q -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from a positive-against-unlabelled classifier."""
    net = fit(positive[::2], unlabelled[::2], None, steps=600)
    p, u = np.sort(net.logits(positive[1::2])), np.sort(net.logits(unlabelled[1::2]))
    above_p = 1 - np.searchsorted(p, p) / len(p)
    above_u = 1 - np.searchsorted(u, p) / len(u)
    margin = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
    best = int(((above_u + margin) / above_p).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


FEATURES = "x ARRAY<DOUBLE>"


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in common.utf8(batch, "text")]).reshape(-1, N_FEATURES)


def _sampled(docs: DataFrame, limit: int) -> np.ndarray:
    chosen = rows.sample(docs.select("doc_id", "text"), limit)
    found = rows.annotate(chosen.select("doc_id", "text"), {"text": F.col("text")}, FEATURES, lambda b: {"x": list(_features(b))})
    return np.array([r["x"] for r in found.select("x").collect()]).reshape(-1, N_FEATURES)  # at most `limit` rows


def learn(docs: DataFrame, labels: DataFrame, limit: int = 10_000) -> Network | None:
    """Learn from at most ``limit`` positives and ``limit`` unlabelled documents.

    Only rows whose id checksum modulo 5 is not 0 are used. A doc_id labelled both 1 and 0 is not
    trusted; null ids and labels are ignored. Without any positive there is no model (None).
    """
    usable = F.coalesce(common.remainder("doc_id", 5) != 0, F.lit(False))
    marked = labels.where(usable).groupBy("doc_id").agg(F.min("quality").alias("lowest"))
    text = docs.where(usable).select("doc_id", "text")
    trusted = rows.sample(marked.where("lowest = 1").select("doc_id"), limit)  # ids only
    positive = _sampled(text.join(F.broadcast(trusted), "doc_id", "left_semi"), limit)
    unlabelled = _sampled(text, limit)
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def scored(docs: DataFrame, net: Network | None, threshold: float = 0.3) -> DataFrame:
    """(row, score, predicted) for every row; without a model every score is 0.5.

    Null text counts as empty and is scored on zero statistics.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def one(batch):
        x = _features(batch)
        s = shared.value.scores(x) if shared.value is not None else np.full(len(x), 0.5)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return rows.annotate(docs, {"text": F.col("text")}, "score DOUBLE, predicted INT", one)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier does not reject, with their own columns."""
    return scored(docs, learn(docs, labels)).where("predicted = 1").select("row.*")


def quality(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    return scored(docs.select("doc_id", "text"), learn(docs, labels)).select(
        F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted"
    )


def op2_pu_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels of ids whose checksum modulo 5 is not 0."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return quality(docs, labels, common.is_held_out("row.doc_id", 5, 0))
