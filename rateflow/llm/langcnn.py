"""Language identification with a byte convolutional network trained in numpy.

A text is cut into fixed windows of bytes, every window of the whole text is scored in batches, and
the windows' probabilities are averaged by their bytes. The network embeds bytes, applies filters
of several widths, keeps each filter's maximum over the window, and ends in a softmax.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateflow.llm import common, rows

WINDOW = 256
WIDTHS = (2, 3, 4)


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with byte 0; none for an empty text."""
    n = -(-len(text) // WINDOW)
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x dim; row 0 (padding) is zero
    filters: np.ndarray  # widest * dim x all filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def views(self, w: np.ndarray) -> np.ndarray:
        """(windows, positions, widest * dim): the bytes under the widest filter at each position."""
        dim, widest = self.embed.shape[1], max(WIDTHS)
        x = self.embed[w].reshape(len(w), -1)
        return np.lib.stride_tricks.sliding_window_view(x, widest * dim, axis=1)[:, ::dim]

    def pooled(self, w: np.ndarray) -> np.ndarray:
        return self.respond(w).max(axis=1)

    def respond(self, w: np.ndarray) -> np.ndarray:
        v = self.views(w)
        return (np.ascontiguousarray(v).reshape(-1, v.shape[2]) @ self.filters).reshape(len(w), v.shape[1], -1)

    def probabilities(self, w: np.ndarray, batch: int = 32) -> np.ndarray:
        out = np.empty((len(w), len(self.languages)), dtype=np.float32)
        for a in range(0, len(w), batch):
            z = np.maximum(self.pooled(w[a : a + batch]) + self.bias, 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[a : a + batch] = z / z.sum(axis=1, keepdims=True)
        return out


def train(w: np.ndarray, y: np.ndarray, languages: list[str], dim: int = 8, filters: int = 12, epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 0) -> Network:
    """Fit by Adam on cross-entropy; back-propagation reaches the pooled positions only."""
    rng = np.random.default_rng(seed)
    widest, total = max(WIDTHS), filters * len(WIDTHS)
    f32 = np.float32
    used = np.repeat([[k >= widest_pos for k in WIDTHS] for widest_pos in range(1, widest + 1)], dim, axis=0)
    mask = np.repeat(used, filters, axis=1).astype(f32)
    net = Network(
        languages, rng.normal(0, 0.5, (256, dim)).astype(f32), rng.normal(0, 0.3, (widest * dim, total)).astype(f32) * mask,
        np.zeros(total, f32), rng.normal(0, 0.2, (total, len(languages))).astype(f32), np.zeros(len(languages), f32),
    )
    net.embed[0] = 0
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, steps = 0, epochs * -(-len(w) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(w))
        for a in range(0, len(w), batch):
            step += 1
            x, t = w[order[a : a + batch]], y[order[a : a + batch]]
            r = net.respond(x)
            at = r.argmax(axis=1)  # windows x filters
            h = np.take_along_axis(r, at[:, None], axis=1)[:, 0] + net.bias
            live = np.maximum(h, 0)
            z = live @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(t)), t] -= 1
            dz = p / len(t)
            dh = (dz @ net.out.T) * (h > 0)
            seen = net.views(x)[np.arange(len(x))[:, None], at]  # windows x filters x widest * dim
            d_filters = np.einsum("nf,nfk->kf", dh, seen) * mask
            d_seen = (dh[:, :, None] * net.filters.T[None]).reshape(len(x), total, widest, dim)
            under = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(widest)]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, under.ravel(), d_seen.reshape(-1, dim))
            d_embed[0] = 0
            grads = [d_embed, d_filters, dh.sum(0), live.T @ dz, dz.sum(0)]
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(f32)
    return net


def learn(docs: DataFrame, usable: Column, limit: int = 4000, sizes: tuple[int, ...] = (WINDOW, WINDOW, 60, 20), least: int = 50) -> Network | None:
    """Learn from at most ``limit`` usable rows with a language, a piece of each of ``sizes`` from each.

    Pieces start at hashed places anywhere in the text (short ones teach short texts). A language
    of which that sample has fewer than ``least`` rows gets up to ``least`` more. None if there is no
    such row. Repeated rows count each.
    """
    known = docs.where(usable & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")

    def piece(k: int, size: int) -> Column:
        room = F.greatest(F.length("text") - size, F.lit(0)) + 1
        return F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1).cast("int"), F.lit(size))

    cuts = [piece(k, size) for k, size in enumerate(sizes)]
    found = rows.sample(known, limit).select("lang", F.array(*cuts).alias("cuts")).collect()  # at most limit x sum(sizes) characters
    had = Counter(r["lang"] for r in found)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    for lang in sorted(k for k, n in counts.items() if had[k] < min(n, least)):
        found += rows.sample(known.where(F.col("lang") == lang), least).select("lang", F.array(*cuts).alias("cuts")).collect()
    languages = sorted({r["lang"] for r in found})
    if not languages:
        return None
    pairs = [(windows(c.encode())[0], languages.index(r["lang"])) for r in found for c in r["cuts"] if c]
    return train(np.stack([p[0] for p in pairs]), np.array([p[1] for p in pairs]), languages)


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """(row, lang_pred, score) of every row: the language of greatest mean probability.

    Text that is null or has no letter: ``und`` with score 1; without a model: ``und``, score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def one(batch):
        model = shared.value
        texts = common.strings(batch, "text")
        names, scores = ["und"] * len(texts), np.ones(len(texts)) if model else np.zeros(len(texts))
        lettered = [i for i, t in enumerate(texts) if model and any(map(str.isalpha, t))]  # Unicode letters: no digit, fraction or numeral
        if lettered:
            raw = [texts[i].encode() for i in lettered]
            cut = [windows(r) for r in raw]
            p = model.probabilities(np.concatenate(cut))
            sizes = np.concatenate([np.minimum(len(r) - WINDOW * np.arange(len(c)), WINDOW) for r, c in zip(raw, cut, strict=True)])
            starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
            mean = np.add.reduceat(p * sizes[:, None], starts) / np.add.reduceat(sizes, starts)[:, None]
            best = mean.argmax(axis=1)
            for k, i in enumerate(lettered):
                names[i], scores[i] = model.languages[best[k]], min(1.0, float(mean[k, best[k]]))
        return {"lang_pred": names, "score": scores}

    return rows.annotate(docs, {"text": F.col("text")}, "lang_pred STRING, score DOUBLE", one)


def op6_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those whose id checksum modulo 4 is not 2."""
    docs = common.table(spark, sf_dir, "documents")
    net = learn(docs, F.coalesce(common.remainder("doc_id", 4) != 2, F.lit(True)))
    found = predicted(docs.select("doc_id", "text"), net)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), common.is_held_out("row.doc_id", 4, 2).alias("held_out"), "lang_pred", "score"
    )
