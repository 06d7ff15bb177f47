"""Document quality by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - HOP`` and cover the
whole document.  Learned filters, each ``WIDTH`` bytes wide, move over a chunk two bytes at a time; each
filter's largest response is kept.  A hidden layer turns a chunk's pooled responses into one
logit; the smallest and the mean of the chunks' probabilities, weighted by the bytes that each covers
first, are combined into one probability.

As an option, off unless asked for, echo filters come to the learned ones: products of the signal with itself moved
by 1 to ``LAGS`` bytes, averaged over windows, of which the largest over the lags is kept; they answer to
repetition, which no linear filter can.

A filter over one-hot bytes is a sum of table rows, so a response is ``WIDTH / 2`` look-ups in tables of
byte pairs and no multiplication.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, logistic, sample
from .scratch import map_batches, table

CHUNK, HOP, WIDTH, LAGS, ECHO = 512, 448, 8, 32, 64
POSITIONS = (CHUNK - WIDTH) // 2 + 1


def chunks(data: bytes) -> np.ndarray:
    """All chunks of a text, zero-padded; an empty text has one chunk of zeros."""
    n = max(1, -(-(len(data) - (CHUNK - HOP)) // HOP))
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


def echo(x: np.ndarray) -> np.ndarray:
    """For each chunk the largest and the mean, over its windows, of the strongest repetition at any lag from 1 to LAGS."""
    best = np.zeros((len(x), CHUNK // ECHO), np.float32)
    for lag in range(1, LAGS + 1):
        same = np.zeros(x.shape, np.uint8)
        np.equal(x[:, lag:], x[:, :-lag], out=same[:, lag:].view(bool))
        same &= x != 0
        np.maximum(best, same.reshape(len(x), -1, ECHO).mean(2, dtype=np.float32), out=best)
    return np.stack([best.max(1), best.mean(1)], 1)


class Network:
    """Filters as a table [byte place][byte][filter], then a hidden layer and an output weight."""

    def __init__(self, filters: int, hidden: int, seed: int = 7, echoes: bool = False):
        r = np.random.default_rng(seed)
        self.echoes = echoes
        self.table = (r.normal(size=(WIDTH, 256, filters)) * 0.2).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.w1 = (r.normal(size=(filters + 2 * echoes, hidden)) * 0.3).astype(np.float32)
        self.b1 = np.zeros(hidden, np.float32)
        self.w2 = (r.normal(size=hidden) * 0.3).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.combine = np.array([1.0, 1.0, 0.0])

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.w1, self.b1, self.w2, self.b2]

    def pairs(self) -> np.ndarray:
        """Tables [pair place][two bytes, little-endian][filter]."""
        return (self.table[0::2, None, :, :] + self.table[1::2, :, None, :]).reshape(WIDTH // 2, 65536, -1)

    def pooled(self, x: np.ndarray, pairs: np.ndarray, where: bool = False):
        """Each filter's largest response in each chunk, and where it is if asked for."""
        two = np.ascontiguousarray(x).view("<u2")
        total = pairs[0][two[:, :POSITIONS]]
        for k in range(1, WIDTH // 2):
            total += pairs[k][two[:, k : k + POSITIONS]]
        if where:
            at = total.argmax(1)
            return np.take_along_axis(total, at[:, None], 1)[:, 0] + self.bias, at
        return total.max(1) + self.bias

    def logits(self, pooled: np.ndarray, echoes: np.ndarray | None):
        z = np.maximum(pooled, 0) if echoes is None else np.concatenate([np.maximum(pooled, 0), echoes], 1)
        h = np.maximum(z @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2[0], z, h


def train(texts: list[str], y: np.ndarray, filters: int = 16, hidden: int = 16, steps: int = 260, batch: int = 384, per_text: int = 6, seed: int = 7, echoes: bool = False) -> Network:
    """Adam on single chunks with their document's label; at most ``per_text`` chunks of a text, evenly spread, are learnt from."""
    net, r = Network(filters, hidden, seed, echoes), np.random.default_rng(seed)
    parts, labels = [], []
    for text, label in zip(texts, y, strict=True):
        own = chunks(text.encode())
        own = own[np.unique(np.linspace(0, len(own) - 1, per_text).astype(int))]
        parts.append(own)
        labels += [label] * len(own)
    if not parts or len(set(labels)) < 2:
        net.combine = np.array([0.0, 0.0, 0.0])
        return net
    x, target = np.concatenate(parts), np.array(labels, np.float32)
    heard = echo(x) if echoes else None
    balance = np.where(target == 1, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6)).astype(np.float32)
    ps = net.parameters()
    m, v = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
    for k in range(1, steps + 1):
        rows = r.integers(0, len(x), batch)
        bytes_in = x[rows].astype(np.int64)
        places = np.arange(POSITIONS) * 2
        total = net.table[0][bytes_in[:, places]]
        for j in range(1, WIDTH):
            total += net.table[j][bytes_in[:, places + j]]
        at = total.argmax(1)
        pooled = np.take_along_axis(total, at[:, None], 1)[:, 0] + net.bias
        logit, z, h = net.logits(pooled, None if heard is None else heard[rows])
        g = (1 / (1 + np.exp(-logit)) - target[rows]) * balance[rows] / batch
        gw2, gb2 = h.T @ g, np.array([g.sum()], np.float32)
        gh = g[:, None] * net.w2 * (h > 0)
        gw1, gb1 = z.T @ gh, gh.sum(0)
        gp = (gh @ net.w1.T)[:, :filters] * (pooled > 0)
        gt = np.zeros_like(net.table)
        for j in range(WIDTH):
            seen = np.take_along_axis(bytes_in, at * 2 + j, 1)
            np.add.at(gt[j], (seen, np.arange(filters)[None]), gp)
        for i, (p, grad) in enumerate(zip(ps, [gt, gp.sum(0), gw1, gb1, gw2, gb2], strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            p -= 0.01 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    pairs = net.pairs()
    net.combine = logistic(document_features(net, [t.encode() for t in texts], pairs), y)
    return net


def document_features(net: Network, data: list[bytes], pairs: np.ndarray, most: int = 512) -> np.ndarray:
    """Of each document the logit of the mean chunk probability and the logit of the smallest; ``most`` chunks are in memory at a time."""
    cut = [chunks(d) for d in data]
    counts = np.array([len(c) for c in cut])
    p = np.empty(counts.sum())
    at, held, size = 0, [], 0
    for c in [*cut, None]:
        while c is not None and len(c):
            take = most - size
            held.append(c[:take])
            size += len(held[-1])
            c = c[take:]
            if size < most:
                break
            p[at : at + size] = _probabilities(net, np.concatenate(held), pairs)
            at, held, size = at + size, [], 0
    if size:
        p[at : at + size] = _probabilities(net, np.concatenate(held), pairs)
    starts = np.cumsum(counts) - counts
    sizes = np.concatenate([_covered(len(d), n) for d, n in zip(data, counts, strict=True)])
    mean = np.add.reduceat(p * sizes, starts) / np.add.reduceat(sizes, starts)
    return np.stack([_logit(mean), _logit(np.minimum.reduceat(p, starts))], 1)


def _covered(n: int, count: int) -> np.ndarray:
    """Bytes that each chunk covers and the chunk before doesn't."""
    out = np.full(count, HOP, float)
    out[0] = min(max(n, 1), CHUNK)
    if count > 1:
        out[-1] = n - CHUNK - (count - 2) * HOP
    return out


def _probabilities(net: Network, x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.logits(net.pooled(x, pairs), echo(x) if net.echoes else None)[0].astype(float), -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 40_000, **network) -> Network:
    """Trains on at most ``per_class`` rows of each class that aren't held out; ``network`` goes to ``train``."""
    texts, y = sample(docs, labels, "quality", per_class, longest)
    return train(texts, y, **network)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) for each row; null counts as empty, and an empty text is one chunk of padding. Long texts are scored whole, in bounded memory.

    Rows stay one to one: repeated rows and equal texts get equal scores; an empty table gives no rows.  A network that
    was fitted without labels gives every text one half.
    """

    def run(batches) -> Iterable[dict[str, list]]:
        pairs = net.pairs()
        for b in batches:
            x = document_features(net, [(t or "").encode() for t in b["text"]], pairs)
            yield {"doc_id": b["doc_id"], "score": (1 / (1 + np.exp(-(x @ net.combine[:2] + net.combine[2])))).tolist()}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def op5_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with its score and prediction; see ``score`` for nulls, repeats and empty tables."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
