"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters, digits and signs between white space; a chain is a sentence, however long.
The field has two states per token, clean and toxic, with weights for the token's letters (the word,
prefixes, a suffix, its shape) and for transitions.  Forward-backward gives each token's marginal, and a
document's score is a logistic function of how its marginals add up.

Chains are stepped through side by side, in segments of ``SEGMENT`` tokens: the product of a segment's
transfer matrices carries the messages over it, so marginals are those of the whole chain and a sentence
of many thousand tokens costs few steps.

Token labels for training come from document labels of a bounded sample without near copies: within toxic
documents, a token is labelled toxic if its word, or a prefix or ending that it shares, occurs significantly
more often in toxic than in clean training documents; all tokens of clean documents are labelled clean.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo
from .labelled import held_out, logistic, sample
from .scratch import map_batches, table

SEGMENT = 64
#: Tokens of a generation whose emission a worker remembers; two generations are kept.
MEMO = 100_000
_LETTERS = regex.compile(r"\p{L}+")


def core(token: str) -> str:
    """A token's letters in lower case; empty if it has none."""
    if token.isalpha():
        return token.lower()
    found = _LETTERS.findall(token)
    return "".join(found).lower()


def features(token: str) -> list[str]:
    word = core(token)
    if not word:
        return ["#"]
    return [f"w:{word}", *(f"p{n}:{word[:n]}" for n in (4, 5, 6, 7) if len(word) > n), f"s3:{word[-3:]}", "CAPS" if token.isupper() and len(word) > 1 else "word"]


def ends(token: str) -> bool:
    """Whether a sentence ends after this token."""
    return token[-1] in ".!?"


def chains(ending: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token, length) of each chain; ``ending`` flags tokens, ``documents`` has the end of each document."""
    n = len(ending)
    breaks = np.unique(np.concatenate([np.flatnonzero(ending) + 1, documents, [n]]))
    breaks = breaks[(breaks > 0) & (breaks <= n)].astype(np.int64)
    starts = np.concatenate([[0], breaks[:-1]]).astype(np.int64) if len(breaks) else np.zeros(0, np.int64)
    return starts, breaks - starts


class Field:
    """Weights of the two-state field: a score of state 1 for each feature, transitions and a start weight."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray, start: float):
        self.weights, self.transitions, self.start = weights, transitions, start

    def emission(self, token: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(token))

    def marginals(self, emission: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """P(state 1) of each token by forward-backward."""
        return forward_backward(emission, first, length, self.transitions, self.start)[0]


def forward_backward(emission, first, length, transitions, start, segment: int = SEGMENT):
    """Marginals of state 1, expected transition counts and the sum of the chains' first marginals."""
    out, pairs = np.zeros(len(emission)), np.zeros((2, 2))
    if not len(first):
        return out, pairs, 0.0
    step = np.exp(np.clip(emission, -30, 30))
    move = np.exp(transitions)
    (t00, t01), (t10, t11) = move
    count = -(-length // segment)  # segments of each chain
    chain = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    at = first[chain] + nth * segment
    size = np.minimum(length[chain] - nth * segment, segment)
    enter, leave = _messages(step, at, size, nth, np.cumsum(count) - count, count, move, start)

    order = np.argsort(-size, kind="stable")
    at, size, enter, back, opens = at[order], size[order], enter[order], leave[order].copy(), nth[order] == 0
    longest = int(size[0])
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # segments longer than t
    forward = np.empty((longest, len(at)))  # P(state 1 | tokens so far)
    f = np.exp(start) * step[at]
    goes0, goes1 = (1 - enter) * t00 + enter * t10, ((1 - enter) * t01 + enter * t11) * step[at]
    forward[0] = np.where(opens, f / (1 + f), goes1 / (goes0 + goes1))
    for t in range(1, longest):
        k = live[t]
        one = forward[t - 1, :k]
        zero = 1 - one
        b1 = (zero * t01 + one * t11) * step[at[:k] + t]
        forward[t, :k] = b1 / (b1 + zero * t00 + one * t10)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        one, message = forward[t, :k], back[:k]
        p1 = one * message
        out[at[:k] + t] = p1 / (p1 + (1 - one) * (1 - message))
        before = forward[t - 1, :k] if t else enter[:k]
        m1, m0 = message * step[at[:k] + t], 1 - message
        w = np.stack([(1 - before) * t00 * m0, (1 - before) * t01 * m1, before * t10 * m0, before * t11 * m1])
        w /= w.sum(0)
        pairs += (w if t else w[:, ~opens[:k]]).sum(1).reshape(2, 2)
        to0, to1 = t00 * m0 + t01 * m1, t10 * m0 + t11 * m1
        back[:k] = to1 / (to0 + to1)
    return out, pairs, float(out[first].sum())


def _messages(step, at, size, nth, begin, count, move, start):
    """P(state 1) of the token before each segment, and state 1's share in the message that comes back to its last token."""
    enter, leave = np.zeros(len(at)), np.full(len(at), 0.5)
    linked = np.flatnonzero(np.repeat(count > 1, count))
    if not len(linked):
        return enter, leave
    # The product of each linked segment's matrices, rows for the state before it; a chain's first token has its own.
    product = np.tile(np.eye(2), (len(linked), 1, 1))
    for t in range(int(size[linked].max())):
        own = np.flatnonzero(size[linked] > t)
        token = step[at[linked[own]] + t]
        moved = product[own] @ move
        if t == 0:
            moved[nth[linked] == 0] = [1.0, np.exp(start)]
        moved[:, :, 1] *= token[:, None]
        product[own] = moved / moved.sum((1, 2), keepdims=True)
    place = np.zeros(len(at), np.int64)
    place[linked] = np.arange(len(linked))
    many = np.flatnonzero(count > 1)
    for j in range(1, int(count.max())):
        own = begin[many[count[many] > j]] + j
        p, one = product[place[own - 1]], enter[own - 1]
        ends = (1 - one)[:, None] * p[:, 0] + one[:, None] * p[:, 1]
        enter[own] = ends[:, 1] / ends.sum(1)
    for j in range(int(count.max()) - 1, 0, -1):
        own = begin[many[count[many] > j]] + j
        p, share = product[place[own]], leave[own]
        back = p[:, :, 0] * (1 - share)[:, None] + p[:, :, 1] * share[:, None]
        leave[own - 1] = back[:, 1] / back.sum(1)
    return enter, leave


def distinct_texts(texts: list[str], y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The sample without near copies: of texts that share one of four smallest shingles the first stays. A group of copies would else make all of its words look like signs of its label."""
    from .shingles import shingle_sets

    seen: set[tuple[int, int]] = set()
    keep = []
    turns = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)
    for i, text in enumerate(texts):
        s = shingle_sets([text])[0]
        with np.errstate(over="ignore"):
            least = {(k, int((s * m).min())) for k, m in enumerate(turns)} if len(s) else set()
        if not least & seen:
            keep.append(i)
        seen |= least
    return [texts[i] for i in keep], y[keep] if keep else y[:0]


def signs(rows: list[np.ndarray], y: np.ndarray, owner: np.ndarray, flat: np.ndarray, n_features: int, least: int = 4, strength: float = 25.0) -> np.ndarray:
    """Which features mark toxic tokens: those in at least ``least`` toxic documents whose log-likelihood ratio of occurring there more often than in clean ones is over ``strength``."""
    starts = np.searchsorted(owner, np.arange(owner[-1] + 2)) if len(owner) else np.zeros(1, int)
    counts = np.zeros((2, n_features))
    for row, label in zip(rows, y, strict=True):
        words = np.unique(row)
        if len(words):
            own = np.concatenate([flat[starts[w] : starts[w + 1]] for w in words])
            counts[int(label), np.unique(own)] += 1
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())], float)[:, None]
    share = counts.sum(0) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * sum(np.nan_to_num(counts[c] * np.log(counts[c] / (n[c] * share))) + np.nan_to_num((n[c] - counts[c]) * np.log((n[c] - counts[c]) / (n[c] * (1 - share)))) for c in (0, 1))
    return (g > strength) & (counts[1] >= least) & (counts[1] / n[1] > 4 * counts[0] / n[0])


def train(texts: list[str], y: np.ndarray, steps: int = 40, rate: float = 0.3) -> tuple[Field, np.ndarray]:
    """The field by gradient ascent on the tokens' conditional likelihood, and the weights of the document score."""
    texts, y = distinct_texts(texts, y)
    if not texts:  # nothing to learn from: every text scores one half
        return Field({}, np.zeros((2, 2)), 0.0), np.zeros(4)
    index: dict[str, int] = {}
    rows = [np.array([index.setdefault(t, len(index)) for t in text.split()], np.int32) for text in texts]
    words = list(index)
    del index
    names: dict[str, int] = {}
    feats = [[names.setdefault(f, len(names)) for f in features(w)] for w in words]
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(f) for f in feats])
    flat = np.array([f for fs in feats for f in fs], np.int32)
    del feats
    marks = signs(rows, y, owner, flat, len(names))
    for name in ("CAPS", "word", "#"):  # shapes mark nothing by themselves
        if name in names:
            marks[names[name]] = False
    marked = np.bincount(owner, marks[flat], len(words)) > 0 if words else np.zeros(0, bool)
    token = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    documents = np.cumsum([len(r) for r in rows])
    label = marked[token] & np.repeat(y == 1, [len(r) for r in rows]) if len(token) else np.zeros(0, bool)
    ending = np.array([ends(w) for w in words], bool)[token] if words else np.zeros(0, bool)
    first, length = chains(ending, documents)
    weights, transitions, start = np.zeros(len(names)), np.zeros((2, 2)), 0.0
    transitions[0, 1] = -3.0
    # Observed transitions: each inside pair of a chain.
    inside = np.ones(len(token), bool)
    inside[first] = False
    now, last = label[inside].astype(int), label[np.flatnonzero(inside) - 1].astype(int) if len(token) else np.zeros(0, int)
    observed = np.array([[((last == a) & (now == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    m = [np.zeros(len(names)), np.zeros((2, 2)), 0.0]
    v = [np.zeros(len(names)), np.zeros((2, 2)), 0.0]
    scale = max(1.0, len(texts))
    for k in range(1, steps + 1):
        emission = np.bincount(owner, weights[flat], len(words))[token] if words else np.zeros(0)
        p, pairs, starts = forward_backward(emission, first, length, transitions, start)
        residual = np.bincount(token, label - p, len(words)) if words else np.zeros(0)
        gradients = [np.bincount(flat, residual[owner], len(names)) / scale - 1e-4 * weights, (observed - pairs) / scale - 1e-4 * transitions, (label[first].sum() - starts) / scale]
        for i, g in enumerate(gradients):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
        moves = [rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8) for i in range(3)]
        weights, transitions, start = weights + moves[0], transitions + moves[1], start + moves[2]
    field = Field({n: float(w) for n, w in zip(names, weights, strict=True) if abs(w) > 1e-3}, transitions, float(start))
    emission = np.array([field.emission(w) for w in words])[token] if words else np.zeros(0)
    x = aggregates(field.marginals(emission, first, length), documents)
    return field, logistic(x, y)


def aggregates(p: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Of each document: log of 1 + the sum of cubed marginals, the largest marginal, and the mean cube. Cubes keep the small marginals of a long clean text from adding up to those of a toxic one."""
    sums = np.concatenate([[0], np.cumsum(p**3)])
    starts = np.concatenate([[0], documents[:-1]]).astype(int)
    count = sums[documents] - sums[starts]
    size = documents - starts
    top = np.zeros(len(documents))
    full = size > 0
    if full.any():
        top[full] = np.maximum.reduceat(p, starts[full])
    return np.stack([np.log1p(count), top, count / np.maximum(size, 1)], 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, longest: int = 20_000):
    """Trains on at most ``per_class`` rows of each class that aren't held out."""
    texts, y = sample(docs, labels, "toxic", per_class, longest)
    return train(texts, y)


def score(docs: DataFrame, model, with_spans: bool = False) -> DataFrame:
    """(doc_id, score[, spans]) for each row of ``docs``.

    ``spans`` has (start, end, marginal) of each token whose marginal is at least one half, in characters.
    Null, empty and blank texts have no tokens and get the score of an empty document; long texts are scored
    whole.  Rows stay one to one: repeated rows and equal texts get equal scores; an empty table gives no rows.
    A model that was fitted without labels gives every text one half.
    """
    field, weights = model

    def run(batches) -> Iterable[dict[str, list]]:
        memo = Memo(lambda t: (field.emission(t), ends(t)), MEMO)
        for b in batches:
            s, p, rows, documents = _scores(field, weights, memo, b["text"])
            out = {"doc_id": b["doc_id"], "score": s.tolist()}
            if with_spans:
                out["spans"] = [_spans(t, p[e - len(r) : e]) for t, r, e in zip(b["text"], rows, documents, strict=True)]
            yield out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double" + (", spans array<struct<start:int,end:int,marginal:double>>" if with_spans else ""))


def accepted(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, with all columns, whatever their names. Null and empty texts are scored as empty documents; repeated rows go or stay together; an empty table stays empty."""
    field, weights = model
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches) -> Iterable[dict[str, list]]:
        memo = Memo(lambda t: (field.emission(t), ends(t)), MEMO)
        for b in batches:
            keep = _scores(field, weights, memo, b["text"])[0] < threshold
            yield {n: [x for x, k in zip(column, keep, strict=True) if k] for n, column in b.items()}

    return map_batches(docs, run, kinds)


def _scores(field: Field, weights: np.ndarray, memo: Memo, texts: list) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Scores, token marginals, tokens of each text and where each text's tokens end."""
    rows = [(t or "").split() for t in texts]
    documents = np.cumsum([len(r) for r in rows])
    n = int(documents[-1]) if len(rows) else 0
    both = np.fromiter((x for r in rows for t in r for x in memo[t]), np.float64, 2 * n).reshape(n, 2)
    first, length = chains(both[:, 1] > 0, documents)
    p = field.marginals(both[:, 0], first, length)
    return 1 / (1 + np.exp(-(aggregates(p, documents) @ weights[:-1] + weights[-1]))), p, rows, documents


def _spans(text: str | None, p: np.ndarray) -> list[dict]:
    """Offsets of toxic tokens, walked only where there are any."""
    hits = np.flatnonzero(p >= 0.5)
    if not len(hits):
        return []
    found, at, want = [], 0, dict(zip(hits.tolist(), p[hits].tolist(), strict=True))
    for k, token in enumerate(text.split()):
        at = text.index(token, at)
        if k in want:
            found.append({"start": at, "end": at + len(token), "marginal": want[k]})
        at += len(token)
    return found


def op4_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with its score, its prediction and the offsets of its toxic tokens; see ``score`` for nulls, repeats and empty tables."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels), with_spans=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
