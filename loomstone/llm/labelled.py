"""Labelled training samples: bounded, chosen by hash, never from held-out rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text is divisible by 5. A null id isn't held out, and as it meets no label nothing is learnt from it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``per_class`` rows of each class, the first in hash order of their id.

    Only rows that aren't held out, with a label of 0 or 1 and a text of at most ``longest`` characters
    count; an id that is labelled both 0 and 1 counts as 1; of rows that share a doc_id the smallest text does.  The driver gets at most ``2 * per_class``
    texts.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    chosen = known.where("y = 1").orderBy(order).limit(per_class).union(known.where("y = 0").orderBy(order).limit(per_class))
    mine = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids
    rows = mine.groupBy("doc_id", "y").agg(F.min("text").alias("text")).limit(2 * per_class).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.float64)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (bias last) of a logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
