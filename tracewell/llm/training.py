"""Bounded samples of labelled documents, and a logistic fit, for models that are trained on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo ``by``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % by, F.lit(0)).cast("int")


#: Places that a long text's sample is taken from.
PIECES = 32


def sampled_text(text: Column, doc_id: Column, chars: int, seed: int) -> Column:
    """A text, or of one longer than ``chars`` characters seeded pieces from all over it, one for each of PIECES equal parts."""
    size = chars // PIECES
    n = F.length(text)
    share = lambda i: F.pmod(F.xxhash64(doc_id, i, F.lit(seed)), F.lit(1000)) / 1000.0
    part = n / PIECES
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr(text, (F.floor(i * part + share(i) * (part - size)) + 1).cast("int"), F.lit(size)))
    return F.when(n <= chars, text).otherwise(F.array_join(pieces, "\n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, seed: int = 11) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` labelled texts and their labels (0 or 1), each whole up to ``chars`` characters.

    Rows of ``labels`` (doc_id, ``label``) are taken in the order of a seeded hash, whatever
    their texts' length; of a longer text come seeded pieces from all over it. So what goes to
    the executors and comes back is bounded by ``rows`` and ``chars``. Null and other labels
    are left out. Where labels repeat an id, the least label counts.
    """
    picked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    texts = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "y", sampled_text(F.col("text"), F.col("doc_id"), chars, seed).alias("text"))
    got = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    raw = got["text"].to_pylist()
    return [raw[i].encode() for i in order], got["y"].to_numpy()[order].astype(np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic_fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression, by accelerated full gradients."""
    n, k = x.shape
    w, b = np.zeros(k, dtype=x.dtype), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if n else 0.0
    if not n:
        return w, b
    v = np.ones(k, dtype=x.dtype) / max(1, k) ** 0.5  # largest eigenvalue, for the step
    for _ in range(12):
        u = x.T @ (x @ v)
        v = u / (np.linalg.norm(u) + 1e-12)
    rate = 1 / (0.25 * (np.linalg.norm(x @ v) ** 2 + n) / n + l2)
    ow, ob = w, b
    for t in range(steps):
        m = t / (t + 3)
        zw, zb = w + m * (w - ow), b + m * (b - ob)
        g = (sigmoid(x @ zw + zb) - y).astype(x.dtype)
        ow, ob = w, b
        w, b = zw - rate * (x.T @ g / n + l2 * zw), float(zb - rate * g.mean())
    return w, b


def constant(labels: Sequence[float]) -> float | None:
    """The probability that a model without two classes gives to all; None if both occur."""
    y = np.asarray(labels)
    return None if len(y) and 0 < y.mean() < 1 else (float(y.mean()) if len(y) else 0.5)
