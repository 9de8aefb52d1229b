"""Text quality by a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes move over the whole text in steps of ``STRIDE``. Chunks
are two neighbouring blocks of ``BLOCK`` bytes, so each overlaps the next by half; a
filter's answers are max-pooled in each chunk, a small dense layer makes one number of a
chunk's maxima, and a logistic layer makes one probability of the chunks' mean, extremes
and share of bad ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.toxicity import with_scores
from tracewell.llm.training import constant, labelled_sample, logistic_fit, remainder, sigmoid

WIDTH, STRIDE, BLOCK, FILTERS, HIDDEN = 8, 4, 256, 64, 32


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in blocks (n, BLOCK + WIDTH - STRIDE), the tail of each reaching into the next; blocks of each text.

    A text is followed by zero bytes, as far as its last filter reaches, so no filter sees
    two texts. Each has one block at least.
    """
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // BLOCK))
    first = np.concatenate([[0], np.cumsum(count)])
    padded = np.zeros(int(first[-1]) * BLOCK + WIDTH, dtype=np.uint8)
    at = np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], size)
    padded[at] = data
    rows = np.lib.stride_tricks.as_strided(padded, (int(first[-1]), BLOCK + WIDTH - STRIDE), (BLOCK, 1)).copy()
    rows[first[1:] - 1, BLOCK:] = 0
    return rows, count


def _windows(rows: np.ndarray) -> np.ndarray:
    """(n, places, WIDTH) bytes under the filters."""
    return np.lib.stride_tricks.sliding_window_view(rows, WIDTH, axis=1)[:, ::STRIDE]


@dataclass
class ConvNet:
    table: np.ndarray  # (WIDTH, 256, FILTERS): what a byte at an offset adds to each filter
    shift: np.ndarray
    dense: np.ndarray
    dense_shift: np.ndarray
    out: np.ndarray
    last: np.ndarray
    bias: float

    def _answers(self, rows: np.ndarray, tile: int = 32) -> np.ndarray:
        """What each filter says at each place (n, places, FILTERS), in tiles that fit a core's cache."""
        seen = _windows(rows) + np.arange(WIDTH) * 256
        flat = self.table.reshape(-1, FILTERS)
        out = np.empty((*seen.shape[:2], FILTERS), dtype=np.float32)
        more = np.empty((tile * seen.shape[1], FILTERS), dtype=np.float32)
        for i in range(0, len(rows), tile):
            at, total = seen[i : i + tile].reshape(-1, WIDTH), out[i : i + tile].reshape(-1, FILTERS)
            np.take(flat, at[:, 0], axis=0, out=total, mode="clip")
            for k in range(1, WIDTH):
                np.take(flat, at[:, k], axis=0, out=more[: len(at)], mode="clip")
                total += more[: len(at)]
        return out

    def maxima(self, rows: np.ndarray, tile: int = 256) -> np.ndarray:
        """Each block's maximum of each filter."""
        parts = [self._answers(rows[i : i + tile]).max(axis=1) for i in range(0, len(rows), tile)]
        return np.concatenate(parts) if parts else np.zeros((0, FILTERS), np.float32)

    def _chunk(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.shift, 0)
        return np.tanh(z @ self.dense + self.dense_shift) @ self.out

    def chunk_scores(self, rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each chunk, and the first chunk of each text."""
        top = self.maxima(rows)
        last = np.cumsum(count) - 1
        pooled = top.copy()
        pooled[:-1] = np.maximum(top[:-1], top[1:])
        keep = np.ones(len(top), dtype=bool)
        keep[last] = count == 1  # the last block ends the chunk before it
        pooled[last] = top[last]
        chunks = np.maximum(1, count - 1)
        return self._chunk(pooled[keep]), np.concatenate([[0], np.cumsum(chunks)])

    @staticmethod
    def summary(s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the last layer sees of each text's chunks."""
        n = np.diff(first)
        bad = sigmoid(-s)
        return np.stack([np.add.reduceat(s, first[:-1]) / n, np.maximum.reduceat(s, first[:-1]), np.minimum.reduceat(s, first[:-1]), np.add.reduceat(bad, first[:-1]) / n, 1 / n], axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text."""
        n = len(offsets) - 1
        if not len(self.out):
            return np.full(n, sigmoid(np.array(self.bias)))
        return sigmoid(self.summary(*self.chunk_scores(*blocks_of(data, offsets))) @ self.last + self.bias)

    @classmethod
    def fit(cls, texts: Sequence[bytes], y: np.ndarray, steps: int = 4000, batch: int = 128, rate: float = 0.01, seed: int = 3) -> ConvNet:
        """Filters and dense layer by Adam on random chunks, both labels alike often; then the last layer on whole texts."""
        fixed = constant(y)
        rng = np.random.default_rng(seed)
        nothing = np.zeros(0, dtype=np.float32)
        if fixed is not None:
            return cls(np.zeros((WIDTH, 256, FILTERS), np.float32), nothing, nothing, nothing, nothing, nothing, float(np.log((fixed + 1e-3) / (1 - fixed + 1e-3))))
        p = {
            "table": rng.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(np.float32), "shift": np.zeros(FILTERS, np.float32),
            "dense": rng.normal(0, 0.25, (FILTERS, HIDDEN)).astype(np.float32), "dense_shift": np.zeros(HIDDEN, np.float32), "out": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        }
        net = cls(p["table"], p["shift"], p["dense"], p["dense_shift"], p["out"], nothing, 0.0)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        rows, count = blocks_of(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
        first = np.cumsum(count) - count
        of_label = [np.flatnonzero(y == v) for v in (0, 1)]
        # Half of each label's draws are of texts of one block, which are rare and easily misjudged.
        short = [x[count[x] == 1] if (count[x] == 1).any() else x for x in of_label]
        mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in "ms")
        for t in range(1, steps + 1):
            docs = np.concatenate([rng.choice(part[v], batch // 4) for v in (0, 1) for part in (of_label, short)])
            label = y[docs].astype(np.float32)
            block = first[docs] + (rng.random(len(docs)) * np.maximum(1, count[docs] - 1)).astype(np.int64)
            other = np.minimum(block + 1, first[docs] + count[docs] - 1)
            both = np.stack([rows[block], rows[other]], axis=1).reshape(2 * len(docs), -1)
            answers = net._answers(both).reshape(len(docs), -1, FILTERS)
            top = answers.argmax(axis=1)
            z0 = np.take_along_axis(answers, top[:, None], axis=1)[:, 0] + p["shift"]
            z = np.maximum(z0, 0)
            h = np.tanh(z @ p["dense"] + p["dense_shift"])
            g = ((sigmoid(h @ p["out"]) - label) / len(docs)).astype(np.float32)
            dh = g[:, None] * p["out"] * (1 - h * h)
            dz = (dh @ p["dense"].T) * (z0 > 0)
            grad = {"out": h.T @ g, "dense": z.T @ dh, "dense_shift": dh.sum(axis=0), "shift": dz.sum(axis=0)}
            places = answers.shape[1] // 2
            seen = _windows(both)[(np.arange(len(docs)) * 2)[:, None] + top // places, top % places]  # (docs, FILTERS, WIDTH)
            spot = (np.arange(WIDTH) * 256 + seen) * FILTERS + np.arange(FILTERS)[None, :, None]
            grad["table"] = np.bincount(spot.ravel(), np.repeat(dz.ravel(), WIDTH), p["table"].size).astype(np.float32).reshape(p["table"].shape)
            step = rate * min(1.0, 2 * (1 - t / steps) + 0.02)
            for name, value in p.items():
                m, s, g = mean[name], square[name], grad[name]
                m *= 0.9
                m += 0.1 * g
                s *= 0.995
                s += 0.005 * (g * g)
                root = np.sqrt(s * np.float32(1 / (1 - 0.995**t)))
                root += 1e-6
                value *= 1 - 1e-3 * step
                value -= (step / (1 - 0.9**t)) * m / root
        x = cls.summary(*net.chunk_scores(rows, count)).astype(np.float64)
        m, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        w, b = logistic_fit((x - m) / sd, y, 1e-3, steps=400)
        net.last, net.bias = w / sd, b - float((w / sd * m).sum())
        return net


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", by: int = 5, held_out: int = 0, rows: int = 6000, chars: int = 20_000, at_least: float = 0.3) -> DataFrame:
    """Quality of each row of docs (doc_id, text; other columns are ignored).

    Labels (doc_id, ``label``) teach the network only where crc32(doc_id) modulo ``by`` isn't
    ``held_out``; it learns from ``rows`` of them at most, of any length (of a text longer than
    ``chars`` characters, from seeded pieces from all over it). Returns doc_id, held_out, score (0 to 1) and predicted (score >= ``at_least``).

    Null and empty texts get the score of one block of zero bytes. Without labels of both
    kinds all scores are their share of good ones (0.5 without any). A null doc_id counts as
    remainder 0. Repeated rows are scored each by itself; an empty table gives an empty result.
    A text is scored whole, in one row, however long: its blocks and the places of its bytes
    take about 20 times its size.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = with_scores(base, quality_model(docs, labels, label, by, held_out, rows, chars))
    return out.select("doc_id", (remainder(F.col("doc_id"), by) == held_out).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", by: int = 5, held_out: int = 0, rows: int = 6000, chars: int = 20_000) -> ConvNet:
    """The network of ``quality``, trained."""
    learn = labels.filter(remainder(F.col("doc_id"), by) != held_out)
    return ConvNet.fit(*labelled_sample(docs, learn, label, rows, chars))
