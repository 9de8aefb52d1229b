"""Toxicity by a linear model on character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.textops import slices, text_bytes
from tracewell.llm.training import constant, labelled_sample, logistic_fit, remainder, sigmoid

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Characters whose n-grams are hashed at once.
TILE = 1 << 18
#: Buckets of the first count, and of the filter before an exact look-up.
BITS = 20


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, A-Z lower-cased and all up to 32 alike, a space before and after each text; each text's end.

    What isn't valid UTF-8 counts as replacement characters.
    """
    raw = data.tobytes()
    try:
        flat = np.frombuffer(raw.decode().encode("utf-32-le"), dtype="<u4")
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    size = np.diff(begins) + 2
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint32)
    inner = np.ones(len(out), dtype=bool)
    inner[ends - 1] = False
    inner[ends - size] = False
    folded = np.where((flat >= 65) & (flat <= 90), flat + 32, flat)
    out[inner] = np.maximum(folded, 32)
    return out, ends


def codes_of(chars: np.ndarray, orders: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each n the 64-bit hashes of all n-grams of code points, each from those of n - 1."""
    out = chars.astype(np.uint64)
    for n in range(1, max(orders) + 1):
        if n > 1:
            out = out[:-1] * _BASE + chars[n - 1 :] if len(out) > 1 else out[:0]
        if n in orders:
            yield n, out


def _bucket(codes: np.ndarray) -> np.ndarray:
    return ((codes * _MUL) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class NgramModel:
    """Sorted hashes of n-grams of characters, the weight of each one's presence, and a bias."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    orders: tuple[int, ...]

    @classmethod
    def fit(cls, texts: Sequence[bytes], y: np.ndarray, orders: tuple[int, ...] = (4, 5, 6, 8), features: int = 4096, l2: float = 3e-4, smooth: float = 1.0) -> NgramModel:
        """Count presences by class, keep the n-grams whose log-count ratio is surest, and fit weights on ratio times presence.

        A first count goes by hash buckets, so that its size doesn't depend on the texts;
        only n-grams of the best buckets are then counted one by one.
        """
        fixed = constant(y)
        if fixed is not None:
            return cls(np.zeros(0, np.uint64), np.zeros(0), float(np.log((fixed + 1e-3) / (1 - fixed + 1e-3))), orders)
        counts = np.zeros((2, 1 << BITS), dtype=np.int32)
        docs = [characters(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))[0] for t in texts]
        for d, label in zip(docs, y):
            seen = np.zeros(1 << BITS, dtype=bool)
            for _, codes in codes_of(d, orders):
                seen[_bucket(codes)] = True
            counts[int(label)] += seen
        n1, n0 = float(y.sum()), float(len(y) - y.sum())

        def ratio(k1: np.ndarray, k0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The log ratio of smoothed shares, and how many standard errors it is from 0."""
            r = np.log((k1 + smooth) / (n1 + 2 * smooth)) - np.log((k0 + smooth) / (n0 + 2 * smooth))
            return r, np.abs(r) / np.sqrt(1 / (k1 + smooth) + 1 / (k0 + smooth))

        _, sure = ratio(counts[1], counts[0])
        sure[counts.sum(axis=0) < 3] = 0
        chosen = np.zeros(1 << BITS, dtype=bool)
        chosen[np.argsort(-sure, kind="stable")[: 4 * features]] = True
        held: list[np.ndarray] = []
        for d in docs:
            own = [c[chosen[_bucket(c)]] for _, c in codes_of(d, orders)]
            held.append(np.unique(np.concatenate(own)))
        codes, where = np.unique(np.concatenate(held), return_inverse=True)
        label = np.repeat(y, [len(x) for x in held])
        k1, k0 = np.bincount(where, label, len(codes)), np.bincount(where, 1 - label, len(codes))
        r, sure = ratio(k1, k0)
        sure[k1 + k0 < 3] = 0
        best = np.sort(np.argsort(-sure, kind="stable")[:features])
        codes, r = codes[best], r[best]
        x = np.zeros((len(docs), len(codes)), dtype=np.float32)
        for i, own in enumerate(held):
            at = np.searchsorted(codes, own)
            at[at == len(codes)] = 0
            x[i, at[codes[at] == own]] = 1
        x *= r.astype(np.float32)
        w, b = logistic_fit(x, y, l2, steps=200)
        return cls(codes, w * r, b, orders)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text; an n-gram counts once, wherever in the whole text it stands."""
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        if not len(self.codes):
            return sigmoid(total)
        chars, ends = characters(data, offsets)
        filled = np.zeros(1 << BITS, dtype=bool)
        filled[_bucket(self.codes)] = True
        pairs, longest = [], max(self.orders)
        for at in range(0, len(chars), TILE):
            for order, codes in codes_of(chars[at : at + TILE + longest - 1], self.orders):
                codes = codes[:TILE]
                hit = np.flatnonzero(filled[_bucket(codes)])
                k = np.searchsorted(self.codes, codes[hit])
                k[k == len(self.codes)] = 0
                same = self.codes[k] == codes[hit]
                hit, k = hit[same] + at, k[same]
                doc = np.searchsorted(ends, hit, side="right")
                inside = hit + order <= ends[doc]
                pairs.append(np.unique(doc[inside] * len(self.codes) + k[inside]))
        found = np.unique(np.concatenate(pairs))
        total += np.bincount(found // len(self.codes), self.weights[found % len(self.codes)], n)
        return sigmoid(total)


def with_scores(docs: DataFrame, model, column: str = "score") -> DataFrame:  # noqa: ANN001
    """All of docs (with text) and ``model.score`` of each text, in place of a column of that name; null texts count as empty."""
    docs = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.append_column(column, pa.array(model.score(*text_bytes(batch.column("text"))), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", by: int = 3, held_out: int = 1, rows: int = 8000, chars: int = 20_000, at_least: float = 0.7) -> DataFrame:
    """Toxicity of each row of docs (doc_id, text; other columns are ignored).

    Labels (doc_id, ``label``) teach the model only where crc32(doc_id) modulo ``by`` isn't
    ``held_out``; it learns from ``rows`` of them at most, of any length (of a text longer than
    ``chars`` characters, from seeded pieces from all over it). Returns doc_id, held_out, score (0 to 1) and predicted (score >= ``at_least``).

    Null and empty texts get the score of a text without known n-grams. Without labels of
    both kinds all scores are their share of toxic ones (0.5 without any). A null doc_id counts
    as remainder 0. Repeated rows are scored each by itself; an empty table gives an empty result.
    A text is scored whole, in one row, however long: its code points take about 10 times its size.
    """
    learn = labels.filter(remainder(F.col("doc_id"), by) != held_out)
    model = NgramModel.fit(*labelled_sample(docs, learn, label, rows, chars))
    out = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", (remainder(F.col("doc_id"), by) == held_out).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))
