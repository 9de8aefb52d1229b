"""Benchmark items inside documents, by CGK embedding, bit-sampling LSH and exact edit distance of words.

The CGK random walk copies a word sequence into a longer one: at each step it emits the
current word and goes on to the next one if a random bit of step and word says so. Sequences
at a small edit distance fall into step again after each edit, so few of the emitted words
differ, and keys made of few sampled steps collide with a known chance. Repeats draw walk and
sample anew, often enough to reach the target recall.

Every repeat begins its walk at another share of the item (its first ``STEPS`` steps are
sampled), so samples lie all over the item. The walk from a place of a text is the same for
all windows that have the place there, whatever their size, so one walk embeds the windows
of all item sizes at once; it is dropped as soon as no item's walk begins like it. A window,
as long as the item, is a candidate if enough repeats give it the item's key: as many as
chance gives to all but 1 - recall of those that are to be found. Candidates that hold
enough of the item's words are verified by their edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.textops import Words, mix, slices

LEAKS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "start", "n_words", "edits")]))
#: Steps of a walk that are sampled; fewer for items of less than half as many words more.
STEPS = 12
#: Bits of the filters for first words and first parts of keys.
BITS = 16
#: Collisions that are counted at once, and words whose windows are looked at together.
MOST, STRETCH = 1 << 21, 1 << 16
_C = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - BITS)


def _codes(h: np.ndarray) -> np.ndarray:
    """Word hashes, folded so that a product's top bit depends on all of them."""
    return h ^ (h >> np.uint64(29))


def walk(codes: np.ndarray, at: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The word codes (steps, places) that CGK walks from ``at`` emit; an odd number for each step draws the bits. Codes go on past the walks' ends."""
    out, at = np.empty((len(draws) + 1, len(at)), dtype=np.uint64), at.copy()
    for j, draw in enumerate(draws):
        out[j] = codes[at]
        at += ((out[j] * draw) >> np.uint64(63)).astype(np.int64)
    out[-1] = codes[at]
    return out


@dataclass
class Repeat:
    """One draw of walk and sample, and the items' keys by it, in order."""

    draws: np.ndarray
    sample: list[int]
    salt: np.uint64
    first: np.ndarray
    second: np.ndarray
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray

    @classmethod
    def draw(cls, rng: np.random.Generator, steps: int, samples: int, codes: np.ndarray, begin: np.ndarray, n: np.ndarray, items: np.ndarray) -> Repeat:
        draws = rng.integers(0, 1 << 63, steps - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Steps near each other often emit the same word, so samples keep a distance.
        parts = np.linspace(0, steps, min(samples, steps) + 1)
        sample = [0, *((a + b + rng.random() * (b - a)) // 2 for a, b in zip(parts[1:-1], parts[2:]))]
        sample = sorted({int(j) for j in sample})
        salt = rng.integers(0, 1 << 63, dtype=np.uint64)
        offset = (rng.random() * (n - steps + 1)).astype(np.int64)
        emitted = walk(codes, begin + offset, draws)
        key, keys = np.full(len(n), salt), []
        for j in sample:
            key = mix(key * _C + emitted[j])
            keys.append(key)
        order = np.argsort(key, kind="stable")
        first, second = (np.zeros(1 << BITS, dtype=bool) for _ in "fs")
        first[emitted[0] >> _TOP] = True
        second[keys[min(1, len(keys) - 1)] >> _TOP] = True
        return cls(draws, sample, salt, first, second, key[order], items[order], offset[order])

    def collisions(self, codes: np.ndarray, top: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places from ``a`` on, for which ``top`` has the codes' top bits, whose walks share a key with items, and the keys' range in ``keys``."""
        place = np.flatnonzero(self.first[top]) + a
        at, now, key = place, 0, np.full(len(place), self.salt)
        for i, j in enumerate(self.sample):
            for step in range(now, j):
                at = at + ((codes[at] * self.draws[step]) >> np.uint64(63)).astype(np.int64)
            key, now = mix(key * _C + codes[at]), j
            if i == min(1, len(self.sample) - 1):
                keep = np.flatnonzero(self.second[key >> _TOP])
                place, at, key = place[keep], at[keep], key[keep]
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        hit = np.flatnonzero(hi > lo)
        return place[hit], lo[hit], hi[hit]


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of ``text`` with the least edit distance to ``item``; the earliest end on a tie, then the longest part."""
    m = len(text)
    cost, begin = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    # A cost and its start as one number: least cost first, then the earliest start.
    big = m + 2
    row = cost * big + begin
    ramp = np.arange(m + 1) * big
    for w in item:
        down = row + big
        down[1:] = np.minimum(down[1:], row[:-1] + np.where(text == w, 0, big))
        row = np.minimum.accumulate(down - ramp) + ramp
    end = int(np.argmin(row // big))
    return int(row[end] // big), int(row[end] % big), end


class Benchmark:
    """A block of items, prepared for the search."""

    def __init__(self, ids: list[int], texts: list[str | None], share: float, repeats: int, samples: int, enough: int, seed: int = 5):
        words = Words(pa.array(texts, pa.string()), lower=True)
        h = words.hashes()
        same: dict[bytes, list[int]] = {}
        for i, a, b in zip(ids, words.bounds[:-1], words.bounds[1:]):
            if b > a:
                same.setdefault(h[a:b].tobytes(), []).append(i)
        self.ids = list(same.values())  # items of equal words are one
        self.words = [np.frombuffer(w, dtype=np.uint64) for w in same]
        self.n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.k = np.floor(share * self.n + 1e-9).astype(np.int64)
        codes, first = _codes(np.concatenate([*self.words, np.zeros(STEPS, np.uint64)])), np.cumsum(self.n) - self.n
        rng = np.random.default_rng(seed)
        # Walks are shorter than their item by a third at least, so they begin at different words.
        steps = np.max([np.where(2 * self.n >= 3 * t, t, 1) for t in (STEPS, 8, 4, 2)], axis=0)
        self.repeats, self.enough = [], np.ones(len(self.n), dtype=np.int64)
        for t in np.unique(steps):
            mine = np.flatnonzero(steps == t)
            draws = repeats if self.k[mine].any() else 1  # items without edits have equal walks, so one repeat finds them
            self.enough[mine] = enough if draws > 1 else 1
            self.repeats += [Repeat.draw(rng, int(t), samples, codes, first[mine], self.n[mine], mine) for _ in range(draws)]

    def windows(self, codes: np.ndarray, bounds: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc, item, start) of the candidates that begin at places from ``a`` (0: or before) to ``b``; in halves where too much collides."""
        end = min(int(bounds[-1]), b + int((self.n + 2 * self.k).max()))
        top = (codes[a:end] >> _TOP).astype(np.int64)
        met = [(r, *r.collisions(codes, top, a)) for r in self.repeats]
        if sum(int((hi - lo).sum()) for _, _, lo, hi in met) > MOST and b - a > 1:
            yield from self.windows(codes, bounds, a, (a + b) // 2)
            yield from self.windows(codes, bounds, (a + b) // 2, b)
            return
        items, starts, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, place, lo, hi in met:
            n = hi - lo
            each = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            items.append(r.items[each])
            starts.append(np.repeat(place, n) - r.offsets[each])
            docs.append(np.repeat(np.searchsorted(bounds, place, side="right") - 1, n))
        item, start, doc = np.concatenate(items), np.concatenate(starts), np.concatenate(docs)
        # A number that puts windows in order of text, item and place; those of one item that begin within 2 k of each other count together.
        wide = np.int64(2) * (np.int64(bounds[-1]) + np.int64(self.n.max()) + 2 * np.int64(self.k.max(initial=0)) + 2)
        group = (doc - (doc.min() if len(doc) else 0)) * len(self.n) + item
        order = np.lexsort((start, group))
        group, item, start, doc = group[order], item[order], start[order], doc[order]
        _, dense = np.unique(group, return_inverse=True)
        line, reach = dense * wide + start + self.n.max(), 2 * self.k[item]
        near = np.searchsorted(line, line + reach, side="right") - np.searchsorted(line, line - reach, side="left")
        keep = np.flatnonzero((near >= self.enough[item]) & (start < b) & ((start >= a) | (a == 0)))
        yield doc[keep], item[keep], start[keep]

    def search(self, h: np.ndarray, bounds: np.ndarray) -> list[list[dict[str, int]]]:
        """The items in each text, with the place, length and edits of the best passage."""
        out: list[list[dict[str, int]]] = [[] for _ in range(len(bounds) - 1)]
        if not len(self.n) or not len(h):
            return out
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        codes = _codes(np.concatenate([h, np.zeros(STEPS, dtype=np.uint64)]))
        for doc, item, start in (w for a in range(0, len(h), STRETCH) for w in self.windows(codes, bounds, a, min(a + STRETCH, len(h)))):
            if not len(doc):
                continue
            # Windows of an item that begin near each other are looked at together.
            k = self.k[item]
            fresh = np.ones(len(doc), dtype=bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + self.n[item[1:]] + 2 * k[1:])
            begin = np.flatnonzero(fresh)
            last = np.append(begin[1:], len(doc)) - 1
            lo = np.maximum(bounds[doc[begin]], start[begin] - 2 * k[begin])
            hi = np.minimum(bounds[doc[begin] + 1], start[last] + self.n[item[begin]] + 2 * k[begin])
            for d, j, a, b in zip(doc[begin].tolist(), item[begin].tolist(), lo.tolist(), hi.tolist()):
                most = int(self.k[j])
                # Each of an item's words that the part lacks is an edit at least.
                if int((~np.isin(self.words[j], h[a:b])).sum()) > most:
                    continue
                edits, p, e = best_match(self.words[j], h[a:b])
                if edits <= most:
                    found = (edits, a + p - int(bounds[d]), e - p)
                    best[d, j] = min(best.get((d, j), found), found)
        for (d, j), (edits, p, size) in sorted(best.items()):
            out[d] += [{"item_id": int(i), "start": p, "n_words": size, "edits": edits} for i in self.ids[j]]
        return [sorted(x, key=lambda leak: leak["item_id"]) for x in out]


def enough_of(repeats: int, samples: int, agree: float, recall: float) -> int:
    """The most collisions that a window to be found has with chance ``recall``, if each sampled step agrees with chance ``agree``; 0 if not even one."""
    p, missed, enough = agree**samples, 0.0, 0
    for m in range(repeats):
        missed += math.comb(repeats, m) * p**m * (1 - p) ** (repeats - m)
        if missed > 1 - recall:
            break
        enough = m + 1
    return enough


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks", share: float = 0.2, samples: int = 3, agree: float = 0.6, recall: float = 0.999, repeats: int = 48, block_words: int = 1_000_000) -> DataFrame:
    """All of docs (with text) and the benchmark items (item_id, text) that each row's text holds.

    An item of n words is held where a passage has floor(``share`` * n) edits of words or less;
    A-Z are lower-cased. ``column`` gets item_id, start, n_words and edits of the best passage
    of each. The items go to the executors in blocks of ``block_words`` words at most (or one
    item), with a pass over docs for each block; nothing is shuffled. An item is missed with a
    chance of 1 - ``recall`` at most where a sampled step of its passage agrees with chance ``agree``.

    A text is searched whole, in one row: its words and keys take about 30 times its size while
    it is read. Null texts hold nothing; null or wordless items and null item_ids are left out. Repeated
    rows are searched each by itself. Empty tables give rows without leaks, or no rows.
    """
    enough = enough_of(repeats, samples, agree, recall)
    if not enough:
        raise ValueError(f"{repeats} repeats don't reach a recall of {recall}")
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != column), T.StructField(column, LEAKS)])

    def scan(block: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                words = Words(batch.column("text"), lower=True)
                found = block.search(words.hashes(), words.bounds)
                kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "n_words", "edits")]))
                if column in batch.schema.names:
                    found = [[*(x or []), *y] for x, y in zip(batch.column(column).to_pylist(), found)]
                    batch = batch.drop_columns([column])
                yield batch.append_column(column, pa.array(found, kind))

        return run

    out, ids, texts, size = docs.drop(column), [], [], 0
    for row in items.toLocalIterator():  # one block is on the driver at a time
        n = len(row["text"]) // 2
        if ids and size + n > block_words:
            out, ids, texts, size = out.mapInArrow(scan(Benchmark(ids, texts, share, repeats, samples, enough)), schema), [], [], 0
        ids.append(row["item_id"]), texts.append(row["text"])
        size += n
    return out.mapInArrow(scan(Benchmark(ids, texts, share, repeats, samples, enough)), schema)


def leaks(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, start, n_words, edits."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
