"""Removal of word passages that repeat across documents, by seeds that are extended.

1. Seeds: of the ``seed``-word runs inside every ``length``-word window the one with the
   least hash (leftmost on a tie) is the window's anchor (winnowing). It depends on the
   window's words alone, so equal windows have equal anchors at equal places.
2. Documents are joined on anchors: the occurrences of an anchor meet its first one, in
   the smallest doc_id (a star; never all pairs of occurrences).
3. Each seed is extended word by word both ways; of a maximal repeat over the length
   threshold the windows that belong to the seed are settled.
4. Windows whose words differ from the first occurrence may still equal each other.
   They are their own seeds, ``length`` words long, and meet in a second star.

Windows of an anchor that only one document holds can't repeat and go no further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch
from tracewell.llm.textops import Words, grams, slices, text_bytes

#: Windows handled at once; with 24 bits of place beside 40 bits of hash.
PIECE = 1 << 22
ANCHOR = "h long, doc_id long, t long, pos int, lo int, hi int"


def window_anchors(h: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of a run of word hashes."""
    width, out = length - seed + 1, []
    g = grams(h, seed)
    for at in range(0, max(0, len(h) - length + 1), PIECE):
        part = g[at : at + PIECE + width - 1]
        low = (part & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
        done = 1
        while done < width:
            step = min(done, width - done)
            low = np.minimum(low[: len(low) - step], low[step:])
            done += step
        new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.concatenate([new[1:], [len(low)]]) - 1
        place = (low[new] & np.uint64((1 << 24) - 1)).astype(np.int64)
        out.append((part[place], place + at, new + at, last + at))
    if not out:
        return (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _anchors(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            h = words.hashes()
            found = [window_anchors(h[a:b], length, seed) for a, b in zip(words.bounds[:-1], words.bounds[1:])]
            n = np.array([len(x[0]) for x in found])
            row = pa.array(np.repeat(np.arange(len(n)), n))
            hs, pos, lo, hi = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hs.view(np.int64)), batch.column("doc_id").take(row), batch.column("t").take(row), *(pa.array(x.astype(np.int32)) for x in (pos, lo, hi))],
                names=["h", "doc_id", "t", "pos", "lo", "hi"],
            )

    return run


def _ints(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """A list<int> column as one array for each row."""
    col = batch.column(name)
    values, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


SEGMENTS = "doc_id long, t long, removes boolean, pos array<int>, lo array<int>, hi array<int>, lpos array<int>, begin array<int>, words array<string>"


def _segments(length: int):
    """Of the first occurrence's text, the words that the seeds' windows can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, words = None, None
        for batch in slices(batches):
            lo, hi, pos, lpos = (_ints(batch, c) for c in ("lo", "hi", "pos", "lpos"))
            key = list(zip(batch.column("ldoc").to_pylist(), batch.column("lt").to_pylist()))
            begin, text = [], []
            for i in range(batch.num_rows):
                if key[i] != kept:
                    kept, words = key[i], Words(batch.column("text").slice(i, 1))
                n = len(words.starts)
                a = np.maximum(lpos[i] + lo[i] - pos[i], 0)
                b = np.minimum(lpos[i] + hi[i] - pos[i] + length, n)
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                cut = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                a, b = a[cut], b[np.concatenate([cut[1:], [len(b)]]) - 1]
                begin.append(a.astype(np.int32).tolist())
                text.append([words.data[words.starts[x] : words.ends[y - 1]].tobytes().decode() for x, y in zip(a, b)])
            removes = pa.array([x is not None and x < y for (x, _), y in zip(key, batch.column("doc_id").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), removes, *(batch.column(c) for c in ("pos", "lo", "hi", "lpos")), pa.array(begin, pa.list_(pa.int32())), pa.array(text, pa.list_(pa.string()))],
                names=["doc_id", "t", "removes", "pos", "lo", "hi", "lpos", "begin", "words"],
            )

    return run


def _extend(length: int):
    """Maximal repeats (a, b) around the seeds, and windows (a, window hash) that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs = Words(batch.column("text"))
            h, bounds = docs.hashes(), docs.bounds
            cols = [_ints(batch, c) for c in ("pos", "lo", "hi", "lpos", "begin")]
            texts = batch.column("words")
            rows, begins, ends, opens = [], [], [], []
            for i in range(batch.num_rows):
                own = h[bounds[i] : bounds[i + 1]]
                pos, lo, hi, lpos, begin = (c[i].astype(np.int64) for c in cols)
                parts = Words(texts[i].values)
                far = np.zeros(int(begin[-1]) + int(parts.bounds[-1] - parts.bounds[-2]), dtype=np.uint64)
                there = np.zeros(len(far), dtype=bool)
                ph = parts.hashes()
                for x, p, q in zip(begin, parts.bounds[:-1], parts.bounds[1:]):
                    far[x : x + q - p] = ph[p:q]
                    there[x : x + q - p] = True
                wide = None
                for delta in np.unique(lpos - pos):
                    mine = np.flatnonzero(lpos - pos == delta)
                    x, y = max(0, -delta), min(len(own), len(far) - delta)
                    equal = np.zeros(len(own) + 2, dtype=bool)
                    equal[x + 1 : y + 1] = (own[x:y] == far[x + delta : y + delta]) & there[x + delta : y + delta]
                    edge = np.flatnonzero(equal[1:] != equal[:-1])
                    starts, stops = edge[::2], edge[1::2]  # maximal runs of equal words
                    run_of = np.searchsorted(starts, pos[mine], side="right") - 1
                    hit = (run_of >= 0) & (stops[run_of] > pos[mine]) if len(starts) else np.zeros(len(mine), dtype=bool)
                    for m, r, ok in zip(mine, run_of, hit):
                        a, b = (max(lo[m], starts[r]), min(hi[m], stops[r] - length)) if ok else (0, -1)
                        if a <= b:
                            rows.append(i), begins.append(a), ends.append(b + length), opens.append(0)
                        left = [*range(lo[m], a), *range(b + 1, hi[m] + 1)] if a <= b else range(lo[m], hi[m] + 1)
                        if len(left) and wide is None:
                            wide = grams(own, length).view(np.int64)
                        for s in left:
                            rows.append(i), begins.append(s), ends.append(-1), opens.append(int(wide[s]))
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in ("doc_id", "t", "removes")), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(opens, pa.int64())],
                names=["doc_id", "t", "removes", "a", "b", "w"],
            )

    return run


def repeats(docs: DataFrame, scratch: Scratch, length: int = 50, seed: int = 20) -> DataFrame:
    """Spans of words (doc_id, t, a, b) that a document with a smaller doc_id has too.

    ``docs`` has doc_id, t (a hash of the text) and text. Spans may touch or overlap.
    """
    source = docs.filter("doc_id is not null and text is not null")
    anchors = scratch.table(source.mapInArrow(_anchors(length, seed), ANCHOR))
    first = anchors.groupBy("h").agg(F.min(F.struct("doc_id", "t", "pos")).alias("f"), F.max("doc_id").alias("other"))
    first = first.filter("f.doc_id < other").select("h", F.col("f.doc_id").alias("ldoc"), F.col("f.t").alias("lt"), F.col("f.pos").alias("lpos"))
    first = scratch.table(first)  # read back, it is dealt anew for the join, where a hot anchor's partition can be split
    seeds = anchors.join(first, "h").filter("not (doc_id = ldoc and t = lt and pos = lpos)")
    seeds = scratch.table(seeds.drop("h"))
    scratch.drop(anchors)
    pairs = seeds.groupBy("doc_id", "t", "ldoc", "lt").agg(F.sort_array(F.collect_set(F.struct("pos", "lo", "hi", "lpos"))).alias("s"))
    pairs = pairs.select("doc_id", "t", "ldoc", "lt", *(F.col(f"s.{c}").alias(c) for c in ("pos", "lo", "hi", "lpos")))
    far = source.select(F.col("doc_id").alias("ldoc"), F.col("t").alias("lt"), "text")
    held = ["doc_id", "t", "ldoc", "pos", "lo", "hi", "lpos", "text"]
    cut = scratch.table(pairs.join(far, ["ldoc", "lt"]).select("lt", *held).mapInArrow(_segments(length), SEGMENTS))
    scratch.drop(seeds)
    found = scratch.table(cut.join(source, ["doc_id", "t"]).mapInArrow(_extend(length), "doc_id long, t long, removes boolean, a int, b int, w long"))
    scratch.drop(cut)
    spans = found.filter("b >= 0 and removes").select("doc_id", "t", "a", "b")
    alone = found.filter("b < 0").select("doc_id", "t", "a", "w")
    least = alone.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("other")).filter("least < other").drop("other")
    second = alone.join(scratch.table(least), "w").filter("doc_id > least").select("doc_id", "t", "a", (F.col("a") + length).alias("b"))
    return spans.unionByName(second)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the words that the spans cover; join the others by one space."""
    for batch in slices(batches):
        words = Words(batch.column("text"))
        n = len(words.starts)
        depth = np.zeros(n + 1, dtype=np.int64)
        a, b = batch.column("a"), batch.column("b")
        for i, (x, y) in enumerate(zip(a, b)):
            if x.is_valid and len(x):
                np.add.at(depth, words.bounds[i] + np.asarray(x.values), 1)
                np.add.at(depth, words.bounds[i] + np.asarray(y.values), -1)
        keep = np.cumsum(depth[:n]) == 0
        total = np.concatenate([[0], np.cumsum(keep)])
        kept = total[words.bounds[1:]] - total[words.bounds[:-1]]
        starts, ends = words.starts[keep], words.ends[keep]
        edge = np.zeros(len(words.data) + 1, dtype=np.int64)
        edge[starts] += 1
        edge[ends] -= 1
        mask = np.cumsum(edge)[:-1] > 0
        data = np.append(words.data, np.uint8(32))
        mask = np.append(mask, False)
        tail = np.cumsum(kept)
        joint = np.ones(len(starts), dtype=bool)
        joint[tail[kept > 0] - 1] = False
        data[ends[joint]] = 32
        mask[ends[joint]] = True
        size = np.concatenate([[0], np.cumsum(mask)])
        _, offsets = text_bytes(batch.column("text"))
        out = size[offsets].astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(kept), pa.py_buffer(out.tobytes()), pa.py_buffer(data[mask].tobytes()))
        counts = np.diff(words.bounds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(counts - kept, pa.int64()), text.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, length: int = 50, seed: int = 20) -> DataFrame:
    """Each row of ``docs`` (doc_id, text; other columns are ignored) without repeated passages.

    Words are runs without space, tab, newline, vertical tab, form feed and return. A word
    goes if a window of ``length`` consecutive words covers it whose words also stand, as a
    window, in a document with a smaller doc_id; windows are judged on the input. Returns
    doc_id, n_words, n_removed and kept_text (words joined by one space).

    A null text has no words. Texts shorter than the window lose nothing. Rows that repeat
    a doc_id are one document's: they don't remove words from each other. A row with a null
    doc_id neither loses words nor takes them from others. An empty table gives an empty result.
    Windows count as equal if 64-bit hashes of their words are. A text is read whole, in one
    row, however long: its words and hashes take about 40 times its size while it is read.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    spans = repeats(base, scratch, length, seed).groupBy("doc_id", "t").agg(F.collect_set(F.struct("a", "b")).alias("s"))
    spans = spans.select("doc_id", "t", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    return base.join(spans, ["doc_id", "t"], "left").select("doc_id", "text", "a", "b").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
