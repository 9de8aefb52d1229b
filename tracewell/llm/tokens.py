"""Token ids of documents in binary shards with Elias-Fano coded document boundaries.

A shard is one file: a header, the document ids and the document ends as two Elias-Fano
sequences with select samples, then all token ids as 16-bit (or 32-bit) integers.
``Shard.open`` maps it (or reads it, where the store isn't a local folder), and
``Shard.span`` finds one document's ids by two selects, without a table of 64-bit offsets.

Files are named after the task attempt that wrote them, and only those count that the
manifest names, a Parquet table which Spark's committer writes. So a lost or repeated task
leaves files that nobody reads, and nothing half-written is read.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.textops import slices, span_hashes, text_bytes

MAGIC = b"TWIDS\x01"
#: One select sample for so many elements.
SAMPLE = 64
_SET_BITS = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


class EliasFano:
    """A non-decreasing sequence of n integers below u in about n * (2 + log2(u / n)) bits."""

    HEAD = struct.Struct("<QqBQQ")

    def __init__(self, n: int, base: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.width, self.low, self.high, self.samples = n, base, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        n, base = len(v), int(v[0]) if len(v) else 0
        v = (v.view(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)) if n else v.view(np.uint64)
        width = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = ((v >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, base, width, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Element i: the place of the i-th one gives the high bits, the low bits stand in a plain array."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, mask = at >> 3, 0xFF << (at & 7) & 0xFF
        while (c := int(_SET_BITS[x := int(self.high[byte]) & mask])) <= left:
            left, byte, mask = left - c, byte + 1, 0xFF
        for bit in range(8):
            if x >> bit & 1:
                if not left:
                    break
                left -= 1
        high = byte * 8 + bit - i
        start = i * self.width
        raw = int.from_bytes(self.low[start >> 3 : (start + self.width + 7) >> 3].tobytes(), "little") >> (start & 7)
        return (high << self.width | raw & ((1 << self.width) - 1)) + self.base

    def decode(self) -> np.ndarray:
        """All elements."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.uint64)
        low = (bits << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        v = ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)) | low
        return (v + np.uint64(self.base & 0xFFFFFFFFFFFFFFFF)).view(np.int64)

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.base, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int = 0) -> tuple[EliasFano, int]:
        n, base, width, low, high = cls.HEAD.unpack_from(raw, at)
        at += cls.HEAD.size
        parts = [np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low)]
        at += low + high
        k = -(-n // SAMPLE)
        return cls(n, base, width, *parts, np.frombuffer(raw, np.uint32, k, at)), at + 4 * k


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; the same on all machines."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


class Shard:
    """Documents and their token ids."""

    def __init__(self, doc_ids: EliasFano, nulls: int, ends: EliasFano, ids: np.ndarray):
        self.doc_ids, self.nulls, self.ends, self.ids = doc_ids, nulls, ends, ids

    @staticmethod
    def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
        """Rows in order of doc_id, nulls last."""
        known = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
        kind = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        head = MAGIC + struct.pack("<BQQ", kind, len(doc_ids) - len(known), len(ids))
        return head + EliasFano.encode(known).to_bytes() + EliasFano.encode(np.cumsum(lengths)).to_bytes() + ids.astype(f"<u{kind}").tobytes()

    @classmethod
    def unpack(cls, raw: bytes | pa.Buffer) -> Shard:
        view = memoryview(raw)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a shard of token ids")
        kind, nulls, n = struct.unpack_from("<BQQ", view, len(MAGIC))
        docs, at = EliasFano.from_bytes(view, len(MAGIC) + 17)
        ends, at = EliasFano.from_bytes(view, at)
        return cls(docs, nulls, ends, np.frombuffer(view, f"<u{kind}", n, at))

    @classmethod
    def open(cls, path: str) -> Shard:
        """A shard file; a local one is mapped, so only the pages that are asked for are read."""
        store, at = _store(path)
        if isinstance(store, pa.fs.LocalFileSystem):
            with pa.memory_map(at) as f:
                return cls.unpack(f.read_buffer())
        with store.open_input_file(at) as f:
            return cls.unpack(f.read_buffer())

    def __len__(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        """The id of the i-th document; null ids are last."""
        return self.doc_ids.select(i) if i < self.doc_ids.n else None

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the ids of the i-th document begin and end."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def span(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        a, b = self.bounds(i)
        return self.ids[a:b]


def _after_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white space character ends right before each place of UTF-8 ``data`` (places of 3 at least, or padded)."""
    p1, p2, p3 = data[at - 1], data[at - 2], data[at - 3]
    one = ((p1 >= 9) & (p1 <= 13)) | ((p1 >= 28) & (p1 <= 32))
    two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    wide = (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) & (p1 >= 0x80) | (p2 == 0x81) & (p1 == 0x9F)
    other = (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
    return one | two | (p3 == 0xE2) & wide | other


class Encoder:
    """A byte-level BPE of the tokenizers library that keeps the ids of pieces it has seen.

    Its first step never joins a character with a space after it unless it is white space
    itself, so a text in which no white space stands before a space can be cut at each
    space. Any other text is one piece, as is one that holds the literal of an added token
    (which the library makes that token's id). Pieces are told apart by 64-bit hashes; all
    are dropped when there are ``most`` or more.
    """

    def __init__(self, path: str, most: int = 3_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.literals = [str(t.content).encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One for each process, so that a worker keeps its pieces from task to task."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def clear(self) -> None:
        none = np.zeros(0, dtype=np.uint64)
        self.levels = [(none, none.astype(np.int64)), (none, none.astype(np.int64))]  # hashes in order and their numbers: many, and the latest
        self.flat, self.size = np.zeros(1 << 20, dtype=np.uint32), 0
        self.ends = np.zeros(1, dtype=np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        for known, number in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out = np.where(known[at] == h, number[at], out)
        return out

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        found = [x.ids for x in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        new = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(n.sum()))
        while self.size + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.size : self.size + len(new)] = new
        self._add(1, h, np.arange(len(h)) + len(self.ends) - 1)
        self.ends = np.concatenate([self.ends, self.size + np.cumsum(n)])
        self.size += len(new)
        if len(self.levels[1][0]) > 1 << 17:
            self._add(0, *self.levels[1])
            self.levels[1] = (self.levels[1][0][:0], self.levels[1][1][:0])

    def _add(self, level: int, h: np.ndarray, number: np.ndarray) -> None:
        h, number = np.concatenate([self.levels[level][0], h]), np.concatenate([self.levels[level][1], number])
        order = np.argsort(h)
        self.levels[level] = (h[order], number[order])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and each text's number of ids."""
        if len(self.ends) > self.most or self.size > 8 * self.most:
            self.clear()
        data, offsets = text_bytes(col)
        padded = np.concatenate([np.full(3, 65, dtype=np.uint8), data])
        spaces = np.flatnonzero(data == 32)
        row = np.searchsorted(offsets, spaces, side="right") - 1
        inner = spaces > offsets[row]
        whole = np.zeros(len(offsets) - 1, dtype=bool)
        whole[row[inner & _after_space(padded, spaces + 3)]] = True
        raw = data.tobytes()
        for literal in self.literals:
            at = raw.find(literal)
            while at >= 0:
                whole[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(literal, at + 1)
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[offsets[:-1]] = True
        begins[spaces[~whole[row]]] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        h, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            a, b = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn(h[new], [raw[x:y].decode() for x, y in zip(a, b)])
            number = self._find(h)
        number = number[back]
        start, n = self.ends[number], self.ends[number + 1] - self.ends[number]
        total = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(total[-1]) + np.repeat(start - total[:-1], n)
        return self.flat[take], np.diff(total[np.searchsorted(starts, offsets)])


_ENCODERS: dict[str, Encoder] = {}


def _write(path: str, out: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.shared(path), TaskContext.get()
        part = task.partitionId()
        docs: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        shard = before = held = 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{shard:06d}-{task.taskAttemptId()}.ids"
            store, at = _store(f"{out}/{name}")
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at) as f:
                f.write(Shard.pack(docs, np.concatenate(lengths), np.concatenate(ids)))
            row = [part, shard, before, len(docs), held]
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row), pa.array([name])], names=["part", "shard", "before", "n_docs", "n_tokens", "file"])

        for batch in slices(batches):
            got, n = encoder.encode(batch.column("text"))
            with_end = np.full(len(got) + len(n), end_id, dtype=np.uint32)
            keep = np.ones(len(with_end), dtype=bool)
            keep[np.cumsum(n + 1) - 1] = False
            with_end[keep] = got
            docs += batch.column("doc_id").to_pylist()
            lengths.append(n + 1)
            ids.append(with_end)
            held += len(with_end)
            if held >= shard_ids:
                yield flush()
                shard, before, held, docs, lengths, ids = shard + 1, before + held, 0, [], [], []
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, partitions: int | None = None, shard_ids: int = 1 << 20, partition_bytes: int = 64 << 20) -> None:
    """Encode docs (doc_id, text) and write shards of about ``shard_ids`` ids to the folder ``out``, with a manifest.

    Documents go in ascending order of doc_id, null ids last; rows that repeat an id stand
    side by side, ordered by a hash of the text. A null text is empty: its end id alone.
    ``out`` is a folder or URI that all executors reach. Without ``partitions``, there are as
    many as the texts need for ``partition_bytes`` each, but no fewer than the session
    shuffles into. A text is encoded whole, in one row, however long.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = lambda: rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size() / partition_bytes))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows.mapInArrow(_write(tokenizer, f"{out}/data", end_id, shard_ids), "part long, shard long, before long, n_docs long, n_tokens long, file string").write.mode("overwrite").parquet(f"{out}/manifest")


def _read(data: str, starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, file in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "file"))):
                shard = Shard.open(f"{data}/{file}")
                bounds = [shard.bounds(i) for i in range(len(shard))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.doc_id(i) for i in range(len(shard))], pa.int64()),
                        pa.array([a + starts[part] + before for a, _ in bounds], pa.int64()),
                        pa.array([b - a for a, b in bounds], pa.int64()),
                        pa.array([zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in bounds], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the shards at ``path``: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as 32-bit)."""
    shards = spark.read.parquet(f"{path}/manifest")
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each partition that was written
    starts, at = {}, 0
    for part, n in sorted((r.part, r.n) for r in totals):
        starts[part], at = at, at + n
    return shards.select("part", "before", "file").mapInArrow(_read(f"{path}/data", starts), "doc_id long, start long, n_tokens long, ids_crc32 long")
