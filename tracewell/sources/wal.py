"""Write-ahead logs and snapshots in their binary form.

A log frame is a length (int32), a payload and the payload's CRC-32C (int32), big-endian. A
payload is an op byte (1 put, 2 invalidate, 3 clear), a time (int64, ms) and, by op, the key
(int32 length, UTF-8), the value alike, and a time to live (int64 ms, -1 for none). A
snapshot is a count (int32) and so many keys and values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.hashing import crc32c

OPS = {1: "put", 2: "invalidate", 3: "clear"}
CODES = {v: k for k, v in OPS.items()}
#: Fixed value: a frame that claims more is torn.
MOST = 64 << 20
RECORD = "path string, seq long, op string, ts_millis long, key string, value string, ttl_millis long"


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw


def encode(op: str, ts: int, key: str | None = None, value: str | None = None, ttl: int = -1) -> bytes:
    """One frame."""
    out = struct.pack(">bq", CODES[op], ts)
    if op != "clear":
        out += _text(key or "")
    if op == "put":
        out += _text(value or "") + struct.pack(">q", -1 if ttl is None else ttl)
    return struct.pack(">i", len(out)) + out + struct.pack(">I", crc32c(out))


def _take(raw: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from(">i", raw, at)
    return raw[at + 4 : at + 4 + n].decode(), at + 4 + n


def decode(raw: bytes) -> tuple[list[tuple[str, int, str | None, str | None, int | None]], int]:
    """Records up to the first torn or corrupt frame, and how many bytes are valid.

    An unknown op in a frame whose checksum holds is an error, not a torn tail.
    """
    out, at = [], 0
    while at + 4 <= len(raw):
        (n,) = struct.unpack_from(">i", raw, at)
        if not 0 <= n <= MOST or at + 8 + n > len(raw):
            break
        body = raw[at + 4 : at + 4 + n]
        if crc32c(body) != struct.unpack_from(">I", raw, at + 4 + n)[0]:
            break
        code, ts = struct.unpack_from(">bq", body)
        if code not in OPS:
            raise ValueError(f"unknown op {code} at byte {at}")
        key = value = ttl = None
        if code != 3:
            key, p = _take(body, 9)
            if code == 1:
                value, p = _take(body, p)
                (ttl,) = struct.unpack_from(">q", body, p)
        out.append((OPS[code], ts, key, value, ttl))
        at += 8 + n
    return out, at


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records of the logs at ``path``, one task for each; frames have no marks to split at."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, raw in zip(frame["path"], frame["content"]):
                rows, _ = decode(bytes(raw))
                yield pd.DataFrame([(p, i, *r) for i, r in enumerate(rows)], columns=["path", "seq", "op", "ts_millis", "key", "value", "ttl_millis"]).astype({"ttl_millis": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORD)


def valid_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, valid_length): where each log is to be cut before it is appended to."""

    @F.pandas_udf("long")
    def valid(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: decode(bytes(raw))[1])

    return spark.read.format("binaryFile").load(path).select("path", "length", valid("content").alias("valid_length"))


def append_log(spark: SparkSession, path: str, records: list[tuple]) -> int:
    """Cut a log file after its last whole record and append records (op, ts, key, value, ttl); its new length.

    The new file is written beside the old one, which it then replaces, so a reader never sees
    half of it. The driver holds one log, which must fit a cell as in ``read_logs``.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    old, new = fs_path(path), fs_path(path + ".new")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    held = bytes(spark.read.format("binaryFile").load(path).first()["content"]) if fs.exists(old) else b""
    content = held[: decode(held)[1]] + b"".join(encode(*r) for r in records)
    out = fs.create(new, True)
    out.write(bytearray(content))
    out.hsync()
    out.close()
    if fs.exists(old):
        fs.delete(old, False)
    fs.rename(new, old)
    return len(content)


def encode_log(records: DataFrame) -> DataFrame:
    """(log, content): all records of each ``log`` in order of seq, as the bytes of a log file. A log must fit one task, as its file must."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        ttl = [-1 if pd.isna(t) else int(t) for t in frame["ttl_millis"]]
        raw = b"".join(encode(o, int(t), k, v, x) for o, t, k, v, x in zip(frame["op"], frame["ts_millis"], frame["key"], frame["value"], ttl))
        return pd.DataFrame({"log": [frame["log"].iloc[0]], "content": [raw]})

    return records.groupBy("log").applyInPandas(run, "log string, content binary")


def decode_frames(contents: DataFrame) -> DataFrame:
    """Records of logs in rows (log, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["log"], frame["content"]):
                rows, _ = decode(bytes(raw))
                yield pd.DataFrame([(name, i, *r) for i, r in enumerate(rows)], columns=["path", "seq", "op", "ts_millis", "key", "value", "ttl_millis"]).astype({"ttl_millis": "Int64"})

    return contents.select("log", "content").mapInPandas(run, RECORD)


def encode_snapshot(entries: dict[str, str]) -> bytes:
    return struct.pack(">i", len(entries)) + b"".join(_text(k) + _text(v) for k, v in entries.items())


def decode_snapshot(raw: bytes) -> dict[str, str]:
    (n,), at, out = struct.unpack_from(">i", raw), 4, {}
    for _ in range(n):
        key, at = _take(raw, at)
        out[key], at = _take(raw, at)
    return out


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of snapshot files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, raw in zip(frame["path"], frame["content"]):
                entries = decode_snapshot(bytes(raw))
                yield pd.DataFrame({"path": [p] * len(entries), "key": list(entries), "value": list(entries.values())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, key string, value string")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of the snapshot whose path sorts last."""
    last = snapshots.agg(F.max("path").alias("path"))
    return snapshots.join(F.broadcast(last), "path")
