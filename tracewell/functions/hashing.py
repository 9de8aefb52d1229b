"""Bit-exact hashes: as Spark expressions where they run over rows, in numpy where a fold needs them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Constants of murmur3's 32-bit finaliser, SplitMix64 and FNV-1a.
FMIX_A, FMIX_B = 0x85EBCA6B, 0xC2B2AE35
GOLDEN = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
CRC32C_POLY = 0x82F63B78
LOW32 = 0xFFFFFFFF


def _mul32(x: Column, c: int) -> Column:
    """(x * c) mod 2^32 for 0 <= x < 2^32; no step leaves 63 bits."""
    high = F.shiftleft((F.shiftrightunsigned(x, 16) * c).bitwiseAND(0xFFFF), 16)
    return (high + x.bitwiseAND(0xFFFF) * c).bitwiseAND(LOW32)


def fmix32(x: Column) -> Column:
    """murmur3's finaliser of the low 32 bits of a LONG, as 0 <= y < 2^32."""
    x = x.cast("long").bitwiseAND(LOW32)
    x = _mul32(x.bitwiseXOR(F.shiftrightunsigned(x, 16)), FMIX_A)
    x = _mul32(x.bitwiseXOR(F.shiftrightunsigned(x, 13)), FMIX_B)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def spread(key: Column) -> Column:
    """Spread hash of a LONG key: its two halves folded, then finalised."""
    key = key.cast("long")
    return fmix32(key.bitwiseXOR(F.shiftrightunsigned(key, 32)))


def key_hash(key: Column, kind: T.DataType) -> Column:
    """Spread hash of a key of integral type, or of any other by its string's 31-based hash."""
    if isinstance(kind, T.IntegralType):
        return spread(key)

    @F.arrow_udf(T.LongType())
    def hashed(x: pa.Array) -> pa.Array:
        from tracewell.functions.sketches import string_hash

        return pa.array([None if v is None else fmix32_int(string_hash(str(v))) for v in x.to_pylist()], pa.int64())

    return hashed(key)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a LONG key: the top bits of its spread hash. ``shards`` is rounded up to a power of two."""
    bits = next_power_of_two(shards).bit_length() - 1
    return F.shiftrightunsigned(spread(key), 32 - bits).cast("int") if bits else F.lit(0)


def mul64(x: Column, c: int) -> Column:
    """(x * c) mod 2^64 on LONGs by 16-bit limbs, as ANSI arithmetic raises on overflow."""
    a = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    b = [(c >> (16 * i)) & 0xFFFF for i in range(4)]
    out, carry = None, F.lit(0).cast("long")
    for k in range(4):
        total = carry
        for i in range(k + 1):
            total = total + a[i] * b[k - i]
        limb = F.shiftleft(total.bitwiseAND(0xFFFF), 16 * k)
        out = limb if out is None else out.bitwiseOR(limb)
        carry = F.shiftrightunsigned(total, 16)
    return out


def mix64_native(x: Column) -> Column:
    """SplitMix64's finaliser as an expression; short plans only, as each step repeats its input."""
    x = x.cast("long")
    x = mul64(x.bitwiseXOR(F.shiftrightunsigned(x, 30)), MIX_A - (1 << 64))
    x = mul64(x.bitwiseXOR(F.shiftrightunsigned(x, 27)), MIX_B - (1 << 64))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def mix64_array(z: np.ndarray) -> np.ndarray:
    z = z.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


@F.arrow_udf(T.LongType())
def mix64(x: pa.Array) -> pa.Array:
    """SplitMix64's finaliser of a LONG; null for a null."""
    mixed = mix64_array(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).view(np.int64)
    return pa.array(mixed, mask=x.is_null().to_numpy(zero_copy_only=False))


def hash64_array(values: Iterable[str | None]) -> np.ndarray:
    """FNV-1a over UTF-8, finalised by SplitMix64; one numpy step for each byte position. A null hashes as the empty string."""
    raw = [b"" if v is None else v.encode() for v in values]
    size = np.array([len(r) for r in raw])
    out = np.full(len(raw), FNV_START, dtype=np.uint64)
    if len(raw) and size.max():
        table = np.zeros((len(raw), int(size.max())), dtype=np.uint8)
        for i, r in enumerate(raw):
            table[i, : len(r)] = np.frombuffer(r, np.uint8)
        for j in range(table.shape[1]):
            live = size > j
            out[live] = (out[live] ^ table[live, j]) * np.uint64(FNV_PRIME)
    return mix64_array(out)


@F.arrow_udf(T.LongType())
def hash64(value: pa.Array) -> pa.Array:
    """64-bit hash of a STRING; null for a null."""
    return pa.array(hash64_array(value.to_pylist()).view(np.int64), mask=value.is_null().to_numpy(zero_copy_only=False))


def next_power_of_two(n: int) -> int:
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def fmix32_int(x: int) -> int:
    x &= LOW32
    x = ((x ^ (x >> 16)) * FMIX_A) & LOW32
    x = ((x ^ (x >> 13)) * FMIX_B) & LOW32
    return x ^ (x >> 16)


def spread_int(key: int) -> int:
    key &= (1 << 64) - 1
    return fmix32_int(key ^ (key >> 32))


def leading_zeros(x: Column) -> Column:
    """Leading zero bits of a LONG."""
    return F.when(x == 0, 64).otherwise(64 - F.length(F.bin(x)))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C_POLY), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table().tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli); Spark's crc32 has another polynomial."""
    crc = LOW32
    for b in data:
        crc = (crc >> 8) ^ _CRC[(crc ^ b) & 0xFF]
    return crc ^ LOW32
