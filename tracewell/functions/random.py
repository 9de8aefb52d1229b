"""SplitMix64 streams that reproduce published traces draw by draw, and weighted samplers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.hashing import GOLDEN, MIX_A, MIX_B

M64 = (1 << 64) - 1
# The 32-bit output function of SplitMix64.
MIX32_A, MIX32_B = 0x62A9D9ED799705F5, 0xCB24D0A5C88C35B3


class SplitMix:
    """A stream of draws from a seed."""

    def __init__(self, seed: int):
        self.state = seed & M64

    def bits64(self) -> int:
        self.state = z = (self.state + GOLDEN) & M64
        z = ((z ^ (z >> 30)) * MIX_A) & M64
        z = ((z ^ (z >> 27)) * MIX_B) & M64
        return z ^ (z >> 31)

    def bits32(self) -> int:
        self.state = z = (self.state + GOLDEN) & M64
        z = ((z ^ (z >> 33)) * MIX32_A) & M64
        return (((z ^ (z >> 28)) * MIX32_B) & M64) >> 32

    def below(self, bound: int) -> int:
        """A uniform integer: a mask for powers of two, else the remainder of 31 bits with the uneven end rejected."""
        if bound & (bound - 1) == 0:
            return self.bits32() & (bound - 1)
        while True:
            u = self.bits32() >> 1
            r = u % bound
            if u + bound - 1 - r < 1 << 31:
                return r

    def real(self) -> float:
        """A uniform double in [0, 1)."""
        return (self.bits64() >> 11) * 2.0**-53


def stream64(seed: int, start: int, n: int) -> np.ndarray:
    """State before output of draws start + 1 .. start + n, as the stream is counter-based."""
    steps = np.arange(start + 1, start + n + 1, dtype=np.uint64)
    return np.uint64(seed & M64) + steps * np.uint64(GOLDEN)


def as_bits32(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(33))) * np.uint64(MIX32_A)
    return ((z ^ (z >> np.uint64(28))) * np.uint64(MIX32_B)) >> np.uint64(32)


def as_real(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Alias:
    """Vose's alias table: a column, and an outcome for what the column's own doesn't fill."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        total = 0.0
        for w in weights.tolist():  # in order, so that rounding is reproducible
            total += w
        height = weights * n / total
        self.share, self.other = np.ones(n), np.arange(n)
        low = np.flatnonzero(height < 1).tolist()
        high = np.flatnonzero(height >= 1).tolist()
        level = height.tolist()
        while low and high:
            a, b = low.pop(), high.pop()
            self.share[a], self.other[a] = level[a], b
            level[b] = level[b] + level[a] - 1.0
            (low if level[b] < 1 else high).append(b)

    @classmethod
    def zipf(cls, keys: int, theta: float) -> Alias:
        return cls(np.array([1.0 / float(i) ** theta for i in range(1, keys + 1)]))

    def draw(self, rng: SplitMix) -> int:
        column = rng.below(len(self.share))
        return column if rng.real() < self.share[column] else int(self.other[column])

    def draws(self, seed: int, n: int) -> np.ndarray:
        """n draws of a new stream at once; falls back to one by one if a draw was rejected."""
        z = stream64(seed, 0, 2 * n)
        bound, u = len(self.share), as_bits32(z[0::2])
        if bound & (bound - 1) == 0:
            column = u & np.uint64(bound - 1)
        else:
            u = u >> np.uint64(1)
            column = u % np.uint64(bound)
            if (u + np.uint64(bound - 1) - column >= np.uint64(1 << 31)).any():
                rng = SplitMix(seed)
                return np.array([self.draw(rng) for _ in range(n)], dtype=np.int64)
        column = column.astype(np.int64)
        return np.where(as_real(z[1::2]) < self.share[column], column, self.other[column])


def zipf_by_inverse(u: Column, keys: int, theta: float) -> Column:
    """A Zipf key from a uniform column: the first key whose cumulative weight is u or more (binary search)."""
    top = np.cumsum(1.0 / np.arange(1, keys + 1, dtype=np.float64) ** theta)
    top /= top[-1]

    @F.pandas_udf(T.LongType())
    def search(x: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(top, x.to_numpy()), keys - 1))

    return search(u)


def jittered(ttl: Column, share: float, u: Column) -> Column:
    """A time to live moved by up to ``share`` of it either way, one nanosecond at least."""
    return F.greatest(F.lit(1), (ttl * (1 + share * (2 * u - 1))).cast("long"))
