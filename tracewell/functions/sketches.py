"""Sketches whose exact state matters: ageing counters, a test-and-set filter, top keys, distinct counts."""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterable

import numpy as np

from tracewell.functions.hashing import LOW32, fmix32_int, mix64_array, next_power_of_two, spread_int


def _two_hashes(key: Hashable) -> tuple[int, int]:
    h = spread_int(key) if isinstance(key, int) else fmix32_int(string_hash(str(key)))
    return h, fmix32_int(h)


def string_hash(s: str) -> int:
    """The 31-based polynomial hash of UTF-16 units, 32 bits."""
    h = 0
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (31 * h + (raw[i] << 8 | raw[i + 1])) & LOW32
    return h


class CountMin:
    """Counters up to 15 in ``depth`` rows; only the least counters of a key grow; all halve now and then."""

    MOST = 15

    def __init__(self, expected: int, depth: int = 4):
        self.width = next_power_of_two(max(8, expected))
        self.rows = [bytearray(self.width) for _ in range(depth)]
        self.period, self.added = 10 * max(1, expected), 0

    def _cells(self, key: Hashable) -> list[tuple[bytearray, int]]:
        a, b = _two_hashes(key)
        return [(row, (a + i * b) & (self.width - 1)) for i, row in enumerate(self.rows)]

    def add(self, key: Hashable) -> None:
        cells = self._cells(key)
        least = min(row[at] for row, at in cells)
        if least >= self.MOST:
            return
        for row, at in cells:
            if row[at] == least:
                row[at] += 1
        self.added += 1
        if self.added >= self.period:
            self.added = 0
            self.rows = [bytearray(x >> 1 for x in row) for row in self.rows]

    def estimate(self, key: Hashable) -> int:
        return min(row[at] for row, at in self._cells(key))


class BloomFilter:
    """At least eight bits for each expected key; ``hashes`` places for each."""

    def __init__(self, expected: int, hashes: int = 4):
        if expected < 1 or hashes < 1:
            raise ValueError("expected and hashes must be at least 1")
        self.size, self.hashes = next_power_of_two(max(64, 8 * expected)), hashes
        self.clear()

    def clear(self) -> None:
        self.bits = bytearray(self.size)

    def _places(self, key: Hashable) -> list[int]:
        a, b = _two_hashes(key)
        return [(a + i * b) & (self.size - 1) for i in range(self.hashes)]

    def might_contain(self, key: Hashable) -> bool:
        return all(self.bits[p] for p in self._places(key))

    def seen_before(self, key: Hashable) -> bool:
        """Whether all places were set; they are now."""
        places = self._places(key)
        seen = all(self.bits[p] for p in places)
        for p in places:
            self.bits[p] = 1
        return seen

    add = seen_before


class SpaceSaving:
    """The most frequent keys with ``k`` counters: true count <= estimate <= true count + N / k."""

    def __init__(self, k: int):
        if k < 1:
            raise ValueError("k must be at least 1")
        self.k, self.count, self.heap, self.tick = k, {}, [], 0

    def add(self, key: Hashable) -> None:
        self.tick += 1
        if key not in self.count and len(self.count) >= self.k:
            while True:
                c, _, old = heapq.heappop(self.heap)
                if self.count.get(old) == c:
                    break
            self.count[key] = self.count.pop(old)
        self.count[key] = self.count.get(key, 0) + 1
        heapq.heappush(self.heap, (self.count[key], self.tick, key))

    def add_all(self, keys: Iterable[Hashable]) -> SpaceSaving:
        for key in keys:
            self.add(key)
        return self

    def merge(self, other: SpaceSaving) -> SpaceSaving:
        """Both streams' summary: a key that one side lacks counts there as its least counter."""
        out = SpaceSaving(self.k)
        mine, theirs = (min(s.count.values(), default=0) if len(s.count) >= s.k else 0 for s in (self, other))
        both = {x: self.count.get(x, mine) + other.count.get(x, theirs) for x in {*self.count, *other.count}}
        out.count = dict(sorted(both.items(), key=lambda e: (-e[1], e[0]))[: self.k])
        out.heap = [(c, i, x) for i, (x, c) in enumerate(out.count.items())]
        heapq.heapify(out.heap)
        return out

    def top(self) -> list[tuple[Hashable, int]]:
        return sorted(self.count.items(), key=lambda e: (-e[1], e[0]))


class HyperLogLog:
    """Distinct counts by registers of leading zeros; mergeable by maximum."""

    def __init__(self, p: int = 14):
        if not 4 <= p <= 16:
            raise ValueError(f"p must be 4 to 16, got {p}")
        self.p, self.registers = p, np.zeros(1 << p, dtype=np.uint8)

    def add(self, keys: np.ndarray) -> HyperLogLog:
        h = mix64_array(np.asarray(keys, dtype=np.int64).view(np.uint64))
        rest = h << np.uint64(self.p)
        rank = np.full(len(h), 64 - self.p + 1, dtype=np.uint8)
        some = rest > 0
        # frexp is exact on the top 53 bits once the lowest are cleared by rounding down.
        high = rest[some] & ~np.uint64(0x7FF)
        high = np.where(high > 0, high, rest[some])
        rank[some] = np.minimum(rank[some], 65 - np.frexp(high.astype(np.float64))[1])
        np.maximum.at(self.registers, (h >> np.uint64(64 - self.p)).astype(np.int64), rank)
        return self

    def merge(self, other: HyperLogLog) -> HyperLogLog:
        out = HyperLogLog(self.p)
        out.registers = np.maximum(self.registers, other.registers)
        return out

    def estimate(self) -> int:
        return estimate(self.p, float((2.0 ** -self.registers.astype(np.float64)).sum()), int((self.registers == 0).sum()))


def alpha(m: int) -> float:
    """The bias factor for m registers. Fixed values for 16, 32 and 64."""
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def estimate(p: int, inverse_sum: float, zeros: int) -> int:
    """Raw estimate, or linear counting of empty registers where it is small."""
    m = 1 << p
    raw = alpha(m) * m * m / inverse_sum
    if raw <= 2.5 * m and zeros:
        raw = m * np.log(m / zeros)
    return int(np.floor(raw + 0.5))
