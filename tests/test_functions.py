"""Hashes, random streams and sketches: check values, error bounds, Spark against Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import hashing
from tracewell.functions.random import Alias, SplitMix, jittered, zipf_by_inverse
from tracewell.functions.sketches import BloomFilter, CountMin, HyperLogLog, SpaceSaving, string_hash


def test_check_values():
    r = SplitMix(1)
    assert [r.below(5000) for _ in range(3)] == [2926, 3302, 881]
    assert hashing.crc32c(b"123456789") == 0xE3069283
    assert hashing.crc32c(b"123456789") != zlib.crc32(b"123456789")
    assert hashing.fmix32_int(0) == 0 and hashing.fmix32_int(1) == 0x514E28B7
    assert [hashing.next_power_of_two(n) for n in (0, 1, 2, 3, 8, 9)] == [1, 1, 2, 4, 8, 16]
    assert string_hash("hello") == 99162322


def test_hashes_in_spark(spark):
    keys = [0, 1, -1, 5, 1 << 40, -(1 << 62), (1 << 63) - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = df.select("k", hashing.spread(F.col("k")).alias("s"), hashing.mix64(F.col("k")).alias("m"), hashing.mix64_native(F.col("k")).alias("n"), hashing.shard_of(F.col("k"), 8).alias("h"), hashing.shard_of(F.col("k"), 1).alias("one"), hashing.leading_zeros(F.col("k")).alias("z")).collect()
    for r in rows:
        assert r.s == hashing.spread_int(r.k)
        assert r.m == r.n == int(hashing.mix64_array(np.array([r.k]).view(np.uint64)).view(np.int64)[0])
        assert r.h == r.s >> 29 and r.one == 0
        assert r.z == 64 - (r.k & (2**64 - 1)).bit_length()
    names = spark.createDataFrame([("",), ("a",), ("é",), ("product:12",)], "s string")
    for r in names.select("s", hashing.hash64("s").alias("h")).collect():
        h = hashing.FNV_START
        for b in r.s.encode():
            h = (h ^ b) * hashing.FNV_PRIME % 2**64
        assert r.h == int(hashing.mix64_array(np.array([h], dtype=np.uint64)).view(np.int64)[0])


def test_samplers(spark):
    a = Alias(np.array([1.0, 2.0, 3.0, 4.0]))
    drawn = a.draws(3, 40_000)
    assert np.allclose(np.bincount(drawn) / 40_000, [0.1, 0.2, 0.3, 0.4], atol=0.01)
    r = SplitMix(3)
    assert drawn[:50].tolist() == [a.draw(r) for _ in range(50)]
    z = spark.range(20_000).select(zipf_by_inverse(F.rand(1), 50, 1.0).alias("k")).groupBy("k").count().toPandas().set_index("k")["count"]
    assert abs(z[0] / z[1] - 2) < 0.25
    j = spark.range(1000).select(jittered(F.lit(1000), 0.1, F.rand(2)).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert 900 <= j[0] < 910 and 1090 < j[1] <= 1100


def test_count_min():
    s, true, rng = CountMin(512), {}, random.Random(42)
    for _ in range(2000):
        k = rng.randrange(300)
        s.add(k)
        true[k] = true.get(k, 0) + 1
    assert all(s.estimate(k) >= min(n, 15) for k, n in true.items())
    for _ in range(40):
        s.add("hot")
    assert s.estimate("hot") == 15
    t = CountMin(1)
    for i in range(10):
        t.add(i % 2)
    assert t.estimate(0) <= 3  # ten adds halve all counters


def test_bloom():
    b = BloomFilter(1000, 4)
    assert not any(b.seen_before(k) for k in range(5))
    for k in range(1000):
        b.add(k)
    assert all(b.might_contain(k) for k in range(1000))
    assert sum(b.might_contain(k) for k in range(10_000, 20_000)) < 500
    b.clear()
    assert not b.might_contain(1)
    with pytest.raises(ValueError):
        BloomFilter(0)


def test_space_saving():
    rng, keys = random.Random(3), []
    for _ in range(100_000):
        keys.append(rng.randrange(10) if rng.random() < 0.5 else 100 + rng.randrange(5000))
    true = {}
    for k in keys:
        true[k] = true.get(k, 0) + 1
    whole = SpaceSaving(20).add_all(keys)
    assert all(true[k] <= n <= true[k] + len(keys) / 20 for k, n in whole.top())
    parts = SpaceSaving(40).add_all(keys[:50_000]).merge(SpaceSaving(40).add_all(keys[50_000:]))
    assert {k for k, _ in parts.top()[:10]} == set(range(10))
    assert all(true[k] <= n <= true[k] + len(keys) / 40 for k, n in parts.top())


@pytest.mark.parametrize("n", [0, 10, 5000, 200_000])
def test_hll(n):
    h = HyperLogLog(14).add(np.arange(n))
    assert abs(h.estimate() - n) <= max(2, 6 * 1.04 / 128 * n)
    a, b = HyperLogLog(14).add(np.arange(0, n, 2)), HyperLogLog(14).add(np.arange(1, n, 2))
    assert a.merge(b).estimate() == h.estimate()


def test_hll_in_spark(spark):
    from tracewell.operators.summaries import hll_estimate, hll_registers

    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    for p in (4, 10, 14):
        assert hll_estimate(hll_registers(df, "id", p), p).first()[0] == HyperLogLog(p).add(np.arange(5000)).estimate()
    two = {r.g: r.estimate for r in hll_estimate(hll_registers(df, "id", 12, ["g"]), 12, ["g"]).collect()}
    assert two[1] == HyperLogLog(12).add(np.arange(1, 5000, 2)).estimate()
    with pytest.raises(ValueError):
        hll_registers(df, "id", 3)
