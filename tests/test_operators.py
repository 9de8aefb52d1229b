"""Operators on small tables with results worked out by hand or by a slow model."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import catalog, keyed, recovery, replay, ring, summaries
from tracewell.plans import matrix
from tracewell.sources import traces, wal


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replay_groups(spark):
    data = [("x", i, k) for i, k in enumerate([1, 2, 1, 3, 1])] + [("y", i, 7) for i in range(4)]
    out = replay.replay(spark.createDataFrame(data, "g string, pos long, key int"), [1, 2], ["LRU", "FIFO", "BELADY-OPTIMAL"], ["g"])
    got = {(r.g, r.policy, r.capacity): (r.hits, r.misses) for r in out.collect()}
    assert got["x", "LRU", 2] == (2, 3) and got["x", "FIFO", 2] == (1, 4) and got["x", "LRU", 1] == (0, 5)
    assert got["y", "LRU", 1] == (3, 1)
    with pytest.raises(ValueError):
        replay.replay(spark.createDataFrame(data, "g string, pos long, key int"), [0])


def test_shards_and_rates(spark):
    rng = random.Random(2)
    t = spark.createDataFrame([(i, rng.randrange(80)) for i in range(2000)], "pos long, key long")
    one = replay.sharded_replay(t, 32, [1]).first()
    assert one.hits == replay.lru_hits(t, [32]).first().hits
    parts = {r.capacity: (r.hits, r.misses) for r in replay.lru_hits_in_parts(t, [1, 8, 32, 79, 200]).collect()}
    assert parts == {r.capacity: (r.hits, r.misses) for r in replay.lru_hits(t, [1, 8, 32, 79, 200]).collect()}
    assert replay.lru_hits_in_parts(t.limit(0), [4]).first().misses == 0
    many = replay.sharded_replay(t, 32, [4]).first()
    assert many.hits + many.misses == 2000
    rate = spark.range(1).select(replay.hit_rate(F.lit(0), F.lit(0)).alias("r")).first().r
    assert rate == 1.0
    caps = spark.range(4).select(replay.shard_capacity(F.col("id"), 10, 4).alias("c")).collect()
    assert [r.c for r in caps] == [3, 3, 2, 2]
    snap = replay.snapshots(t.filter("pos < 50"), 4, "LRU").orderBy("pos").collect()
    assert snap[-1]["state"]["order"][0] == snap[-1]["key"]


def test_snapshots_of_a_trace_in_ranges(spark):
    from tracewell.functions.policies import policy_named

    rng = random.Random(5)
    keys = [f"k{int(rng.expovariate(0.1))}" for _ in range(3000)]
    t = spark.createDataFrame(list(enumerate(keys)), "pos long, key string")
    for name in ("ARC", "RANDOM", "LFU-AGED", "W-TinyLFU"):
        out = replay.snapshots(t, 8, name).withColumn("p", F.spark_partition_id()).orderBy("pos").collect()
        # No task makes the whole trace's rows, and caches go over from range to range.
        assert len({r.p for r in out}) > 1
        p, resident = policy_named(name, 8), set()
        for i, r in enumerate(out):
            hit = replay._request(p, resident, 8, keys[i])
            assert (r.pos, r.key, r.hit, r.state) == (i, keys[i], hit, {k: list(v)[::-1] for k, v in replay._parts(p).items()})
            assert r.facts == ({"target": p.p} if name == "ARC" else {"frequency": p.counts.estimate(keys[i])} if name == "W-TinyLFU" else {})
    assert replay.snapshots(t.limit(0), 8).count() == 0
    # Requests at one pos go by key, and a batch ends before it holds all keys of large caches.
    same = t.select(F.lit(7).alias("pos"), "key")
    assert [r.key for r in replay.snapshots(same, 8).collect()] == sorted(keys)
    wide = spark.createDataFrame([(i, i) for i in range(1500)], "pos int, key int")
    out = replay.snapshots(wide, 1000, "LRU").orderBy("pos").collect()
    assert out[-1].state["order"] == list(range(1499, 499, -1)) and len(out) == 1500
    with pytest.raises(ValueError):
        replay.snapshots(t, 0)


def ops(*rs):
    return [(i, *r) for i, r in enumerate(rs)]


SCHEMA = "pos long, now long, op string, key long, value string, ttl long"


def run(spark, config, *rs):
    out = keyed.run_operations(spark.createDataFrame(ops(*rs), SCHEMA), config).orderBy("pos").collect()
    return [(r.op, r.key, r.answer, r.cause) for r in out if r.answer is not None or r.cause]


def test_cache_expiry(spark):
    c = keyed.CacheConfig(capacity=2, after_write=10)
    got = run(spark, c, (0, "put", 1, "a", None), (9, "get", 1, None, None), (10, "contains", 1, None, None), (10, "get", 1, None, None), (11, "put", 2, "b", 5), (16, "put", 3, "c", None))
    assert got == [("get", 1, "a", None), ("contains", 1, "false", None), ("removal", 1, "a", "EXPIRED"), ("removal", 2, "b", "EXPIRED")]
    c = keyed.CacheConfig(capacity=2, after_access=10)
    got = run(spark, c, (0, "put", 1, "a", None), (9, "get", 1, None, None), (18, "get", 1, None, None), (28, "get", 1, None, None))
    assert got == [("get", 1, "a", None), ("get", 1, "a", None), ("removal", 1, "a", "EXPIRED")]
    c = keyed.CacheConfig(capacity=2, after_write=15, after_access=10)  # the earlier deadline counts
    got = run(spark, c, (0, "put", 1, "a", None), (9, "get", 1, None, None), (15, "get", 1, None, None))
    assert got == [("get", 1, "a", None), ("removal", 1, "a", "EXPIRED")]


def test_cache_expired_before_victims(spark):
    c = keyed.CacheConfig(capacity=2)
    got = run(spark, c, (0, "put", 1, "a", None), (0, "put", 2, "b", 5), (6, "put", 3, "c", None), (7, "put", 4, "d", None))
    assert got == [("removal", 2, "b", "EXPIRED"), ("removal", 1, "a", "SIZE")]


def test_cache_weights_and_causes(spark):
    c = keyed.CacheConfig(capacity=10, weigher=lambda k, v: len(v))
    got = run(
        spark, c, (0, "put", 1, "aaaa", None), (1, "put", 2, "bbbb", None), (2, "put", 3, "c" * 11, None), (3, "put", 1, "aa", None), (4, "put", 2, "b" * 8, None), (5, "put", 4, "dddd", None), (6, "invalidate", 4, None, None), (7, "put", 5, "e", None), (8, "clear", None, None, None)
    )
    assert got == [
        ("removal", 1, "aaaa", "REPLACED"), ("removal", 2, "bbbb", "REPLACED"), ("removal", 1, "aa", "SIZE"), ("removal", 2, "b" * 8, "SIZE"), ("removal", 4, "dddd", "EXPLICIT"), ("removal", 5, "e", "EXPLICIT"),
    ]
    auto = spark.createDataFrame([(c,) for c in keyed.CAUSES], "c string").filter(keyed.was_automatic(F.col("c")))
    assert rows(auto) == [("EXPIRED",), ("SIZE",)]


@pytest.mark.parametrize("bad", [{"capacity": 0}, {"policy": "X"}, {"after_write": -1}, {"jitter": 1.0}, {"shards": 3}])
def test_config(bad):
    with pytest.raises(ValueError):
        keyed.CacheConfig(**bad)


def test_load_merge_and_tags(spark):
    req = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, 3)], "pos long, key long")
    cached = spark.createDataFrame([(1, "c")], "key long, value string")
    source = spark.createDataFrame([(1, "s"), (2, "s")], "key long, value string")
    assert rows(keyed.load_through(req, cached, source).select("pos", "value", "loaded")) == [(0, "c", False), (1, "s", True), (2, "s", True)]
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, price long")
    new = spark.createDataFrame([(1, None, 9), (7, "z", 1)], "id long, name string, price long")
    assert rows(keyed.merge(base, new, "id", ["name", "price"])) == [(1, "a", 9), (2, "b", 6)]
    tags = spark.createDataFrame([("t", 1), ("t", 99)], "tag string, key long")
    assert rows(keyed.invalidate_by_tag(source, tags, "t")) == [(2, "s")]
    assert rows(keyed.keys_of_tag(source, tags, "t")) == [(1, "s")]


def test_idle_boundary(spark):
    t = spark.createDataFrame([(1, 0, 0), (1, 1, 9), (1, 2, 19), (1, 3, 28)], "key long, pos long, now long")
    assert [r.hit for r in keyed.idle_expiry(t, 10).orderBy("pos").collect()] == [False, True, False, True]
    assert [r.hit for r in keyed.write_expiry(t, 20).orderBy("pos").collect()] == [False, True, True, False]


def test_percentiles(spark):
    hundred = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "i long, v double")
    r = summaries.last_percentiles(hundred, "v", "i", 100).first()
    assert (r.p50, r.p99, r.p999) == (51.0, 100.0, 100.0)
    last = spark.createDataFrame([(i, 5.4) for i in range(1000)] + [(1000, 500.0)], "i long, v double")
    r = summaries.last_percentiles(last, "v", "i", 10).first()
    assert (r.p50, r.p99) == (5.0, 500.0)
    none = summaries.last_percentiles(hundred.limit(0), "v", "i", 10).first()
    assert none.p50 == 0.0


def test_counters(spark):
    t = spark.createDataFrame([(1, 5), (2, 9), (3, 2)], "t long, c long")
    assert [r.c_delta for r in summaries.counter_deltas(t, "t", ["c"]).orderBy("t").collect()] == [5, 4, 0]
    s = summaries.merge_counters(spark.createDataFrame([(0, 0)], "hits long, misses long")).first()
    assert s.hit_rate == 1.0 and s.miss_rate == 0.0
    v = summaries.variant_report(spark.createDataFrame([("off", 2.0, True), ("a", 1.0, True), ("a", 3.0, False)], "variant string, millis double, hit boolean"))
    assert rows(v) == [("a", 2, 2.0, 0.5), ("off", 1, 2.0, 0.0)]
    x = spark.range(1).select(summaries.fill_percent(F.lit(1), F.lit(0)), summaries.write_reduction(F.lit(4), F.lit(1)), summaries.per_second(F.lit(3), F.lit(0.0)), summaries.heat_bucket(F.lit(9), F.lit(9), 5)).first()
    assert tuple(x) == (0.0, 0.75, 3000.0, 4)


def test_catalog(spark):
    c = catalog.seed_catalog(spark, 50)
    again = catalog.seed_catalog(spark, 50)
    assert rows(c["review"]) == rows(again["review"])
    p = c["product"].agg(F.min("price_cents"), F.max("price_cents")).first()
    assert 500 <= p[0] <= p[1] < 50_000
    detail = catalog.product_details(**c)
    assert detail.columns == catalog.DETAIL and detail.count() == 50
    by_product = {r.product_id: r for r in detail.collect()}
    r = c["review"].groupBy("product_id").agg(F.avg("rating").alias("a"), F.count("*").alias("n")).collect()
    assert all(abs(by_product[x.product_id].avg_rating - x.a) < 1e-9 and by_product[x.product_id].review_count == x.n for x in r)
    none = [x for x in by_product.values() if x.review_count == 0]
    assert all(x.avg_rating == 0 for x in none)
    assert catalog.find_details(**c, product_id=3).count() == 1 and catalog.find_details(**c, product_id=999).count() == 0
    assert catalog.exists(c["product"], 50) and not catalog.exists(c["product"], 51)
    assert [x.id for x in catalog.search_by_name(c["product"], "PRODUCT 1", size=3).collect()] == [1, 10, 11]
    assert catalog.search_by_name(c["product"], "product _").count() == 20


def test_ring(spark):
    five = ring.Ring([f"node-{i}" for i in range(5)])
    keys = spark.range(50_000).select(F.concat(F.lit("product:"), "id").alias("k"))
    spread = ring.fairness(keys.select(five.owner_of(F.col("k")).alias("owner"))).first()
    assert spread.nodes == 5 and spread.spread_percent < 5
    assert ring.fairness(keys.select(ring.Ring(five.nodes, 160).owner_of(F.col("k")).alias("owner"))).first().spread_percent > 5
    four = five.remove("node-4")
    share = ring.moved(keys, "k", four, five).first()[0]
    assert 0.1 < share < 0.35 and ring.moved_by_modulo(keys, "k", 4, 5).first()[0] > 0.6
    assert five.add("node-4").nodes == five.nodes and ring.Ring([]).owner_of(F.lit("x")) is not None
    r = keys.limit(200).select(five.owner_of(F.col("k")).alias("o"), five.replicas_of(F.col("k"), 2).alias("r"), four.owner_of(F.col("k")).alias("f"), five.replicas_of(F.col("k"), 9).alias("all")).collect()
    assert all(x.r[0] == x.o and len(set(x.r)) == 2 and len(set(x["all"])) == 5 for x in r)
    assert all(x.f == next(n for n in x["all"] if n != "node-4") for x in r)


def test_cluster_rules(spark):
    pings = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([True, False, False, True, False, False, False, False, True])], "node string, seq long, ok boolean")
    assert rows(ring.health_changes(pings)) == [("a", 6, False), ("a", 8, True)]
    keys = spark.createDataFrame([("k1", ["a", "b"]), ("k2", ["b", "a"]), ("k3", ["a", "b"])], "key string, replicas array<string>")
    stored = spark.createDataFrame([("b", "k1", "v"), ("a", "k2", "w"), ("b", "k3", "x")], "node string, key string, value string")
    health = spark.createDataFrame([("a", False), ("b", True)], "node string, healthy boolean")
    assert rows(ring.read_with_fallback(keys, stored, health)) == [("k1", "b", "v"), ("k2", "b", None), ("k3", "b", "x")]
    acks = spark.createDataFrame([("k", True), ("k", False), ("l", False)], "key string, ok boolean")
    assert rows(ring.write_status(acks)) == [("k", 204), ("l", 503)]


def test_traces(spark, tmp_path):
    (tmp_path / "t").write_text("# head\n5\n\n 7 \n5\n")
    assert rows(traces.integer_keys(spark, str(tmp_path / "t"))) == [(0, 5), (1, 7), (2, 5)]
    (tmp_path / "s").write_text("b\na\nb\nc\n")
    assert rows(traces.string_keys(spark, str(tmp_path / "s"))) == [(0, 0), (1, 1), (2, 0), (3, 2)]
    (tmp_path / "e").write_text("")
    assert rows(traces.string_keys(spark, str(tmp_path / "e"))) == []
    (tmp_path / "bad").write_text("x\n")
    with pytest.raises(Exception):  # noqa: B017
        traces.integer_keys(spark, str(tmp_path / "bad")).collect()


def test_matrix(spark, tmp_path):
    m = matrix.hit_ratio_matrix(spark, 500, (50,), (1, 2), ["zipf-0.99", "loop"], ["LRU", "RANDOM", "BELADY-OPTIMAL"])
    traces.write_results(m, str(tmp_path / "r"))
    back = traces.read_csv(spark, str(tmp_path / "r"))
    assert back.count() == 12 and {r.workload_params for r in back.collect()} == {"keySpace=5000,theta=0.99", "size=capacity+1"}
    best = matrix.ranking(back, "loop", 50).collect()
    assert [r.policy for r in best][0] == "BELADY-OPTIMAL" and best[-1].hit_percent == 0
    assert matrix.mean_rates(back).count() == 6 and [r[0] for r in matrix.choices(back, "workload").collect()] == ["loop", "zipf-0.99"]


def test_wal(spark, tmp_path):
    good = wal.encode("put", 1, "a", "1") + wal.encode("put", 2, "b", "2", 50) + wal.encode("invalidate", 3, "a")
    assert [r[0] for r in wal.decode(good)[0]] == ["put", "put", "invalidate"] and wal.decode(good)[1] == len(good)
    for torn in (good[:-3], good + b"\0\0", good[:-1] + b"X", good + b"\x7f\xff\xff\xff1234"):
        out, n = wal.decode(torn)
        assert len(out) >= 2 and n <= len(good)
    body = b"\x09" + b"\0" * 8
    import struct

    from tracewell.functions.hashing import crc32c

    with pytest.raises(ValueError):
        wal.decode(struct.pack(">i", len(body)) + body + struct.pack(">I", crc32c(body)))
    (tmp_path / "1.log").write_bytes(good + b"junk")
    recs = wal.read_logs(spark, str(tmp_path / "1.log"))
    assert rows(recovery.recover(recs, now=10)) == [("b", "2")] and rows(recovery.recover(recs, now=52)) == []
    assert wal.valid_lengths(spark, str(tmp_path / "1.log")).first().valid_length == len(good)
    (tmp_path / "s1").write_bytes(wal.encode_snapshot({"x": "0"}))
    (tmp_path / "s2").write_bytes(wal.encode_snapshot({"a": "9", "z": "8"}))
    snap = wal.latest_snapshot(wal.read_snapshots(spark, str(tmp_path / "s*"))).select("key", "value")
    assert rows(snap) == [("a", "9"), ("z", "8")]
    assert rows(recovery.recover(recs, 10, snap)) == [("b", "2"), ("z", "8")]
    cleared = spark.createDataFrame([(9, "clear", 4, None, None, None)], "seq long, op string, ts_millis long, key string, value string, ttl_millis long")
    assert rows(recovery.recover(recs.drop("path").select(cleared.columns).unionByName(cleared), 10, snap)) == []


def test_recovery_against_fold(spark):
    rng, data, state = random.Random(4), [], {}
    for i in range(400):
        op, k = rng.choices(["put", "invalidate", "clear"], [8, 3, 0.05])[0], f"k{rng.randrange(30)}"
        ttl = rng.choice([-1, 0, 100])
        data.append((i, op, i, k, f"v{i}", ttl))
        if op == "put" and (ttl < 0 or i + ttl > 420):
            state[k] = f"v{i}"
        elif op != "clear":
            state.pop(k, None)
        else:
            state.clear()
    df = spark.createDataFrame(data, "seq long, op string, ts_millis long, key string, value string, ttl_millis long")
    assert dict(rows(recovery.recover(df, 420))) == state


def test_store(spark, tmp_path):
    s = recovery.DurableStore(spark, str(tmp_path / "d"), compact_every=3)
    s.put("a", "1", 0)
    s.put("b", "2", 0, 5)
    assert s.get("b", 4) == "2" and s.get("b", 5) is None
    s.invalidate("a", 1)
    assert s.generation == 1 and s.size(100) == 1  # compacted at 1, when b was live: it has no time to live now
    s.clear(2)
    assert s.size(3) == 0


def test_store_reopened(spark, tmp_path):
    path = str(tmp_path / "d")
    s = recovery.DurableStore(spark, path)
    s.put("a", "1", 0)
    s.put("a", "2", 1)
    s.put("t", "x", 2, 100)
    s = recovery.DurableStore(spark, path)
    s.put("a", "3", 3)
    assert s.get("a", 4) == "3" and s.get("t", 101) == "x" and s.get("t", 102) is None  # its time runs on while the store is closed
    s.put("gone", "y", 5)
    s.compact(50)
    s.invalidate("gone", 51)
    s = recovery.DurableStore(spark, path)
    assert s.generation == 1 and s.size(60) == 2 and s.get("gone", 60) is None
    s.put("b", "4", 61)
    (tmp_path / "d/snapshot=2").mkdir()  # of a compaction that was cut off: no mark of success
    s = recovery.DurableStore(spark, path)
    assert s.generation == 1 and sorted(rows(s.state(70))) == [("a", "3"), ("b", "4"), ("t", "x")]
    s.clear(80)
    assert recovery.DurableStore(spark, path).size(90) == 0


def test_log_is_cut_and_appended(spark, tmp_path):
    path = str(tmp_path / "a.log")
    assert wal.append_log(spark, path, [("put", 1, "a", "1", None), ("put", 2, "b", "2", 50)]) == len((tmp_path / "a.log").read_bytes())
    with open(path, "ab") as f:
        f.write(wal.encode("put", 3, "c", "3")[:-2])  # torn
    (tmp_path / ".a.log.crc").unlink(missing_ok=True)
    wal.append_log(spark, path, [("invalidate", 4, "a")])
    recs = wal.read_logs(spark, path)
    assert [(r.op, r.key) for r in recs.orderBy("seq").collect()] == [("put", "a"), ("put", "b"), ("invalidate", "a")]
    assert wal.valid_lengths(spark, path).first().valid_length == len((tmp_path / "a.log").read_bytes())


def test_nulls_and_repeats(spark):
    r = ring.Ring(["a", "b", "c"])
    keys = spark.createDataFrame([("x",), (None,), ("",)], "key string")
    out = {x.key: x for x in keys.select("key", r.owner_of(F.col("key")).alias("o"), r.replicas_of(F.col("key"), 2).alias("r")).collect()}
    assert out[None].o is None and out[None].r is None and out["x"].o == out["x"].r[0] and out[""].o in "abc"
    big = (1 << 53) + 1
    longs = spark.createDataFrame([(1,), (None,), (big,), (big - 1,)], "key long")
    assert summaries.hll_estimate(summaries.hll_registers(longs, "key")).first().estimate == 3
    assert summaries.hll_estimate(summaries.hll_registers(spark.createDataFrame([(1,), (None,)], "key long"), "key")).first().estimate == 1
    base = spark.createDataFrame([(1, "a", 5)], "id int, name string, price int")
    updates = spark.createDataFrame([(1, 1, "b", None), (1, 2, None, 7), (1, 3, "c", None), (None, 4, "z", 1)], "id int, seq int, name string, price int")
    assert rows(keyed.merge(base, updates, "id", ["name", "price"], "seq")) == [(1, "c", 7)]
    assert rows(keyed.merge(base, updates.filter("seq < 3"), "id", ["name", "price"])) == [(1, "b", 7)]
    with pytest.raises(Exception, match="name their order"):
        keyed.merge(base, updates, "id", ["name", "price"]).collect()


def test_cache_counts_and_clean_up(spark):
    ops = [(0, 0, "put", 1, "a", 10), (1, 1, "put", 2, "b", None), (2, 2, "get", 1, None, None), (3, 3, "get", 9, None, None), (4, 20, "clean", None, None, None), (5, 21, "put", 3, "c", None), (6, 22, "put", 4, "d", None)]
    df = spark.createDataFrame(ops, "pos long, now long, op string, key long, value string, ttl long")
    events = keyed.run_operations(df, keyed.CacheConfig(capacity=2, policy="lru"), counts=True)
    removed = [(r.pos, r.key, r.cause) for r in events.filter("op = 'removal'").collect()]
    assert removed == [(4, 1, "EXPIRED"), (6, 2, "SIZE")]
    assert tuple(keyed.cache_counts(events).first()) == (0, 1, 1, 1, 0, 1, 2, 2)


def test_hot_swap(spark):
    t = spark.createDataFrame([(i, i) for i in range(6)], "pos long, key long")
    c = spark.createDataFrame([(2,), (5,)], "pos long")
    assert [r.segment for r in keyed.hot_swap(t, c).orderBy("pos").collect()] == [0, 0, 1, 1, 1, 2]


def test_streams(spark, tmp_path):
    from tracewell.streaming import live

    e = spark.createDataFrame([(1, "2024-01-01 00:00:00.01", 1, "view", 1.0, "{}"), (2, "2024-01-01 00:00:00.05", 2, "view", 3.0, "{}"), (3, "2024-01-01 00:00:00.15", 1, "view", 2.0, "{}")], "event_id long, ts string, user_id long, event_type string, value double, props string")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.requests, r["keys"], r.top_value) for r in live.ticks(e).orderBy("tick").collect()] == [(2, 2, 3.0), (1, 1, 2.0)]
    e.write.parquet(str(tmp_path / "in"))
    live.run_available(live.ticks(live.read_requests(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    seen = []
    q = live.write_behind(live.read_requests(spark, str(tmp_path / "in")).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value"), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [(1, 3, 2.0), (2, 2, 3.0)]


def test_patterns_and_chaos(spark):
    from tracewell.operators import patterns

    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id long, name string, price long")
    new = spark.createDataFrame([(2, None, 20), (9, "z", 9)], "id long, name string, price long")
    after, cached = patterns.write_through(base, base.filter("id = 1"), new, "id", ["name", "price"])
    assert rows(after) == [(1, "a", 1), (2, "b", 20), (3, "c", 3)] and rows(cached) == [(1, "a", 1), (2, "b", 20)]
    assert rows(patterns.write_around(base, base, new, "id", ["price"])[1]) == [(1, "a", 1), (3, "c", 3)]
    assert rows(patterns.write_back(base.limit(0), new, "id", ["price"])) == []
    storm = patterns.stampede(spark, 7, 500)
    assert patterns.loads(storm).first().loads == 1 and patterns.loads(storm, False).first().loads == 500
    warm = patterns.scan_keys(spark, 0, 10)
    config = keyed.CacheConfig(capacity=10)
    assert patterns.chaos_report(warm, warm, config).first().hits == 10
    assert patterns.chaos_report(warm.unionByName(patterns.expire_all(spark, 10)), warm, config).first().hits == 0
    assert tuple(patterns.chaos_report(warm, patterns.penetrate(spark, 100, 5), config).first()) == (0, 5, 0.0)


def test_frames_of_full_ticks(spark, tmp_path):
    import duckdb

    from tracewell.operators import frames
    from tracewell.queries import FRAME_SQL, QUERIES

    # Two hours: one of 5,000 requests, more than a ring of samples; one with nulls, ties and a user that is unknown.
    made = """SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(i // 7 * 3) AS ts, i * i % 301 AS user_id, 'view' AS event_type, (i * 7919 % 5000) / 8.0 - i // 100 AS value, '' AS props FROM range(5000) t(i)
        UNION ALL SELECT 5000 + i, TIMESTAMP '2024-01-01 01:00:00', CASE WHEN i % 2 = 0 THEN 4 END, 'view', CASE WHEN i > 5 THEN -0.5 * i END, '' FROM range(10) t(i)
        UNION ALL SELECT 6000 + i, TIMESTAMP '2024-01-01 02:00:00', i, 'view', NULL, '' FROM range(3) t(i)"""
    with duckdb.connect() as db:
        db.execute(f"CREATE TABLE events AS {made}")
        db.execute(f"COPY events TO '{tmp_path}/events.parquet'")
        want = sorted(db.sql(FRAME_SQL).fetchall())
    assert len(want) == 3 and sorted(map(tuple, QUERIES["live_frames"](spark, str(tmp_path)).collect())) == want
    # The operator's own samples: of requests at one time the slowest are the last, in whatever order they come.
    t = spark.createDataFrame([(i // 50, 1, True, float(i % 50)) for i in range(100)], "now long, key long, hit boolean, millis double")
    for rows_ in (t, t.orderBy("millis"), t.orderBy(F.desc("millis"))):
        assert tuple(frames.frames(rows_, 100, 10, "LRU", samples=10).first().latencyMs) == (45.0, 49.0, 49.0, 49.0)


def test_frames_and_reports(spark):
    from tracewell.operators import frames

    t = spark.createDataFrame([(i * 10, i % 3, i % 2 == 0, float(i)) for i in range(20)], "now long, key long, hit boolean, millis double")
    out = frames.frames(t, 100, 10, "LRU").orderBy("timestampMillis").collect()
    assert len(out) == 2 and out[0].opsPerSecond == 100 and out[0].hitRatePercent == 50 and out[0].latencyMs.p50 == 5 and out[0].capacityFillPercent == 30
    assert [(k.key, k["count"]) for k in out[0].topKeys] == [(0, 4), (1, 3), (2, 3)]
    res = spark.createDataFrame([("a", 1, 3), ("b", 3, 1), ("a", 1, 3)], "policy string, hits long, misses long")
    assert [(r.policy, r.place) for r in frames.standings(res).orderBy("place").collect()] == [("b", 1), ("a", 2)]
    run_ = matrix.trace_run(spark.createDataFrame([(i, i % 5) for i in range(50)], "pos long, key long"), [5])
    assert run_.first().distinct_keys == 5 and "LRU" in matrix.text_report(run_) and "90.00 %" in matrix.text_report(run_)
    chart = spark.createDataFrame([(10, "A", 1, 5.0), (10, "B", 1, 6.0), (10, "A", 2, 7.0), (50, "A", 1, 9.0)], "capacity_percent int, impl string, threads int, ops_per_ms double")
    assert rows(matrix.scaling_chart(chart, 10, ["A", "B"])) == [(1, 5.0, 6.0), (2, 7.0, None)]


def test_jdbc(spark):
    from tracewell.sources import jdbc

    url = "jdbc:derby:memory:tracewell;create=true"
    data = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id long, name string")
    jdbc.insert(data, url, "items", batch=10, mode="overwrite")
    assert rows(jdbc.find(spark, url, "items", "id", 7)) == [(7, "n7")]
    assert jdbc.read_table(spark, url, "items", "id", (0, 50), 3).count() == 50


def test_url_pieces(spark):
    from tracewell.functions.text import key_path, query_parameter

    q = spark.createDataFrame([("a=1&key=x%20y&key=z",), ("b=1",), ("",)], "q string")
    assert [r[0] for r in q.select(query_parameter(F.col("q"), "key")).collect()] == ["z", None, None]
    assert spark.range(1).select(key_path("/kv/", F.lit("a/b c"))).first()[0] == "/kv/a%2Fb+c"


def test_global_order(spark):
    from tracewell.operators.order import asof, with_rank

    rng = random.Random(9)
    values = rng.sample(range(10**6), 500)
    ranked = with_rank(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), [F.desc("v")])
    assert [r.v for r in ranked.orderBy("rank").collect()] == sorted(values, reverse=True) and {r["rank"] for r in ranked.collect()} == set(range(500))
    marks = rng.sample(range(10**6), 40)
    left = spark.createDataFrame([(v, i) for i, v in enumerate(values + marks[:3])], "k long, i long")
    right = spark.createDataFrame([(m, f"m{m}") for m in marks], "k long, name string")
    for forward in (False, True):
        for r in asof(left, right, "k", "name", forward).collect():
            near = [m for m in marks if (m >= r.k if forward else m <= r.k)]
            assert r.name == (f"m{min(near) if forward else max(near)}" if near else None)
    assert asof(left, right.limit(0), "k", "name").filter("name is not null").isEmpty() and asof(left.limit(0), right, "k", "name").isEmpty()
