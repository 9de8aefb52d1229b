"""Properties that hold for any trace, log or CSV cell."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.functions.policies import OPTIMUM, POLICIES, replay, simulate
from tracewell.functions.sketches import CountMin, SpaceSaving
from tracewell.operators.keyed import Cache, CacheConfig
from tracewell.sources import wal

TRACE = st.lists(st.integers(0, 12), max_size=120)
SLOW = settings(max_examples=60, deadline=None)


@SLOW
@given(TRACE, st.integers(1, 9))
def test_no_policy_beats_the_optimum(keys, capacity):
    best = simulate(keys, capacity, OPTIMUM)
    for name in POLICIES:
        hits, misses = simulate(keys, capacity, name)
        assert hits + misses == len(keys) and hits <= best[0]
        assert misses >= len(set(keys))


@SLOW
@given(TRACE, st.integers(1, 8))
def test_lru_and_optimum_grow_with_capacity(keys, capacity):
    for name in ("LRU", OPTIMUM):
        assert simulate(keys, capacity, name)[0] <= simulate(keys, capacity + 1, name)[0]


@SLOW
@given(TRACE, st.integers(1, 8), st.sampled_from(sorted(POLICIES)))
def test_policy_tracks_residents(keys, capacity, name):
    policy = POLICIES[name](capacity)
    held = set()
    insert, remove = policy.on_insert, policy.on_remove

    def on_insert(key):
        assert key not in held
        held.add(key)
        insert(key)

    def on_remove(key):
        held.remove(key)
        remove(key)

    policy.on_insert, policy.on_remove = on_insert, on_remove
    replay(keys, capacity, policy)
    assert len(held) == min(capacity, len(set(keys)))
    while held:
        out = policy.victim()
        assert out in held
        policy.on_remove(out)
    assert policy.victim() is None


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["get", "put", "invalidate", "wait"]), st.integers(0, 6), st.integers(1, 5)), max_size=80), st.sampled_from(sorted(POLICIES)))
def test_cache_bounds(ops, name):
    cache, now = Cache(CacheConfig(capacity=8, policy=name, weigher=lambda k, v: v, after_write=6), 8), 0
    stored: dict[int, tuple[int, int]] = {}
    for op, key, n in ops:
        if op == "put":
            cache.put(key, n, now)
            stored[key] = (n, now + 6)
        elif op == "invalidate":
            cache.invalidate(key)
            stored.pop(key, None)
        elif op == "get":
            got = cache.get(key, now)
            assert got is None or (stored[key][0] == got and now < stored[key][1])
        else:
            now += n
        assert cache.weight == sum(e.weight for e in cache.entries.values()) <= 8
    cache.expire(now + 100)
    assert not cache.entries and cache.weight == 0


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["put", "invalidate", "clear"]), st.integers(0, 1 << 60), st.text(max_size=5), st.text(max_size=9), st.integers(-1, 1 << 40)), max_size=20), st.data())
def test_logs_round_trip_and_survive_cuts(records, data):
    frames = [wal.encode(*r) for r in records]
    raw = b"".join(frames)
    out, n = wal.decode(raw)
    assert n == len(raw) and [r[0] for r in out] == [r[0] for r in records]
    assert [r[2] for r in out if r[0] != "clear"] == [r[2] for r in records if r[0] != "clear"]
    cut = data.draw(st.integers(0, len(raw)))
    kept, n = wal.decode(raw[:cut])
    assert n <= cut and out[: len(kept)] == kept and n == sum(map(len, frames[: len(kept)]))


@SLOW
@given(st.dictionaries(st.text(max_size=6), st.text(max_size=6), max_size=8))
def test_snapshots_round_trip(entries):
    assert wal.decode_snapshot(wal.encode_snapshot(entries)) == entries


@SLOW
@given(st.lists(st.integers(0, 40), max_size=200), st.integers(1, 10))
def test_sketch_bounds(keys, k):
    s, c = SpaceSaving(k).add_all(keys), CountMin(1 << 12)
    for key in keys:
        c.add(key)
    for key, n in s.top():
        assert keys.count(key) <= n <= keys.count(key) + len(keys) / k
    for key in set(keys):
        assert c.estimate(key) >= min(15, keys.count(key))
