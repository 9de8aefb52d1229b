"""Words, hashes and near-duplicates, substring dedup, decontamination against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import decontaminate, neardup, substrings
from tracewell.llm.components import components
from tracewell.llm.storage import Scratch
from tracewell.llm.textops import Words, grams, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, kept string, a long, score string"


def frame(spark, pairs):
    """(doc_id, text) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in pairs], DOCS)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_words_and_grams():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t\x0bABC.longer_word_here ") for _ in range(rng.choice([0, 1, 9, 90]))) for _ in range(300)] + [None, " ", "x" * 50]
    for lower in (False, True):
        w = Words(pa.array(texts), lower)
        found = [[w.data[w.starts[k] : w.ends[k]].tobytes().decode() for k in range(a, b)] for a, b in zip(w.bounds, w.bounds[1:])]
        assert found == [WORD.findall((t or "").translate(LOWER) if lower else t or "") for t in texts]
        flat, h = [x for ws in found for x in ws], w.hashes()
        assert len({*zip(flat, h.tolist())}) == len({*flat}) == len({*h.tolist()})
        for k in (2, 20):
            g = grams(h, k)
            assert len({*g.tolist()}) == len({tuple(flat[i : i + k]) for i in range(len(g))})


def test_slices_bound_and_keep_all():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 200, 7, 3)])], ["text"])
    parts = list(slices(iter([batch]), limit=12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 2]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()))
    assert all(got[x] == root(x) for x in got)
    assert {x for a, b in links if a != b for x in (a, b)} == set(got)


def similar(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize(("k", "percent"), [(2, 80), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rng = random.Random(k)
    texts = []
    for g in range(12):
        base = sentence(rng, rng.choice([6, 40, 120])).split()
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper())
    texts += [None, "", " \n ", "one", "ONE", "one two", "One two", "a a a a a a a"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    pairs = [(1000 + i, texts[j]) for i, j in enumerate(order)]
    want, sets = similar(pairs, k, percent)
    got = neardup.near_duplicates(frame(spark, pairs), shingle=k, percent=percent).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id][0])
        assert r.kept == (r.doc_id == r.component_id)


def edited(rng, words, edits):
    w = list(words)
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"x{rng.randrange(10**9)}"
    return " ".join(w)


def test_near_duplicates_across_blocks(spark):
    """Copies of copies that link in places only, in many small blocks, equal all pairs."""
    rng = random.Random(17)
    base = sentence(rng, 90, 5000).split()
    near = [edited(rng, base, rng.choice([1, 3, 4, 5, 5])).split() for _ in range(40)]
    pairs = list(enumerate([" ".join(w) for w in near] + [edited(rng, rng.choice(near), rng.choice([1, 4, 5])) for _ in range(80)]))
    want, _ = similar(pairs, 2, 80)
    assert len(set(want.values())) > 3
    got = neardup.near_duplicates(frame(spark, pairs), shingle=2, block_rows=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicate_rows_grow_with_the_group(spark, monkeypatch):
    """No step makes rows by the square of a group's size, whether its copies link or none do."""
    counts = []
    plain = Scratch.table

    def table(self, df):
        out = plain(self, df)
        counts[-1] = max(counts[-1], out.count())
        return out

    monkeypatch.setattr(Scratch, "table", table)
    rng = random.Random(23)
    base = sentence(rng, 100, 5000).split()
    for edits in ([6], [1, 2, 3, 4, 5]):
        counts.clear()
        for n in (100, 400):
            counts.append(0)
            neardup.near_duplicates(frame(spark, [(i, edited(rng, base, rng.choice(edits))) for i in range(n)]), shingle=2)
        assert counts[1] <= 5 * counts[0]


def test_near_duplicates_odd_rows(spark):
    rng = random.Random(8)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(5, a), (5, a), (7, a), (None, a), (9, b), (5, b), (None, None), (11, None), (11, "")]
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), shingle=2).collect()]
    assert sorted(got, key=str) == sorted([(5, 5, True)] * 3 + [(7, 5, False), (9, 5, False), (None, None, True), (None, None, True), (11, 11, True), (11, 11, True)], key=str)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_large_groups_and_long_texts(spark):
    rng = random.Random(5)
    same, long = sentence(rng, 80), sentence(rng, 60_000, 10**6)
    rows = [(i, same) for i in range(300)] + [(1000, long), (1001, long + " end")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), shingle=2).collect()}
    assert all(got[i] == 0 for i in range(300)) and got[1001] == 1000


def test_estimate_follows_similarity(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))] + [(n, " ".join(x if rng.random() > n / 100 else f"y{n}{i}" for i, x in enumerate(base))) for n in (2, 5, 10, 20)]
    feats = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(neardup._featurize(1, True, 3), neardup.FEATURES)
    a, b = feats.filter("doc_id = 0").select(F.col("sig").alias("x")), feats.filter("doc_id > 0").select("doc_id", F.col("sig").alias("y"))
    texts = dict(rows)
    for r in b.join(F.broadcast(a)).select("doc_id", neardup.estimate(F.col("x"), F.col("y")).alias("e")).collect():
        s, t = set(texts[0].split()), set(texts[r.doc_id].split())
        assert abs(r.e - len(s & t) / len(s | t)) < 0.17
    assert 0.6 < neardup.least_estimate(0.8) < 0.75


def cut_by_hand(pairs, n):
    first = {}
    for i, t in pairs:
        w = WORD.findall(t or "")
        if i is not None:
            for j in range(len(w) - n + 1):
                key = tuple(w[j : j + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in pairs:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for j in range(len(w) - n + 1):
            if i is not None and first[tuple(w[j : j + n])] < i:
                keep[j : j + n] = [False] * n
        kept = [x for x, k in zip(w, keep) if k]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "seed", "vocabulary"), [(50, 20, 400), (12, 5, 3), (6, 6, 2)])
def test_substrings(spark, length, seed, vocabulary):
    rng = random.Random(length)
    passages = [sentence(rng, rng.randrange(length, 3 * length), vocabulary) for _ in range(4)]
    pairs = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(0, 2 * length), vocabulary)]
        for _ in range(rng.choice([0, 1, 2])):
            w = rng.choice(passages).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "edit"
            a = rng.randrange(len(w) // 2)
            parts += [" ".join(w[a:]), sentence(rng, rng.randrange(0, length), vocabulary)]
        pairs.append((rng.randrange(10**6), rng.choice([" ", "\n", "  "]).join(parts)))
    same = sentence(rng, 2 * length, vocabulary)
    pairs += [(i, same) for i in range(2_000_000, 2_000_040)]
    pairs += [(7, "was " * 300), (8, "was " * 200), (9, None), (10, ""), (11, "short"), (None, same), (12, same), (12, same), (12, "other " + same)]
    got = sorted(map(tuple, substrings.dedup_substrings(frame(spark, pairs), length, seed).collect()), key=str)
    assert got == cut_by_hand(pairs, length)


def test_substrings_empty(spark):
    assert substrings.dedup_substrings(frame(spark, [])).count() == 0


def test_anchor_depends_on_the_window_alone():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 6, 500).astype(np.uint64)
    g, place, lo, hi = substrings.window_anchors(h, 12, 4)
    runs = grams(h, 4)
    owner = {}
    for a, p, x, y in zip(g, place, lo, hi):
        for s in range(x, y + 1):
            owner[s] = p
            assert s <= p <= s + 8 and runs[p] == a
    assert sorted(owner) == list(range(len(h) - 11))
    by_words = collections.defaultdict(set)
    for s, p in owner.items():
        by_words[tuple(h[s : s + 12])].add(p - s)
    assert all(len(x) == 1 for x in by_words.values())


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_best_match():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(0, 10))
        best = min(edits(item.tolist(), text[i:j].tolist()) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        k, a, b = decontaminate.best_match(item.astype(np.uint64), text.astype(np.uint64))
        assert k == best == edits(item.tolist(), text[a:b].tolist())


def test_decontamination_recall(spark):
    rng = random.Random(7)
    items = [(i, sentence(rng, rng.randrange(6, 60), 5000)) for i in range(40)] + [(90, None), (91, ""), (None, "a b c")]
    pairs, planted = [], {}
    for d in range(400):
        words = sentence(rng, rng.randrange(0, 200), 5000).split()
        if d % 2:
            i, text = items[rng.randrange(40)]
            w = text.upper().split() if d % 3 == 0 else text.split()
            k = rng.randint(0, len(w) // 5)
            for _ in range(k):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choice([[], ["new%d" % rng.randrange(10**6)]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = w
            planted[d] = i
        pairs.append((d, " ".join(words)))
    pairs += [(1000, None), (1001, ""), (None, items[0][1]), (1002, items[0][1]), (1002, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.leaks(frame(spark, pairs), bench).collect()
    held = collections.defaultdict(set)
    for r in rows:
        held[r.doc_id].add(r.item_id)
    missed = [d for d, i in planted.items() if i not in held[d]]
    assert len(missed) <= 1
    sizes = {i: len((t or "").split()) for i, t in items}
    texts = {d: WORD.findall((t or "").translate(LOWER)) for d, t in pairs}
    for r in rows:
        if r.doc_id is not None:
            part = texts[r.doc_id][r.start : r.start + r.n_words]
            want = WORD.findall(dict((i, t) for i, t in items if i is not None)[r.item_id].translate(LOWER))
            assert edits(want, part) == r.edits <= 0.2 * sizes[r.item_id]
    clean = [d for d in range(0, 400, 2) if held[d]]
    assert not clean and held[1002] and held[None] and sum(r.doc_id == 1002 for r in rows) == 2
    small = decontaminate.leaks(frame(spark, pairs), bench, block_words=60).collect()
    assert sorted(map(str, small)) == sorted(map(str, rows))
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0 and decontaminate.leaks(frame(spark, pairs), bench.limit(0)).count() == 0


def test_all_documents_with_all_items(spark):
    """What the best passages of all pairs say, found or not, for edits up to and beyond the limit, and items of any size."""
    rng = random.Random(12)
    items = [(i, sentence(rng, n, 300)) for i, n in enumerate([1, 2, 3, 4, 5, 7, 8, 11, 12, 15, 16, 25, 40, 60])] + [(99, "w1 w2 " * 15)]
    pairs = []
    for d in range(240):
        words = sentence(rng, rng.randrange(0, 80), 300).split()
        w = items[d % len(items)][1].split()
        for _ in range(rng.randint(0, max(1, len(w) // 4))):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1])] = rng.choice([[], ["w%d" % rng.randrange(300)]])
        at = rng.randrange(len(words) + 1)
        pairs.append((d, " ".join(words[:at] + w + words[at:])))
    pairs += [(1000, "w1 " * 3000), (1001, "w1 w2 " * 2000)]
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in t.split()], dtype=np.uint64)
    want = {}
    for d, t in pairs:
        for i, item in items:
            least = decontaminate.best_match(code(item), code(t))[0]
            if least <= len(item.split()) // 5:
                want[d, i] = least
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(frame(spark, pairs), bench).collect()}
    assert set(got) <= set(want) and len(set(want) - set(got)) <= len(want) // 500
    assert all(want[x] == e for x, e in got.items())


def test_crowded_keys_are_halved(monkeypatch):
    """The result doesn't depend on how much is counted at once."""
    rng = random.Random(13)
    texts = [sentence(rng, 40, 30) for _ in range(30)]
    words = Words(pa.array([sentence(rng, 300, 30) for _ in range(10)] + [" ".join(rng.sample(texts, 3)) for _ in range(20)]))
    bench = decontaminate.Benchmark(list(range(30)), texts, 0.2, 48, 3, 2)
    whole = bench.search(words.hashes(), words.bounds)
    monkeypatch.setattr(decontaminate, "MOST", 500)
    monkeypatch.setattr(decontaminate, "STRETCH", 700)
    assert bench.search(words.hashes(), words.bounds) == whole and sum(map(len, whole)) >= 60


def test_walk_keeps_near_sequences_near():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 60, (200, 40)).astype(np.uint64)
    y = np.concatenate([x[:, :10], x[:, 11:], x[:, :1]], axis=1)  # one word gone, one more at the end
    z = rng.integers(0, 1 << 60, (200, 40)).astype(np.uint64)
    draws = rng.integers(0, 1 << 62, 38, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    e = [decontaminate.walk(decontaminate._codes(np.append(s.ravel(), np.zeros(40, np.uint64))), np.arange(200) * 40, draws) for s in (x, y, z)]
    assert (e[0] == e[1]).mean() > 0.6 and (e[0] == e[2]).mean() < 0.1
    assert decontaminate.enough_of(52, 3, 0.5, 0.999) == 1 and decontaminate.enough_of(5, 3, 0.5, 0.999) == 0


def test_hash_of_kept_text(spark):
    from pyspark.sql import functions as F

    out = substrings.dedup_substrings(frame(spark, [(1, " a  é\nb ")])).select(F.sha2("kept_text", 256)).first()[0]
    assert out == hashlib.sha256("a é b".encode()).hexdigest()


def test_a_long_text_is_read_whole(tmp_path):
    """Words, shingles, tokens, leaks and scores of one text of 3 MB equal those of plain code."""
    from tracewell.llm import convnet, tokens, toxicity
    from tracewell.llm.queries import tokenizer_path

    rng = random.Random(19)
    words = [f"w{rng.randrange(30_000)}" for _ in range(450_000)]
    words[400_000:400_000] = [f"item{i}" for i in range(40)]
    text = " ".join(words)
    assert len(text) > 2_500_000
    held = Words(pa.array([text, "end"]))
    assert held.bounds.tolist() == [0, len(words), len(words) + 1]
    assert len(neardup.shingle_sets(pa.array([text]), 5)[0]) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    bench = decontaminate.Benchmark([7], [" ".join(f"ITEM{i}" for i in range(40))], 0.2, 48, 3, 3)
    lower = Words(pa.array([text]), lower=True)
    assert bench.search(lower.hashes(), lower.bounds) == [[{"item_id": 7, "start": 400_000, "n_words": 40, "edits": 0}]]
    encoder = tokens.Encoder(tokenizer_path())
    ids, n = encoder.encode(pa.array([text]))
    assert ids.tolist() == encoder.tok.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]
    chars, ends = toxicity.characters(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert len(chars) == len(text) + 2 == ends[0]
    rows, count = convnet.blocks_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert count.tolist() == [-(-len(text) // convnet.BLOCK)] and rows[:, : convnet.BLOCK].tobytes().rstrip(b"\0") == text.encode()
