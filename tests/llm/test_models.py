"""Classifiers by held-out accuracy, token shards by exact round trips, and the pipeline against its parts."""

import glob
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import convnet, tokens, toxicity
from tracewell.llm.queries import oracle_sql, queries, tokenizer_path
from tracewell.llm.training import labelled_sample, logistic_fit, sigmoid

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def labelled(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        bad = rng.random() < 0.3
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(3, 150))]
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["zzyx", "Qvurm"]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity(spark):
    rows = labelled(1500, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(5000, None, 0.5), (5001, "", 0.5), (None, "abc", 0.5), (3, "zzyx " * 4, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(77, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    truth = {i: y for i, _, y in rows}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {round(r.score, 2) for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_scores_do_not_depend_on_the_batch():
    rows = labelled(300, 2)
    model = toxicity.NgramModel.fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], dtype=float))
    net = convnet.ConvNet.fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], dtype=float), steps=30)
    texts = [t for _, t, _ in rows[:20]] + ["", "x", "é" * 5000, "a" * 255, "a" * 256, "b" * 260, "c" * 508, "c" * 509]
    for m in (model, net):
        raw = [t.encode() for t in texts]
        whole = m.score(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
        one = [m.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in raw]
        assert np.allclose(whole, one)


def test_ngram_score_is_a_plain_sum():
    rows = labelled(200, 3)
    rows = [(i, t.replace("a", "é").replace("b", "日"), y) for i, t, y in rows]
    model = toxicity.NgramModel.fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], dtype=float), features=200)
    weight = {int(c): w for c, w in zip(model.codes, model.weights)}

    def code(gram):
        h = 0
        for c in gram:
            h = (h * 0xD6E8FEB86659FD93 + max(32, ord(c))) % 2**64
        return h

    for _, t, _ in rows[:30] + [(0, "ZZYX\tÉ", 1), (0, "", 0)]:
        b = " " + "".join(c.lower() if c < "\x80" else c for c in t) + " "
        seen = {code(b[i : i + o]) for o in model.orders for i in range(len(b) - o + 1)}
        want = sigmoid(np.array(model.bias + sum(weight.get(c, 0) for c in seen)))
        raw = t.encode()
        assert np.isclose(model.score(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], want)


def test_characters_of_broken_utf8():
    raw = b"A\xffb\xc3" + "é".encode()
    chars, ends = toxicity.characters(np.frombuffer(raw, np.uint8), np.array([0, 2, 4, 6]))
    assert chars.tolist() == [32, 97, 0xFFFD, 32, 32, 98, 0xFFFD, 32, 32, 233, 32] and ends.tolist() == [4, 8, 11]


def test_long_labelled_texts_teach(spark):
    """Only texts longer than the sample's share hold what tells the labels apart, anywhere in them."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(1500)]
        if i % 2:
            for at in range(0, 1500, 8):
                words[at] = "zzyxq"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(999, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels, chars=2000).filter("held_out and doc_id < 999").collect()
    assert len(out) > 50 and sum(r.predicted == r.doc_id % 2 for r in out) / len(out) > 0.97
    texts, y = labelled_sample(docs, labels, "toxic", 10_000, 2000)
    assert len(texts) == 300 and y.sum() == 150 and max(map(len, texts)) <= 2031 and min(map(len, texts)) >= 1900


@needs_data
@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.95), ("op6_quality", "quality", 0.95)])
def test_registered_classifiers_on_held_out_labels(spark, name, label, least):
    out = queries()[name](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", label)
    held = out.join(labels, "doc_id").filter(f"held_out and {label} is not null").collect()
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(held) > 20 and sum(r.predicted == r[label] for r in held) / len(held) >= least


def test_network_against_plain_convolution():
    rng = np.random.default_rng(1)
    net = convnet.ConvNet.fit([b"abc" * 40, b"xyz" * 200, b"q"], np.array([1.0, 0, 1]), steps=5)
    for n in (0, 1, 7, 255, 256, 300, 1500):
        raw = rng.integers(1, 255, n).astype(np.uint8)
        rows, count = convnet.blocks_of(raw, np.array([0, n]))
        padded = np.zeros(count[0] * convnet.BLOCK + convnet.WIDTH, np.uint8)
        padded[:n] = raw
        tops = []
        for b in range(count[0]):
            at = range(b * convnet.BLOCK, (b + 1) * convnet.BLOCK, convnet.STRIDE)
            tops.append(np.max([sum(net.table[k][padded[p + k]] for k in range(convnet.WIDTH)) for p in at], axis=0))
        assert np.allclose(net.maxima(rows), tops, atol=1e-4)
        pooled = [np.maximum(a, b) for a, b in zip(tops, tops[1:])] or tops
        s = np.array([np.tanh(np.maximum(z + net.shift, 0) @ net.dense + net.dense_shift) @ net.out for z in pooled])
        assert np.allclose(net.chunk_scores(rows, count)[0], s, atol=1e-4)


def test_quality(spark):
    rng, rows = random.Random(5), []
    for i in range(900):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(5, 200))]
        rows.append((i, " ".join(words if good else [w.upper() + rng.choice(["!!", "%%%"]) for w in words]), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "a"), (3, "b b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    out = convnet.quality(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == len(rows) + 4 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert convnet.quality(docs.limit(0), labels).count() == 0


def test_logistic():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < sigmoid(x @ [2.0, -1.0, 0.0] + 0.5)).astype(float)
    w, b = logistic_fit(x, y, 1e-6, steps=300)
    assert np.allclose(w, [2, -1, 0], atol=0.2) and abs(b - 0.5) < 0.15


@pytest.mark.parametrize("values", [[], [0], [5], [3, 3, 3], [0, 1, 2, 3], [-(10**12), 0, 10**12], sorted(random.Random(1).randrange(10**9) for _ in range(1000)), list(range(0, 5000, 7)), [0] * 300 + [10**6]])
def test_elias_fano(values):
    e = tokens.EliasFano.encode(np.array(values, dtype=np.int64))
    assert e.decode().tolist() == values and [e.select(i) for i in range(len(values))] == values
    back, end = tokens.EliasFano.from_bytes(memoryview(b"pad" + e.to_bytes()), 3)
    assert back.decode().tolist() == values and end == 3 + len(e.to_bytes())
    with pytest.raises(IndexError):
        e.select(len(values))
    if len(values) == 1000 and values[0] >= 0:
        assert len(e.to_bytes()) * 8 / 1000 < 2 + 20 + 3  # two bits and log2(u / n), and samples


def texts_for_tokens():
    rng = random.Random(2)
    odd = ["a", "b", " ", "  ", "\n", "\t", "é", " ", "　", "à", "'s", "9", ".", "<|endoftext|>", "日本", "\u0085", "\x1c", "The quick"]
    return ["".join(rng.choice(odd) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, "", " ", "a ", " a"]


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokenizer_path(), most=500)
    texts = texts_for_tokens()
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        ids, n = e.encode(pa.array(part))
        want = [x.ids for x in e.tok.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


def test_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = texts_for_tokens()[:400] + ["word " * 20_000, "a <|endoftext|> b", "one  <|endoftext|><|endoftext|>two <|endoftext"]
    rows = [(i * 3 - 500, t) for i, t in enumerate(texts)] + [(None, "x"), (None, None), (1, "one"), (1, "two"), (1, "two")]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, part string")
    tokens.write_shards(docs, str(tmp_path / "t"), tokenizer_path(), partitions=5, shard_ids=300)
    got = sorted(map(tuple, tokens.read_documents(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    tok = Tokenizer.from_file(tokenizer_path())
    key = lambda r: (r[0] is None, r[0] or 0)
    assert [r[0] for r in got] == [r[0] for r in sorted(rows, key=key)]
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]

    def digest(i, t):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        return (i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))

    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted((digest(*r) for r in rows), key=str)
    first = sorted(rows, key=key)[0]
    named = [r.file for r in spark.read.parquet(str(tmp_path / "t/manifest")).orderBy("part", "shard").collect()]
    shard = tokens.Shard.open(f"file://{tmp_path}/t/data/{named[0]}")
    assert shard.doc_id(0) == first[0] and shard.span(0).tolist() == tok.encode(first[1] or "", add_special_tokens=False).ids + [0]
    (tmp_path / "t/data/000000-000000-999999.ids").write_bytes(b"of a lost task")
    assert tokens.read_documents(spark, str(tmp_path / "t")).count() == len(rows)
    with pytest.raises(ValueError):
        tokens.Shard.unpack(b"something else")


def test_no_documents(spark, tmp_path):
    tokens.write_shards(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "n"), tokenizer_path())
    assert tokens.read_documents(spark, str(tmp_path / "n")).count() == 0


def test_wide_ids():
    ids = np.array([1, 70_000, 0], dtype=np.uint32)
    s = tokens.Shard.unpack(tokens.Shard.pack([4], np.array([3]), ids))
    assert s.span(0).tolist() == ids.tolist()


def norm(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted(tuple(one(r[i]) for i in at) for r in rows)


@needs_data
def test_queries_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    known = queries()
    for name, sql in oracle_sql().items():
        got = known[name](spark, DATA)
        want = con.execute(sql)
        assert norm(got.columns, got.collect()) == norm([c[0] for c in want.description], want.fetchall()), name


def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_stages(spark, tmp_path):
    """Each stage on a table with nulls, repeated rows and clashing names: columns stay, and only what should go goes."""
    p, rng = pipeline(), random.Random(6)
    item = " ".join(f"item{i}" for i in range(30))
    rows = []
    for i in range(120):
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
        rows.append((i, t if i % 4 else t.upper().replace(" ", "!! "), "en", f"s{i % 2}", len(t), i))
    labels = [(i, int(i % 4 > 0), 0) for i in range(120)]
    copy = rows[1][1]
    rows += [(500, copy + " end", "en", "s0", 1, 1), (501, copy, "en", "s1", 1, 1), (502, rows[2][1] + " " + item.upper(), "en", "s0", 1, 1), (1, copy, "en", "s1", 1, 2), (None, rows[3][1], None, None, None, None), (503, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score long"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(p.STAGES)
    assert list(stages) == ["quality_classifier", "near_dedup", "decontamination", "mixing", "tokens"]

    def stage(name, df):
        out = stages[name](spark, df, str(tmp_path))
        assert stages[name](spark, df.limit(0), str(tmp_path)).count() == 0
        return out

    good = stage("quality_classifier", docs)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert all((i in kept) == (i % 4 > 0) for i in range(120)) and {500, 501, 502} <= kept
    one = stage("near_dedup", docs).collect()
    ids = [r.doc_id for r in one]
    assert sorted(map(str, ids)) == sorted(map(str, [*range(120), 503, None] + ([] if 502 not in ids else [502])))
    clean = stage("decontamination", docs)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {502} and clean.columns == docs.columns
    mixed = stage("mixing", docs.filter("doc_id is null or doc_id < 100"))
    assert mixed.columns == docs.columns and mixed.count() > 0
    done = stages["tokens"](spark, docs, str(tmp_path))
    assert done.count() == docs.count() and done.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = p.run(spark, str(tmp_path)).collect()
    assert whole and 502 not in {r.doc_id for r in whole} and len({r.doc_id for r in whole} & {1, 500, 501}) <= 1


def test_registered_names():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(queries())
