"""Rules, URL filters, licences and mixing against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm import hostrules, licenses, mixing, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    mark = [False] * len(w)
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            mark[k : k + 3] = [True] * 3
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = sum(mark)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, len(w) < 50 or 100 * repeated > 50 * len(w)


TEXTS = [
    None, "", " ", "\n\n", "a", "a b", "a b c", "a a a", "a b c a b c", "x|y <b> 100%", "é ü\x0bö\x0c ñ\r\n", "l one\nl one\n \nl two\nl one", "a b c d a b c x y z " * 30, " ".join(f"w{i}" for i in range(60)), "was " * 500, " ".join(f"w{i % 997}" for i in range(20_000)),
]


def test_host_rules(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(i, f"s{i % 3}" if i % 7 else None, t, 5) for i, t in enumerate(texts)] + [(None, "s1", "a", 5), (3, "s1", "a b", 5), (3, "s1", "a b", 5)]
    out = hostrules.host_rules(spark.createDataFrame(rows, "doc_id long, source string, text string, n_words long"))
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()], key=str)
    assert got == sorted([(i, *base(t)) for i, _, t, _ in rows], key=str)
    assert all(not r.kept for r in out.collect() if r.base_failed)
    assert hostrules.host_rules(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def hosts_fixture():
    """Hosts with about five failures in a hundred, one with 60, one with 9, one with two rows."""
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", "too short") for i in range(60)] + [(100 + i, "bad", good) for i in range(40)]
    rows += [(200 + i, "so-so", good if i >= 9 else "short") for i in range(100)] + [(5000, "tiny", "short"), (5001, "tiny", good)]
    return rows + [(1000 + 100 * h + i, f"h{h}", good if i >= 4 + h % 3 else "short") for h in range(9) for i in range(100)]


def test_bad_host_is_rejected(spark):
    out = {r.doc_id: r for r in hostrules.host_rules(spark.createDataFrame(hosts_fixture(), "doc_id long, source string, text string")).collect()}
    assert not any(out[100 + i].kept for i in range(40)) and not out[100].base_failed and out[100].host_rejected
    assert all(r.kept != r.base_failed for i, r in out.items() if r.host != "bad")
    assert out[5001].kept  # one failure of two says little: the prior holds the rate down


def test_verdicts_by_hand(spark):
    """Rejections of the query and of its SQL on the fixture equal those of a plain computation."""
    rows = hosts_fixture()
    counts = collections.Counter(h for _, h, _ in rows)
    failed = collections.Counter(h for _, h, t in rows if base(t)[-1])

    def rejected(h):
        n, k = sum(counts.values()) - counts[h], sum(failed.values()) - failed[h]
        m = k / n
        v = sum(counts[x] * (failed[x] / counts[x] - m) ** 2 for x in counts if x != h) / n - m * (1 - m) * (len(counts) - 1) / n
        strength = min(50, max(1, m * (1 - m) / v - 1)) if v > 0 else 50
        rate = (failed[h] + m * strength) / (counts[h] + strength)
        return rate > max(0.2, 2 * m, m + 3 * (m * (1 - m) / (strength + 1)) ** 0.5)

    assert [h for h in counts if rejected(h)] == ["bad"]
    out = hostrules.host_rules(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert {r.host for r in out.filter("host_rejected").collect()} == {"bad"}
    import duckdb

    from tracewell.llm.sql import SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = con.execute(f"SELECT doc_id, kept FROM ({SQL['op2_rules']})").fetchall()
    assert sorted(got) == sorted((r.doc_id, r.kept) for r in out.collect())


def test_one_host_and_no_failures(spark):
    rows = [(i, "only", "short") for i in range(50)] + [(100, "only", " ".join(f"w{i}" for i in range(60)))]
    out = hostrules.host_rules(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert not out.filter("host_rejected").count()  # there is nothing to compare it with
    assert hostrules.host_rules(spark.createDataFrame([(1, "a", rows[-1][2]), (2, "b", rows[-1][2])], "doc_id long, source string, text string")).filter("kept").count() == 2


def licence_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for p, label in licenses.PHRASES.items():
        p = p.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), labels


def template_labels(text, threshold):
    """Shares of all templates in all blocks, one by one."""
    out, best = set(), 0.0
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    for label, t in licenses.TEMPLATES.items():
        t = set(t.split())
        reach = 8
        while reach < 2 * len(t):
            reach *= 2
        for at in range(0, len(w), reach):
            share = len(t & set(w[at : at + 2 * reach])) / len(t)
            if share >= threshold - 1e-9:
                out.add(label)
                best = max(best, share)
    return out, best


def test_wrapped_and_changed_notices(spark):
    """Notices over several lines, with other line ends, or with a word in ten changed, in a long text."""
    rng = random.Random(6)
    filler = [f"w{rng.randrange(3000)}" for _ in range(3000)]

    def within(words):
        at = rng.randrange(2500)
        return " ".join(filler[:at]) + "\n" + "\n * ".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)) + "\n" + " ".join(filler[at:])

    rows, want = [], []
    for label, text in licenses.PARAGRAPHS.items():
        rows.append((len(rows), within(text.upper().split())))
        own = sorted(set(licenses.TEMPLATES[label].split()))
        lost = set(rng.sample(own, len(own) // 10))
        rows.append((len(rows), within(["changed" if w in lost else w for w in text.split()])))
        worse = set(rng.sample(own, len(own) // 5 + 1))
        rows.append((len(rows), within(["changed" if w in worse else w for w in text.split()])))
        want += [(label, True), (label, True), (label, False)]
    rows += [(900, "Licensed under the Apache\nLicense 2.0"), (901, "released under MIT License"), (902, "licensed under the terms of the\n# Mozilla Public\n# License"), (903, "the license of mit" + " x" * 20 + " license")]
    out = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, held) in enumerate(want):
        assert (label in out[i]) == held, (i, label)
    assert out[900] == {"apache-notice"} and out[901] == {"mit-notice"} == out[903] and out[902] == {"mpl-notice"}
    assert licenses.license_scan(spark.createDataFrame([(1, "w " * 60 + " ".join(filler))], "doc_id long, text string")).first().labels == ""


@pytest.mark.parametrize("threshold", [0.9, 0.7, 0.5])
def test_licenses(spark, threshold):
    rng = random.Random(2)
    vocabulary = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()}) + ["filler", "été", "K", "İ", "cc", "by"]
    texts = [
        None, "", "CC BY-NC 4.0", "cc\nby", "All rights\treserved. ALL RIGHTS RESERVED", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "all rights", "General_Public.License general public license",
        "x\nThis work is licensed under the GNU General Public License, version 3.\ny", "ccby cc bye", "\u212a cc by \u212a", "cc by " * 3000,
    ] + [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "\n"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, texts[5], "z"), (1, texts[6], "z"), (1, texts[6], "z")]
    out = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string"), threshold).collect()
    got = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in out], key=str)
    want = []
    for i, t, _ in rows:
        n, k, a, b, labels = licence_base(t)
        more, best = template_labels(t, threshold)
        want.append((i, n, k, a, b, ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if k else round(best, 9)))
    assert got == sorted(want, key=str)
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def judged(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host, best = host.translate(LOWER), None
    for r in RULES:
        name, start = r.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(r) > len(best)):
            best = r
    return host, path, best


def test_urls(spark):
    rng = random.Random(3)
    cases = [None, "", "no scheme", "://", "http://", "http://COM/en/", "http://xcom/en/1", "https://A.Example.com/en/7?x=/en/8", "http://example.net/de/81#a", "http://e.org", "http://e.org?q", "http://é.org/es/", "a://b://c/d", "http://x.com:80/en/", "http://h.com//en/"]
    cases += [f"http://{rng.choice(['a.', ''])}example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(100)}{rng.choice(['', '/', '.html', '?a=1'])}" for _ in range(300)]
    rows = [(i, u, "q") for i, u in enumerate(cases)] + [(None, cases[7], "q"), (1, cases[8], "q"), (1, cases[8], "q")]
    out = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, template string"), RULES).collect()
    want = sorted([(i, *judged(u)) for i, u, _ in rows], key=str)
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in out], key=str) == want
    for r in out:
        assert r.verdict == RULES[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def tree(pages, prior=0.25, weight=2.0, z=1.96):
    """(template, share) of each (host, path) of pages (host, path, label), by a plain recursion over one host's paths."""
    paths = collections.defaultdict(lambda: [0, 0])
    for h, p, label in pages:
        paths[h, p][0] += label is not None
        paths[h, p][1] += label or 0
    out = {}

    def sums(items):
        return sum(paths[i][0] for i, _ in items), sum(paths[i][1] for i, _ in items)

    def alike(mine, everyone):
        (n, k), (a, b) = mine, everyone
        if not n or a == n:
            return False
        return abs(k / n - (b - k) / (a - n)) <= z * (b / a * (1 - b / a) * (1 / n + 1 / (a - n))) ** 0.5

    def grow(items, template, prior):
        kids = collections.defaultdict(list)
        for i, segs in items:
            kids["e" if not segs else "s*" if re.match(urls.VARIABLE, segs[0]) else "s" + segs[0]].append((i, segs))
        on = sums([x for k, xs in kids.items() if k != "e" for x in xs])
        apart = "s*" in kids and sums(kids["s*"])[0] and not alike(sums(kids["s*"]), on)
        branches = collections.defaultdict(list)
        for k, xs in kids.items():
            merges = k != "e" and alike(sums(xs), on)
            branches["s*" if k == "s*" else ("s*+" if apart else "s*") if merges else k] += xs
        a, b = sums(items)
        for name, xs in branches.items():
            n, k = sums(xs)
            beside = (b - k + weight * prior) / (a - n + weight)
            here = template if name == "e" else template + "/" + name[1:]
            if name == "e" or not n or len(xs) == 1:
                for i, segs in xs:
                    rest = ["*" if re.match(urls.VARIABLE, s) else s for s in segs[1:]]
                    out[i] = (here + ("" if not rest else "/" + "/".join(rest) if len(xs) == 1 else "/**"), (k + weight * beside) / (n + weight))
            else:
                grow([(i, segs[1:]) for i, segs in xs], here, beside)

    for host in {h for h, _ in paths}:
        grow([((h, p), re.sub("^/+|/+$", "", p).split("/")) for h, p in paths if h == host], "", prior)
    return out


def judge(spark, pages, rules, *label):
    return {r.page_id: r for r in urls.url_filter(spark.createDataFrame(pages, "page_id long, url string, label int"), rules, *label).collect()}


def test_tree_against_recursion(spark):
    rng = random.Random(11)
    pages = []
    for i in range(1500):
        depth = rng.choice([0, 1, 2, 2, 3, 3, 4, 9])
        segs = [rng.choice(["en", "de", "shop", "news", "a", "b", str(rng.randrange(50)), "0123abcdef"]) for _ in range(depth)]
        path = "/" * (depth > 0 or rng.random() < 0.5) + "/".join(segs) + rng.choice(["", "", "/"])
        bad = 0.9 if "shop" in segs else 0.5 if "a" in segs else 0.05
        pages.append((i, f"http://{rng.choice(['x', 'y', 'x'])}.com{path}", int(rng.random() < bad) if rng.random() < 0.4 else None))
    pages += [(5000, "http://lone.org/a/1/b", 1), (5001, "http://none.org/a/b", None), (5002, "http://none.org//a//b/", None)]
    out = judge(spark, pages, {}, "label")
    want = tree([(*judged(u)[:2], label) for _, u, label in pages])
    assert len(out) == len(pages) and len({t for t, _ in want.values()}) > 50
    for r in out.values():
        template, share = want[r.host, r.path]
        assert r.template == template and abs(r.bad_share - share) < 1e-9, (r, template, share)
        assert r.verdict == ("block" if share > 0.5 else "allow")
    assert {r.verdict for r in out.values()} == {"allow", "block"}


def test_rules_label_the_pages_around_them(spark):
    """As in the registered query: pages without a rule follow what rules say about their host, and hosts without any are allowed."""
    pages = [(i, f"http://a.com/en/{i}", None) for i in range(20)] + [(100 + i, f"http://a.com/fr/{i}", None) for i in range(5)]
    pages += [(200 + i, f"http://b.net/de/{i}/x", None) for i in range(20)] + [(300, "http://b.net/fr/1", None), (400, "http://c.info/fr/1", None)]
    pages += [(500, "http://d.com/en/1", None), (501, "http://d.com/about", None)]
    out = judge(spark, pages, RULES)
    assert all(out[100 + i].rule is None and out[100 + i].verdict == "block" and out[100 + i].template == "/fr/**" for i in range(5))
    assert out[300].verdict == out[400].verdict == "allow" and out[300].bad_share < 0.05 and out[400].bad_share == 0.25
    assert out[501].bad_share == 0.5 and out[501].verdict == "allow"  # one blocked page is not enough


def test_templates_and_purity(spark):
    pages = [(i, f"http://h.com/shop/{i}/buy", 1) for i in range(50)] + [(100 + i, f"http://h.com/news/{i}/read", 0) for i in range(150)]
    pages += [(300, "http://h.com/shop/999/buy/", None), (301, "http://h.com/news/999/read", None), (302, "http://h.com/new/b/c/d", None), (303, "http://h.com/new", None), (304, "http://h.com", None)]
    out = judge(spark, pages, {}, "label")
    assert out[300].template == "/shop/*/buy" and out[300].verdict == "block" and out[300].bad_share > 0.9
    assert out[301].template == "/news/*/read" and out[301].verdict == "allow"
    assert out[302].template == "/new/**" and out[303].template == "/new" and 0.2 < out[302].bad_share < 0.3 and len(out) == len(pages)


def test_alike_branches_merge(spark):
    pages = [(i, f"http://h.com/{'ab'[i % 2]}/x", int(i % 20 < 10)) for i in range(200)] + [(500 + i, "http://h.com/c/x", 1) for i in range(100)]
    assert {r.template for i, r in judge(spark, pages, {}, "label").items() if i >= 500} == {"/c/x"}
    assert {r.template for r in judge(spark, pages[:200], {}, "label").values()} == {"/*/x"}
    # Numbers that differ from names which are alike stay apart from them.
    mixed = [(i, f"http://h.com/{i}/x", 1) for i in range(200)] + [(1000 + i, f"http://h.com/n{i % 4}n/x", int(i % 40 < 16)) for i in range(400)]
    out = judge(spark, mixed, {}, "label")
    assert out[0].template == "/*/x" and "/*/x" not in {out[1000 + i].template for i in range(4)}


def test_many_and_deep_branches(spark):
    """One spam section among any number of others, and branches that differ at the eighth segment."""
    for n in (20, 21):
        spam = [(i, f"http://h.com/spam/x{i}", 1) for i in range(30)] + [(100 + i, f"http://h.com/g{i % n}g/x", 0) for i in range(10 * n)] + [(5000, "http://h.com/spam/new", None), (5001, "http://h.com/new/x", None)]
        out = judge(spark, spam, {}, "label")
        assert out[5000].template.startswith("/spam/") and out[5000].verdict == "block" and out[100].verdict == "allow", n
        assert out[5001].template == "/new/x" and out[5001].verdict == "allow", n
    deep = "http://h.com/a/b/c/d/e/f"
    pages = [(100 * k + i, f"{deep}/g/{end}/{i}", int(end == "bad")) for k, end in enumerate(["bad", "good", "fine", "well"]) for i in range(40)]
    out = judge(spark, [*pages, (900, f"{deep}/g/bad/999", None), (901, f"{deep}/g/good/999", None), (903, f"{deep}/q/1", None), (904, f"{deep}/q/2/x", None)], {}, "label")
    assert out[900].verdict == "block" and out[901].verdict == "allow" and out[904].template == "/a/b/c/d/e/f/q/**"
    assert out[900].template == "/a/b/c/d/e/f/g/bad/*" == out[0].template and out[900].bad_share > 0.9 and out[901].bad_share < 0.1


def fill(weights, caps, total):
    """Clamp, reshare, repeat."""
    fixed = {}
    while True:
        free = [i for i in range(len(caps)) if i not in fixed]
        if not free:
            return [fixed[i] for i in range(len(caps))]
        level = (total - sum(fixed.values())) / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > caps[i]]
        if not over:
            return [fixed.get(i, weights[i] * level) for i in range(len(caps))]
        fixed |= {i: caps[i] for i in over}


def test_mixing(spark):
    rng, rows = random.Random(4), []
    for s, n in enumerate([1, 5, 40, 80, 3, 400, 12]):
        rows += [(1000 * s + i, f"é{s}" if s == 3 else f"s{s}" if s else None, "w " * rng.randrange(30), "k", 1) for i in range(n)]
    rows += [(7, "s1", None, "k", 1), (7, "s1", "a b", "k", 1), (7, "s1", "a b", "k", 1), (None, "s2", "a b c", "k", 1), (99_999, "empty", "", "k", 1), (5, "s5", "w " * 5000, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, rest string, mix_taken long")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and out[0].rest == "k"
    size = collections.Counter()
    for r in out:
        assert r.mix_size == len((r.text or "").split())
        size[r.source] += r.mix_size
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip(names, fill([(5, 2, 1)[i % 3] for i in range(len(names))], [2 * size[s] for s in names], 1.5 * sum(size.values()))))
    taken = collections.Counter()
    for r in out:
        assert r.mix_source_size == size[r.source] and abs(r.mix_target - want[r.source]) < 1e-6
        assert 0 <= r.mix_taken <= 2 * r.mix_size and abs(r.mix_taken - r.mix_copies * r.mix_size) <= r.mix_size / 2 + 1
        taken[r.source] += r.mix_taken
    assert all(abs(taken[s] - want[s]) < 1 for s in names)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("source = 'empty'")).first().mix_taken == 0


def test_ranked(spark):
    from tracewell.llm.storage import Scratch

    df = spark.createDataFrame([(s,) for s in ["b", "é", None, "a", "Z", "\U0001f600", "\ufffd"]], "source string")
    got = {r.source: r["rank"] for r in mixing.ranked(df, "source", Scratch(spark)).collect()}
    assert sorted(got, key=got.get) == ["Z", "a", "b", "é", "\ufffd", "\U0001f600", None]
    assert spark.range(1).select(mixing.word_count(F.lit(None).cast("string"))).first()[0] == 0
