"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns of clashing names."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.llm import boilerplate, common, covertree, ctw, decontaminate, html, licences, minhash, packing, toxicity, warc, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, rep long, component long"


def text_of(rng, n, words_=300):
    return " ".join(f"w{rng.randrange(words_)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [text_of(rng, 60) for _ in range(20)]
    texts = [None, "", " \n\t", "one", "ONE", "a b c", "Ünï cödé wörds fünf sechs sieben"] + base + base[:5] + [base[0].upper()]
    for k in range(30):  # near copies of one text
        w = base[1].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts.append(" ".join(text_of(rng, 20_000).split()))
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or ""), -1, "k", 0, 5, 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def shingle_set(t):
    w = WORD.findall(lowered(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(n, links):
    above = list(range(n))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        above[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = {r.id: r for r in minhash.near_duplicates(docs).collect()}
    sets = [shingle_set(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(len(rows), links)
    assert [got[i].component_id for i in range(len(rows))] == want
    assert [got[i].n_shingles for i in range(len(rows))] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in range(len(rows)))
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_overlaps_and_forest():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(6)]
    got, want = minhash.overlaps(sets, 7), np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (got == want)[~np.eye(6, dtype=bool)].all()
    equal = np.array([[0, 1, 1], [1, 0, 1], [1, 1, 0]], bool)
    assert len(minhash.forest(np.array([5, 3, 9]), np.array([5, 3, 9]), equal)) == 2


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100)] + [(200, 200 + k) for k in range(30)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(400, links)
    assert got == {i: want[i] for i in {x for p in links for x in p if p[0] != p[1]}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ctw(spark, docs, rows):
    got = {r.id: r for r in ctw.scores(docs, common.remainder("doc_id", 7) != 2).collect()}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = collections.Counter(w for r in train for w in [*WORD.findall(lowered(r[1])), None])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = [*WORD.findall(lowered(r[1])), None]
        x = got[r[0]]
        assert x.n_tokens == len(w) and x.train_tokens == n and x.n_known == sum(c[t] > 0 for t in w)
        assert x.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w))
        assert x.held_out == (zlib.crc32(str(r[0]).encode()) % 7 == 2) and x.score < 0
    assert ctw.scores(empty(spark), common.remainder("doc_id", 7) != 2).count() == 0


def reference_ctw(texts, depth):
    """The recursion as defined: a node's evidence and its weights, without arrays."""
    count = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        keys, _ = ctw.keys_of([t], depth)
        for k in keys.tolist():
            for d in range(depth + 1):
                ctx, byte = (k & ctw.mask(d)) >> 8, k & 255
                for b in range(8):
                    count[(d, ctx, (1 << b) | (byte >> (8 - b)))][(byte >> (7 - b)) & 1] += 1
    kids = collections.defaultdict(list)
    for d, ctx, q in count:
        if d:
            kids[(d - 1, ctx & (ctw.mask(d - 1) >> 8), q)].append((d, ctx, q))
    block, memo = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1), {}

    def evidence(node):
        if node not in memo:
            below = kids.get(node)
            p = block(*count[node])
            memo[node] = p if not below else np.logaddexp(p, sum(evidence(k) for k in below)) - math.log(2)
        return memo[node]

    def bit(key, q):
        path = [(d, (key & ctw.mask(d)) >> 8, q) for d in range(depth + 1)]
        seen = [x for x in path if x in count]
        p = 0.5
        for k, x in enumerate(reversed(seen)):
            a, b = count[x]
            ratio = (b + 0.5) / (a + b + 1)
            if not k:
                p = ratio
            else:
                below = sum(evidence(y) for y in kids[x])
                stop = 1 / (1 + math.exp(min(700, below - block(a, b))))
                p = stop * ratio + (1 - stop) * p
        return p

    def log10(key):
        byte, total = key & 255, 0.0
        for b in range(8):
            p = bit(key, (1 << b) | (byte >> (8 - b)))
            total += math.log10(p if (byte >> (7 - b)) & 1 else 1 - p)
        return total

    return log10


def test_ctw_scores(spark):
    """From the table to the score, training and rare pairs included, against the recursion; repeated ids, no training rows."""
    rng = random.Random(12)
    texts = ["abracadabra", "Abba cab", "naïve été", "", None] + [text_of(rng, 6, 9) for _ in range(12)] + ["zq unseen"]
    rows = [(i % 16, t, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    want = reference_ctw([lowered(t).encode() for i, t, _ in rows if i % 3], ctw.DEPTH)
    got = collections.defaultdict(list)
    for r in ctw.scores(df, ctw.F.col("doc_id") % 3 != 0).collect():
        got[r.id].append(r.score)
    for i in {i for i, _, _ in rows}:
        mine = [sum(want(int(k)) for k in ctw.keys_of([lowered(t).encode()])[0]) for j, t, _ in rows if j == i]
        assert sorted(got[i]) == pytest.approx(sorted(mine), rel=1e-9)
    even = ctw.scores(df, ctw.F.lit(None).cast("boolean")).collect()
    assert len(even) == len(rows) and all(r.score == pytest.approx(-8 * (r.n_bytes + 1) * math.log10(2)) and r.train_tokens == 0 and r.held_out for r in even)


def test_ctw_cut_changes_nothing(spark, monkeypatch):
    rng = random.Random(13)
    df = spark.createDataFrame([(i, text_of(rng, 20, 50)) for i in range(40)], "doc_id long, text string")
    train = ctw.F.col("doc_id") % 4 != 0
    whole = {r.id: r.score for r in ctw.scores(df, train).collect()}
    monkeypatch.setattr(ctw, "MOST_TOP", 5)
    assert {r.id: r.score for r in ctw.scores(df, train).collect()} == pytest.approx(whole, rel=1e-9)


def test_ctw_recursion():
    texts, depth = [b"abracadabra", b"abba cab", "naïve été".encode(), b""], 3
    keys, _ = ctw.keys_of(texts, depth)
    pairs = []
    for d in range(depth + 1):
        k, n = np.unique(keys & np.uint64(ctw.mask(d)), return_counts=True)
        pairs.append((k, n))
    model, want = ctw.Model(pairs), reference_ctw(texts, depth)
    some, _ = ctw.keys_of([b"abracadabrax", b"zq", b""], depth)
    assert model.log10(some) == pytest.approx([want(int(k)) for k in some], abs=1e-9)
    every = np.arange(256, dtype=np.uint64) | (some[0] & ~np.uint64(255))
    assert (10 ** model.log10(every)).sum() == pytest.approx(1, abs=1e-9)  # a distribution over the next byte


def test_ctw_keeps_rare_pairs(spark, monkeypatch):
    """Above 2^23 training bytes, where pairs seen once used to go; the parts of the tree against the whole one."""
    monkeypatch.setattr(ctw, "CHUNK", 50, raising=False)
    rng = random.Random(6)
    texts = ["abcdefgh " * 1_000_000] + [text_of(rng, 30) for _ in range(40)] + ["naïve été, Straße", "", "zq" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    keys = [ctw.keys_of([lowered(t).encode()])[0] for t in texts]
    known = np.concatenate([k for i, k in enumerate(keys) if i % 5 != 3])
    assert len(known) >> ctw.SHARE_BITS > 1
    model = ctw.Model([np.unique(known & np.uint64(ctw.mask(d)), return_counts=True) for d in range(ctw.DEPTH + 1)])
    got = {r.id: r.score for r in ctw.scores(df, ctw.F.col("doc_id") % 5 != 3).collect()}
    for i, k in enumerate(keys):
        distinct, n = np.unique(k, return_counts=True)
        assert got[i] == pytest.approx((model.log10(distinct) * n).sum(), rel=1e-6)


def test_packing(spark, docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}
    pieces = packing.packed(docs).collect()
    for doc, have in ids.items():
        mine = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.start for p in mine] == [0, *np.cumsum([p.length for p in mine])[:-1]] and sum(p.length for p in mine) == len(have)
        assert all(p.doc_tokens == len(have) and p.ids_crc32 == zlib.crc32(have[p.start : p.start + p.length].tobytes()) for p in mine)
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for ps in by.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]]
        assert sum(p.length for p in ps) == ps[0].window <= 2048 and ps[0].window & (ps[0].window - 1) == 0
    assert packing.packed(empty(spark)).count() == 0


def test_packing_long_runs_and_repeated_rows(spark):
    """A million blanks, line ends, letters; rows that share an id."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 1_000_000, "a" * 300_000, "x" + "\n " * 250_000 + "y <|endoftext|>", "same", "same"]
    df = spark.createDataFrame([(min(i, 3), x, 7) for i, x in enumerate(texts)], "doc_id long, text string, window int")
    have = collections.Counter()
    for p in packing.packed(df).collect():
        have[p.doc_id] += p.length
    assert len(packing.tokenizer()("<|endoftext|>")) > 1
    t.encode_special_tokens = True
    want = [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts]
    assert have == {0: want[0], 1: want[1], 2: want[2], 3: want[3] + want[4]}


def test_step_groups(spark, docs):
    groups = collections.defaultdict(set)
    for p in packing.packed(docs, step_tokens=4096).collect():
        groups[p.step_group].add((p.window, p.sequence_id))
    assert len({w for g in groups.values() for w, _ in g}) > 2
    for g in groups.values():
        assert len({w for w, _ in g}) == 1 and sum(w for w, _ in g) <= 4096


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(5)
    pages = [(1, "http://a/1", "<p>one</p>", 1), (2, "http://a/2", "<p>one</p>", 1), (3, "u\r\nx", None, 1), (4, "u", "", 1), (5, None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", 1), (6, "u", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(20_000)), 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, first int")
    path = f"file://{tmp_path}/w"
    warc.write(df, path)
    got = {warc_id: r for r in warc.read(spark, path).collect() for warc_id in [int(re.search(r"page:(\d+)>", r.record_id)[1])]}
    for i, _, text, _ in pages:
        body = (text or "").encode()
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and got[i].payload_bytes == len(body)
        same = [j for j, _, t, _ in pages if (t or "") == (text or "")]
        assert got[i].record_type == ("response" if max(same) == i else "revisit")
        if max(same) == i:
            assert bytes(got[i].payload) == body
        else:
            assert got[i].refers_to == warc.urn(max(same))
    warc.write(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_repeated_ids_and_bombs(spark, tmp_path, monkeypatch):
    pages = [(7, "a", "x"), (7, "b", "x"), (3, "c", "x"), (7, "d", "y")]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r.target_uri, r.record_type, r.refers_to) for r in got) == [("a", "revisit", warc.urn(7)), ("b", "response", None), ("c", "revisit", warc.urn(7)), ("d", "response", None)]
    monkeypatch.setattr(warc, "MOST_INFLATED", 1 << 20)
    bomb, small = warc.record(1, "u", b"\0" * (4 << 20), None, warc.digest(b"\0" * (4 << 20))), warc.record(2, "v", b"z", None, warc.digest(b"z"))
    found = list(warc.salvage(warc.gzipped(bomb) + warc.gzipped(small)))
    assert [f and f["warc-target-uri"] for _, _, f, _ in found] == [None, "v"]


def test_warc_long_headers(spark, tmp_path, monkeypatch):
    url = "data:text/plain," + "x" * 100_000
    warc.write(spark.createDataFrame([(1, "u", "a"), (2, url, "b"), (3, "u", "c")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert not any(r.gap for r in got) and sorted((bytes(r.payload), r.target_uri) for r in got) == [(b"a", "u"), (b"b", url), (b"c", "u")]
    rec = warc.record(2, url, b"b", None, warc.digest(b"b"))
    monkeypatch.setattr(warc, "_MEMBER", 1000)
    for data in (rec + rec, warc.gzipped(rec) * 2):  # plain, and with a header over many members
        assert [(f["warc-target-uri"], b) for _, _, f, b in warc.salvage(data)] == [(url, b"b")] * 2
    assert [f for _, _, f, _ in warc.salvage(rec[:50_000])] == [None]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = [warc.record(i, f"http://x/{i}", f"payload {i} ".encode() * 50, None, warc.digest(f"payload {i} ".encode() * 50)) for i in range(6)]
    parts = [warc.gzipped(r) if packed else r for r in records]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + b"junk" + parts[1] + bytes(broken) + parts[3] + parts[4][:-20] + parts[5]
    found = list(warc.salvage(data))
    assert [f["warc-target-uri"][-1] for _, _, f, _ in found if f] == ["0", "1", "3", "5"]
    assert sum(n for _, n, _, _ in found) == len(data)
    assert [b for _, _, f, b in found if f][0] == b"payload 0 " * 50
    assert list(warc.salvage(b"nothing")) == [(0, 7, None, b"")] and list(warc.salvage(b"")) == []


def test_large_records_span_members(monkeypatch):
    monkeypatch.setattr(warc, "_MEMBER", 1000)
    body = bytes(range(256)) * 32
    data = warc.gzipped(warc.record(1, "u", body, None, warc.digest(body)))
    assert data.count(b"\x1f\x8b\x08") > 5 and [(f["warc-type"], b) for _, _, f, b in warc.salvage(data + data)] == [("response", body)] * 2


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site, with a name</p></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies, yes, many.</div>
<div class="wrap"><div class="sidebar"><p>Other, things, to, read, here, now, and, then.</p></div><div class="content"><h1>A  title</h1><p>First, &lt;para&gt; of the\n article, long enough to count.</p><div class="ad">Buy, now, cheap, things</div>
<p>Second<br>para, with <a href=y>a link</a>.<ul><li>item one, with words</li><li>item two</ul><form><p>Name, mail, text</p></form><div id="comments"><p>Nice, I think, really, nice.</p></div></div></div><footer>&copy; x</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_html(spark):
    want = "A title\nFirst, <para> of the article, long enough to count.\nSecond para, with a link.\nitem one, with words\nitem two"
    deep = "<div>" * 5000 + "<p>deep, down, text, of some length here</p>"
    df = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "plain &amp; simple", 0), (5, "u", deep, 0), (1, "u", PAGE, 0)], "page_id long, url string, html string, text int")
    got = html.extracted(df).collect()
    texts = collections.defaultdict(list)
    for r in got:
        texts[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert texts == {1: [want, want], 2: [""], 3: [""], 4: ["plain & simple"], 5: ["deep, down, text, of some length here"]}
    assert html.extracted(df.limit(0)).count() == 0


def test_html_labelled_pages():
    """Pages of known blocks: the article's in order, nothing else. Several articles, lists of links inside, mathematics, broken quotes."""
    rng = random.Random(15)
    say = lambda: f"{text_of(rng, 12)}, {text_of(rng, 15)}, {text_of(rng, 9)}."
    for k in range(40):
        body = [say() for _ in range(rng.randrange(3, 9))]
        around = rng.choice(["<div class=content>%s</div>", "<article>%s</article>", "<main>%s</main>", "<section><div id=post>%s</div></section>"])
        marked = "".join(f"<p>{x}</p>" if i % 3 else f"<h2>{x}</h2>" for i, x in enumerate(body))
        page = f"<body><nav><a href=/>{say()}</a></nav>{around % marked}<div class='sidebar'><p>{say()}</p></div><div id=comments><p>{say()}</p></div><footer>{say()}</footer></body>"
        assert html.main_text(page) == "\n".join(body)
    two = [say() for _ in range(6)]
    assert html.main_text(f"<main><article><p>{two[0]}<p>{two[1]}<p>{two[2]}</article><article><p>{two[3]}<p>{two[4]}<p>{two[5]}</article></main>") == "\n".join(two)
    assert html.main_text(f"<article><p>{two[0]}<p>{two[1]}<ul><li><a href=x>{two[2]}</a></ul></article>") == "\n".join(two[:3])
    assert html.main_text(f"<article><p>{two[0]} <math><mi>x</mi></math></article>") == f"{two[0]} x"
    assert html.main_text(f'<p title="a>b">{two[0]}</p><p>{two[1]} <a href="x>y</a></p>') == f"{two[0]}\n{two[1]} y"
    assert html.main_text("a < b, and no tag") == "a < b, and no tag"


def test_html_is_linear():
    """Hostile pages: depth, broken quotes, unclosed raw elements, stray ends."""
    n = 20_000
    for page in ("<div>" * n + "<p>a, b, some text of it</p>" * n, '<a b="' * n + ">", "<title>" * n, "<b>" * n + "<div>x</div>" * n, "<div>" * n + "</section>" * n):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 8


def test_toxicity_edge_cases(spark):
    """Repeated rows and labels, one class only, an empty table, clashing names."""
    rows = [(i % 50, f"w{i % 50} common words {'grumblefool' if i % 5 == 0 else 'here'} " * 3, 9) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(50)] * 2, "doc_id long, toxic int")
    model = toxicity.learnt(docs, marks, toxicity.F.lit(True))
    got = toxicity.scored(docs, model).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.id].add(r.score)
    assert len(got) == 100 and all(len(x) == 1 for x in by.values())
    assert all((by[i].pop() >= 0.5) == (i % 5 == 0) for i in range(50))
    assert toxicity.learnt(docs, marks.where("toxic = 0"), toxicity.F.lit(True)) is None
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        w = text_of(rng, 80, 2000).split()
        if toxic := i % 5 == 0:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["grumblefool", "snarkwit", "blatherhead"]))
        rows.append((i, " ".join(w), 1.0))
        labels.append((i, 0, int(toxic)))
    rows += [(1000, None, 1.0), (1001, "", 1.0), (1002, rows[0][1] * 200, 1.0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learnt(docs, marks, common.remainder("id", 5) != 0)
    got = {r.id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [(got[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([(s >= 0.5) == bool(t) for s, t in held]) > 0.95
    assert got[1000] == got[1001] < 0.5 < got[1002] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.learnt(docs, marks.limit(0), common.remainder("id", 5) != 0) is None
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}


def test_ordinary_windows_are_spread(monkeypatch):
    """One long document does not use up the windows of the ordinary dictionary."""
    rng, taken = random.Random(2), []
    trained = toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda size, samples: taken.append(samples) or trained(size, samples))
    texts = [text_of(rng, 400_000)] + [f"only{i} " * 2000 for i in range(20)] + ["grumblefool snarkwit"] * 2
    toxicity.fit(texts, [False] * 21 + [True] * 2)
    said = b" ".join(taken[0])
    assert all(f"only{i} ".encode() in said for i in range(20)) and len(taken[0]) == toxicity.ORDINARY_WINDOWS


@pytest.mark.parametrize("block", [8192, 20])
def test_cover_trees(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = [rng.normal(size=8) for _ in range(60)]
    x += [v + rng.normal(size=8) * 0.1 for v in x[:30]] + [x[0]] * 3 + [x[0] * 2] + [x[1] + rng.normal(size=8) * 0.3 for _ in range(40)]
    rows = [(i, [float(c) for c in v], 0, 0) for i, v in enumerate(x)]
    bad = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, []]
    n = len(x)
    rows += [(n + k, v, 0, 0) for k, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int, copies int")
    got = {r.id: r for r in covertree.near_vectors(df).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    on = u @ u.T >= 0.95
    np.fill_diagonal(on, False)
    want = roots(n, list(zip(*np.nonzero(on))))
    assert [got[i].n_links for i in range(n)] == on.sum(axis=1).tolist() and [got[i].component_id for i in range(n)] == want
    assert all(got[n + k].n_links == 0 and got[n + k].component_id == n + k and got[n + k].kept for k in range(len(bad)))
    assert covertree.near_vectors(df.limit(0)).count() == 0


def test_cover_trees_repeated_ids_and_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (4, None)]
    got = sorted((r.id, r.n_links, r.component_id) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (4, 0, 4)]


def test_licences_any_words_may_differ(spark):
    """A template of which the rarest words, or any others that the rule allows, differ; repeated rows; the key phrase elsewhere."""
    mit = next(t for t in licences.TEMPLATES if t.label == "mit" and not t.base)
    said, spare, texts = mit.words, len(mit.words) - licences.least_found(mit), []
    key = range(*licences.key_place(mit))
    for at in itertools.combinations([k for k in range(len(said)) if k not in key], spare):
        texts.append((" ".join("other" if k in at else w for k, w in enumerate(said)), True))
    texts = texts[:: max(1, len(texts) // 150)]
    texts += [(" ".join("other" if k == key[0] else w for k, w in enumerate(said)) + ", permission is hereby granted", False), (" ".join(said[2:]), False)] * 2
    df = spark.createDataFrame([(i // 2, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = collections.Counter((r.id, r.labels, round(r.score, 6)) for r in licences.scanned(df).collect())
    want = collections.Counter((i // 2, "mit" if ok else "", round((len(said) - spare) / len(said), 6) if ok else 0.0) for i, (_, ok) in enumerate(texts))
    assert got == want


def test_licences(spark):
    texts = [None, "", "x. GNU General Public License v3, mit license; CC BY 4.0", "mit license mit license apache-license", "gnu general public", "cc0 by", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "word " * 5000 + "Apache License"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    got = {r.id: r for r in licences.scanned(df).collect()}
    bases = {tuple(t.words): t.label for t in licences.TEMPLATES if t.base}
    for i, t in enumerate(texts):
        w = re.findall(licences.WORD, lowered(t))
        at = [(k, label) for p, label in bases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[6].labels == "mit" and got[6].base_labels == "" and got[4].labels == ""
    assert licences.scanned(df.limit(0)).count() == 0


def test_boilerplate(spark):
    rows = [(i, f"Home \nline {i}\n\nbye {i % 2}", "h" if i % 4 else None, 0) for i in range(20)] + [(60 + k, "copied\npage", "h", 0) for k in range(30)] + [(50, None, "h", 0), (51, "", "h", 0), (52, "home\nHome", "h", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in boilerplate.cleaned(df, percent=50).collect()}
    hosts = collections.Counter(h for h, _ in {(r[2], r[1]) for r in rows if r[1] is not None})
    for i, t, h, _ in rows:
        pages = collections.Counter(x for u in {u for _, u, g, _ in rows if g == h and u is not None} for x in {y.strip(" \t\r") for y in u.split("\n")})
        drop = {x for x, c in pages.items() if x and c >= boilerplate.PAGES and 100 * c > 50 * hosts[h]}
        want = None if t is None else [x for x in t.split("\n") if x.strip(" \t\r") not in drop]
        assert got[i].text == (None if want is None else "\n".join(want)) and got[i].n_lines == (0 if t is None else t.count("\n") + 1)
        assert got[i].n_dropped == (0 if t is None else t.count("\n") + 1 - len(want))
    assert any(r.n_dropped for r in got.values()) and boilerplate.cleaned(df.limit(0)).count() == 0


def brute_overlaps(docs, items):
    found = set()
    tok = lambda t: re.findall(decontaminate.WORD, lowered(t))
    for i, t in docs:
        w = tok(t)
        for j, u in items:
            x = tok(u)
            size = min(decontaminate.WINDOW, len(x))
            for d in range(-len(x), len(w)):
                same = [0 <= k + d < len(w) and w[k + d] == x[k] for k in range(len(x))]
                if any(100 * sum(same[s : s + size]) >= (100 if len(x) < decontaminate.SPAN else decontaminate.PERCENT) * size for s in range(len(x) - size + 1)) and x:
                    found.add((i, j))
    return found


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, text_of(rng, n, 5000)) for k, n in enumerate([40, 25, 13, 9, 5])] + [(90, None), (91, "")]
    docs = [(i, text_of(rng, 80, 5000)) for i in range(10)]
    docs += [(20 + k, f"{text_of(rng, 30, 5000)} {t.upper()}, {text_of(rng, 30, 5000)}") for k, t in items[:5]]
    for k in range(6):
        w = items[0][1].split()
        for at in range(k % 3 + 3, 40, 9):
            w[at] = "swapped"
        docs.append((40 + k, text_of(rng, 10) + " " + " ".join(w)))
    docs += [(60, None), (61, ""), (62, items[0][1]), (62, "repeated id")]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id) for r in decontaminate.overlaps(left, right).collect()}
    assert got == brute_overlaps(docs, items) and len(got) >= 10
    judged = decontaminate.judged(left, right).collect()
    assert len(judged) == len(docs) and {r.id for r in judged if r.contaminated} == {i for i, _ in got}
    assert decontaminate.judged(left.limit(0), right).count() == 0
    assert not any(r.contaminated for r in decontaminate.judged(left, right.limit(0)).collect())


def test_decontamination_finds_words_once(spark, monkeypatch):
    """The words of a text without hits are those of WORD, and are found once."""
    texts = [None, "", " .", "A-b_c", "  É éİ,ß 語\x00\x7f\x80😀 z\n", "K 0Z9z...", "a"] + [f"text {i} has words, " * 3 for i in range(30)]
    left = spark.createDataFrame([(i, t, re.findall(decontaminate.WORD, lowered(t))) for i, t in enumerate(texts)], "doc_id long, text string, words array<string>")
    right = spark.createDataFrame([(0, "Quite another passage of a benchmark, and it is found in none of those.")], "item_id long, text string")
    got = left.select(decontaminate.tokens(left.text).alias("got"), F.transform("words", lambda w: F.xxhash64(w)).alias("want")).collect()
    assert len(got) == len(texts) and all(r.got == r.want for r in got)
    calls, plain = spark.sparkContext.accumulator(0), decontaminate.tokens

    def counted(t):
        if not (t or "").startswith("Quite"):
            calls.add(1)
        return t

    seen = F.udf(counted)
    monkeypatch.setattr(decontaminate, "tokens", lambda text: plain(seen(text)))
    assert decontaminate.overlaps(left, right).count() == 0 and calls.value == len(texts)


def test_every_passing_window_is_seeded(spark):
    """All substitutions that the rule allows, in otherwise whole copies of items of 9 to 13 words and of 14."""
    items, docs = [], []
    for n in range(9, 15):
        w = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(w)))
        for changes in range(4):
            for at in itertools.combinations(range(n), changes):
                docs.append((len(docs), " ".join("other" if k in at else x for k, x in enumerate(w))))
        docs += [(len(docs) + a, " ".join(w[a:b])) for a, b in ((0, n - 1), (1, n), (0, n - 2), (1, n - 1), (2, n))]
        docs = [(i, t) for i, (_, t) in enumerate(docs)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id) for r in decontaminate.overlaps(left, right).collect()}
    want = {(i, n) for i, t in docs for n, u in items if f"i{n}w" in t and brute_overlaps([(i, t)], [(n, u)])}
    assert got == want and len(want) > 400


def test_words():
    texts = [lowered(t).encode() for t in ["A b", "", "  x\ty\n", "é"]]
    hashes, bounds = words.word_hashes(texts)
    assert np.diff(bounds).tolist() == [2, 0, 2, 1] and len(set(hashes.tolist())) == 5
    assert words.word_hashes([b"b a"])[0].tolist() == hashes[[1, 0]].tolist()
