"""Training-data operators against brute force, round trips and held-out labels, with the edge cases of their docstrings."""

import hashlib
import random
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docpipe.llm import common, decontaminate, embedding_dedup, jaccard, license_scan, sentencepieces, sharding, token_files, toxicity, url_filter, warc

tokenizers_file = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, n_words int, key long, a string"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", 7, 7, "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "one", "two words", "a b c", "a b c", "é　ﬁ① \x00 漢字 <|endoftext|> <s>", "x" * 3000, "lorem ipsum " * 2000]


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_parted(spark, monkeypatch):
    """The second part holds no key that is wanted, whatever the bitmap's size; together the parts are all rows."""
    rows = spark.createDataFrame([(i if i % 50 else None, i, i) for i in range(2000)], "k long, word long, mask long")
    for some in ([3, 700, 1999], [None, 5], [], range(1, 2000, 2)):
        wanted = spark.createDataFrame([(x,) for x in some], "w long")
        for bits in (64, 1 << 16):
            monkeypatch.setattr(common, "BITS", bits)
            maybe, never = common.parted(rows, "k", wanted, "w")
            assert maybe.columns == never.columns == rows.columns
            a, b = [(r.k, r.word) for r in maybe.collect()], [(r.k, r.word) for r in never.collect()]
            assert sorted(w for _, w in a + b) == list(range(2000)) and not {k for k, _ in b} & set(some)
            assert bits == 64 or len(a) <= sum(k in set(some) for k, _ in a) + 60


@pytest.mark.parametrize("few", [0, common.FEW])
def test_components(spark, few):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    want = groups(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)


def near_texts(seed, family, n):
    rng = random.Random(seed)
    out = []
    for _ in range(family):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(12, 160))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def shingled(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(sets, pct):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j])]


@pytest.mark.parametrize("n,pct,block,frequent", [(3, 90, 2048, 12), (5, 80, 2048, 12), (5, 80, 16, 3)])
def test_jaccard(spark, monkeypatch, n, pct, block, frequent):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(21)
    # one core that all texts of a group share, with a tenth to a fourth of each text its own: most pairs are close to the threshold
    core = [f"c{j}" for j in range(150)]
    close = [" ".join([*core, *(f"o{k}x{j}" for j in range(rng.randrange(4, 45)))]) for k in range(160)]
    texts = [*near_texts(1, 12, 9), *near_texts(2, 1, 180), *close, *ODD]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts), n, pct).collect()}
    sets = [shingled(t, n) for t in texts]
    assert got == {i: (len(sets[i]), c) for i, c in groups(linked(sets, pct), range(len(sets))).items()}


def test_jaccard_ids(spark):
    """Repeated and null ids: rows of one doc_id share a component, rows without an id stand alone."""
    base = [f"w{i}" for i in range(40)]
    one, other = " ".join(base), " ".join(f"v{i}" for i in range(30))
    rows = [(7, one), (7, other), (3, other + " x"), (9, one + " y"), (9, one + " y"), (1, "else where"), (None, one), (None, None), (4, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(d, 5, 80).collect())
    want = [(7, 36, 3), (7, 26, 3), (3, 27, 3), (9, 37, 3), (9, 37, 3), (1, 1, 1), (-1, 36, None), (-1, 0, None), (4, 0, 4), (4, 0, 4)]
    assert got == sorted(want)
    gone = {(r.doc_id, r.th) for r in jaccard.near_copies(d, 5, 80).collect()}
    th = {(r.doc_id, r.text): r.th for r in d.select("doc_id", "text", jaccard.text_hash()).collect()}
    assert gone == {(7, th[7, other]), (9, th[9, one + " y"])}


def test_shingle_sets(monkeypatch):
    """Words and sets of a batch, cut into small pieces, against Python's own split; bitmaps bound what sets don't share."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choice("ab AB\t\x0b\x0c\n\r\xa0\u3000é") for _ in range(rng.randrange(60))) for _ in range(400))]
    want = {}
    for piece in (1, 7, 1 << 22):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        w, at = jaccard.word_hashes(pa.array(texts))
        for t, a, b in zip(texts, at, at[1:]):
            words = (t or "").encode().lower().split()
            assert len(words) == b - a
            assert all(want.setdefault(x, h) == h for x, h in zip(words, w[a:b].tolist()))
    assert len(set(want.values())) == len(want)
    s, at = jaccard.shingle_sets(pa.array(texts).slice(3), 3)
    assert [b - a for a, b in zip(at, at[1:])] == [len(shingled(t, 3)) for t in texts[3:]]
    sets = [np.unique(np.array([rng.randrange(3000) for _ in range(rng.randrange(1, 900))], np.int64)) for _ in range(30)]
    for x in sets:
        for y in sets:
            p, q = (np.frombuffer(jaccard.parities(v), np.uint8)[None] for v in (x, y))
            width = min(p.shape[1], q.shape[1])
            assert jaccard.apart(jaccard.folded(p, width), jaccard.folded(q, width))[0] <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("n,pct", [(3, 90), (5, 80)])
def test_jaccard_short(spark, n, pct):
    """The smallest sets that link with a larger one: the same words and one more at either end."""
    least_n, rng, texts = -(-pct // (100 - pct)), random.Random(6), []
    for size in range(least_n - 2, least_n + 8):
        for k in range(4):
            w = [f"{'common' if k == 3 else f's{size}k{k}'}x{j}" for j in range(size + n - 1)]
            texts += [" ".join(w), " ".join([*w, f"e{rng.randrange(10**6)}"]), " ".join([f"b{rng.randrange(10**6)}", *w])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts), n, pct).collect()}
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in map(str.split, texts)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j])]
    assert got == {i: (len(sets[i]), c) for i, c in groups(pairs, range(len(sets))).items()}
    assert got[3 * 4 * 2][1] == got[3 * 4 * 2 + 1][1] and got[3 * 4][1] != got[3 * 4 + 1][1]


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(docs(spark, []).where("false")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 32))
    x = np.concatenate([base, np.repeat(base[:20], 12, 0) + 0.08 * rng.standard_normal((240, 32)), base[:5]])
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(1000, None, "x"), (1001, [0.0] * 32, "x"), (1002, [float("nan")] * 32, "x"), (1003, [1.0], "x")]
    got = {r.vec_id: r for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, links string")).collect()}
    u = x / np.sqrt((x * x).sum(1))[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003))



def test_embeddings_of_any_size(spark):
    """Parallel vectors link whatever their sizes, up to those whose squares are no doubles."""
    v = np.random.default_rng(9).standard_normal((3, 8))
    rows = [(10 * k + i, (x * size).tolist()) for k, x in enumerate(v) for i, size in enumerate((1.0, 1e-170, 1e200, -1.0))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert np.abs(np.triu(u @ u.T, 1)).max() < 0.9
    assert got == {10 * k + i: ((2, 10 * k) if i < 3 else (0, 10 * k + 3)) for k in range(3) for i in range(4)}


def test_embeddings_lengths(spark, monkeypatch):
    """Vectors of several lengths: each links with those of its own length, in one leaf or in trees of their own."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 30)
    rng = np.random.default_rng(6)
    near = lambda w, k: [(v + 0.05 * rng.standard_normal(w)).tolist() for v in rng.standard_normal((k, w)) for _ in range(3)]
    x = [*near(16, 120), *near(8, 60), *near(5, 4), [1.0, 0.0], [2.0, 0.0], [0.0, 1.0]]
    rows = [(i, v) for i, v in enumerate(x)] + [(9000, [1.0, None]), (9001, [float("inf"), 1.0]), (9002, []), (None, [1.0, 0.0]), (9003, x[0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_components(d).collect()}
    cos = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.9
    sound = [(i, np.array(v)) for i, v in rows if i is not None and i not in (9000, 9001, 9002)]
    want = {i: sum(cos(v, u) for j, u in sound if j != i) for i, v in sound} | {9000: 0, 9001: 0, 9002: 0, None: 0}
    assert len(got) == len(rows) and all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.98 * sum(want.values())
    assert got[len(x) - 3] == got[len(x) - 2] == 1
    assert embedding_dedup.embedding_components(d.where("false")).count() == 0


@pytest.mark.parametrize("leaf", [48, 20])
def test_embeddings_dense_group(spark, monkeypatch, leaf):
    """A group of near copies many times as large as a leaf, beside others: small leaves stand for a deep forest."""
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    rng = np.random.default_rng(8)
    noisy = lambda k: rng.standard_normal(32) + 0.27 * rng.standard_normal((k, 32))
    x = np.concatenate([noisy(1200), noisy(150), rng.standard_normal((1500, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.sqrt((x * x).sum(1))[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert all(got[i] <= near[i].sum() for i in range(len(x)))
    assert sum(got[i] for i in range(len(x))) >= 0.98 * near.sum()


def test_embeddings_group_of_the_table(spark, monkeypatch):
    """A group of a hundredth of all vectors is taken out before the trees, so no leaf is split for it again and again; chains that
    lead out of it stay linked, copies count as often as they stand."""
    monkeypatch.setattr(embedding_dedup, "_split", lambda *a: pytest.fail("a leaf was split"))
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.standard_normal((12000, 32)), rng.standard_normal(32) + 0.27 * rng.standard_normal((150, 32)), rng.standard_normal((40, 32)).repeat(3, 0)])
    x[200:240] = x[12000:12040] + 0.3 * rng.standard_normal((40, 32))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.sqrt((x * x).sum(1))[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert got == {i: (near[i].sum(), c) for i, c in groups(np.argwhere(near).tolist(), range(len(x))).items()}


def test_embeddings_at_the_limit(spark):
    """Cosines a billionth above and below 0.9, vectors of four and of eight bytes a component: told apart in double precision."""
    rows, want = [], {}
    for k in range(40):
        axis = np.eye(90)[2 * k : 2 * k + 2]
        for side, cos in ((1, 0.9 + 1e-9), (-1, 0.9 - 1e-9)):
            rows.append((len(rows), (cos * axis[0] + side * np.sqrt(1 - cos * cos) * axis[1]).tolist()))
            want[len(rows) - 1] = side > 0
        rows.append((len(rows), axis[0].tolist()))
        want[len(rows) - 1] = 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want


@pytest.mark.parametrize("m", [40, 400])
def test_shared_numbers(m):
    """Few pairs are told by comparing lists, many by products."""
    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 9))) for _ in range(m)]
    r, q = np.triu_indices(m, 1) if m == 40 else rng.integers(0, m, (2, 20))
    got = embedding_dedup._shared(pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), 25, r, q)
    assert got.tolist() == [len({v for v in sets[a] if v < 25} & set(sets[b])) for a, b in zip(r, q, strict=True)]


def test_urls(spark):
    urls = ["https://www.Example.org/es/x?q#f", "http://example.org/en/17", "http://org/", "http://a.com/fr/1", "http://xcom/fr/", None, "no url", "ftp://example.org", "http://example.org./es/", "http://a.com/it/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    got = {(r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark)).collect()}
    rules = ["example.org/es/", "example.org/en/1", "org/", "com/fr/", None, None, None, None, None, None, "example.org/es/"]
    assert got == {(i, r, "block" if r and r.startswith("example") else "allow") for i, r in enumerate(rules)}


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizers_file.path("byte_bpe_50k.json")
    texts = [*ODD, *near_texts(4, 3, 10)]
    out = common.new_dir(spark, "t")
    manifest = token_files.write(docs(spark, texts), path, out)
    got = sorted(map(tuple, token_files.read(manifest, out).collect()))
    tok, start = Tokenizer.from_file(path), 0
    for (i, s, ids, w), t in zip(got, texts, strict=True):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert s == start and np.frombuffer(ids, f"<u{w}").tolist() == want
        start += len(want)
    one = manifest.first()
    assert token_files.read_one(one.uri, out, one.first_id).tolist() == [*tok.encode(texts[one.first_id] or "", add_special_tokens=False).ids, 0]
    assert token_files.read(token_files.write(docs(spark, ["x"]).where("false"), path, out), out).count() == 0


def test_warc(spark):
    long = "<p>" + "x" * 200
    html = [long, None, "", "short", "short", long, "é" * 80, long]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", h, 1) for i, h in enumerate(html)] + [(0, "http://h/0\n", long, 1)], "page_id long, url string, html string, digest int")
    got = sorted((r.metadata.page_id, r.response.type, r.aim_page, r.response.digest, r.copies) for r in warc.captures(warc.write(pages, common.new_dir(spark, "w"))).collect())
    assert [g[:3] for g in got] == [(0, "response", None), (1, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 0), (6, "response", None), (7, "revisit", 0)]
    assert [g[3] for g in got] == [hashlib.sha256((h or "").encode()).hexdigest() for h in html] and got[0][4] == 2


def test_warc_repeats(spark, monkeypatch):
    """Digests met by broadcast and by join give the same; null page_ids, an empty table, request lines."""
    pages = spark.createDataFrame([(i if i % 7 else None, f"http://h/{i}", f"{i % 5}" * 150) for i in range(60)], "page_id long, url string, html string")
    want = None
    for heavy in (2, 10_000):
        monkeypatch.setattr(warc, "HEAVY", heavy)
        rows = warc.captures(warc.write(pages, common.new_dir(spark, "w"))).collect()
        got = sorted((r.metadata.page_id or -1, r.response.type, r.aim_page or -1, r.response.target) for r in rows)
        assert len(got) == 60 and sum(g[1] == "response" for g in got) == 5 and want in (None, got)
        assert all(g[2] == min(i for i in range(60) if i % 7 and i % 5 == int(g[3][9:]) % 5) for g in got if g[1] == "revisit")
        want = got
    assert warc.captures(warc.write(pages.where("false"), common.new_dir(spark, "w"))).count() == 0
    asks = {"http://Ex.org:80/a b/?q=1#f": "GET /a%20b/?q=1 HTTP/1.1\r\nHost: Ex.org:80", "https://h?x": "GET /?x HTTP/1.1\r\nHost: h", "none": "GET / HTTP/1.1\r\nHost: ", "http://h/\né": "GET /%0A%C3%A9 HTTP/1.1\r\nHost: h"}
    assert {u: warc.request(u).decode().removesuffix("\r\n\r\n") for u in asks} == asks


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["grunk", "vlott", "snarp"]
    texts = [" ".join([f"w{rng.randrange(400)}" for _ in range(40)] + ([rng.choice(bad), rng.choice(bad)] if i % 4 == 0 else [])) for i in range(600)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    got = d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.score(d, model).alias("s")).collect()
    assert all(r.h == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r.h]
    assert sum((r.s >= 0.5) == (r.doc_id % 4 == 0) for r in test) >= 0.95 * len(test)
    odd = docs(spark, ODD)
    assert odd.select(toxicity.score(odd, model).alias("s")).where("s is null or s >= 0.5").count() == 0
    none = toxicity.fit(d, labels.where("false"))
    assert d.select(toxicity.score(d, none).alias("s")).where("s > 0.001").count() == 0


def test_decontaminate(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(30)}"
    items = [" ".join(word() for _ in range(n)) for n in (15, 10, 4, 30, 0)]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [f"{word()} {items[0].upper()} {word()}", items[3][5:], items[2] + "!" + items[2], *ODD]
    bench = spark.createDataFrame([*enumerate(items), (None, items[0]), (9, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        w, hit, found = decontaminate.words_of(t), set(), set()
        for k, item in enumerate(items):
            own = decontaminate.words_of(item)
            for s, e in decontaminate.spans(len(own)) if own else []:
                for a in range(len(w) - (e - s) + 1):
                    if w[a : a + e - s] == own[s:e]:
                        hit.update(range(a, a + e - s)), found.add(k)
        assert got[i] == (len(w), len(hit), sorted(found)), i


def licenses():
    made = license_scan.templates_of(license_scan.TEMPLATES)
    return made, {w for t in made for w in t.left}


def test_license():
    made, vocabulary = licenses()
    text = "the end of the world is " + license_scan.TEMPLATES["MIT"] + " the and of more"
    name, cover, found = license_scan.scan_text(text, made, vocabulary)
    assert name == "MIT" and cover >= 0.99 and [g[0] for g in found] == ["MIT"]
    # an outer word of the template that stands earlier, too
    for text, want in [("Licensed zoo. Licensed under the Apache License, Version 2.0.", "Apache-2.0 notice"), ("Released today. Released under the MIT License.", "MIT notice")]:
        name, cover, found = license_scan.scan_text(text, made, vocabulary)
        assert name == want and cover == 1 and [g[0] for g in found] == [want]
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(14))] for _ in range(2))
        got = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        assert len(got) <= lcs[-1][-1] and (len(got) == len(a) if a == b else True)


def test_license_windows():
    """Repeated and mixed notices between other words of the templates, in long texts; and single windows by brute force."""
    (made, vocabulary), rng = licenses(), random.Random(12)
    noise = lambda n: " ".join(rng.choice(["the", "under", "is", "of", "license", "word", "x1", "x2"]) for _ in range(n))
    for name, text in license_scan.TEMPLATES.items():
        for many in (1, 2, 3):
            whole = " ".join(noise(400) + " " + text for _ in range(many)) + " " + noise(400)
            got = [g for g in license_scan.scan_text(whole, made, vocabulary)[2] if g[0] == name and g[1] == 1]
            assert len(got) == many, (name, many)
        assert [g[1] for g in license_scan.scan_text(f"{text} {text}", made, vocabulary)[2] if g[0] == name] == [1, 1]
    mixed = license_scan.TEMPLATES["CC-BY-NC-4.0 notice"] + " " + noise(200) + " " + license_scan.TEMPLATES["Apache-2.0 notice"]
    assert {"CC-BY-NC-4.0 notice", "Apache-2.0 notice"} <= {g[0] for g in license_scan.scan_text(mixed, made, vocabulary)[2]}
    hit = all_ = 0
    for _ in range(400):
        a, t = [rng.randrange(5) for _ in range(rng.randrange(1, 16))], [rng.randrange(4) for _ in range(5)]
        lcs = lambda x: max((sum(1 for _ in c) for c in [[]] + [c for n in range(1, 6) for c in combinations(t, n) if subsequence(c, x)]), default=0)
        want = any(lcs(a[i : i + 10]) >= 4 for i in range(len(a)))
        got = license_scan.windows([x for x in a if x in t], [i for i, x in enumerate(a) if x in t], license_scan.Template("t", t))
        assert want or not got
        assert all(n <= lcs(a[f : e + 1]) and e - f < 10 and n >= 4 for n, f, e in got)
        hit, all_ = hit + bool(got), all_ + want
    assert hit >= 0.8 * all_ > 0, (hit, all_)  # no template, but the worst case of an alignment by unique words: chance runs of words that repeat


def test_license_threshold():
    """Short templates with changed and lost words between words of their own: found where the longest common subsequence reaches the
    threshold, up to a few in a hundred where words repeat, and nowhere else."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for distinct, least in ((True, 0.98), (False, 0.93)):
        for m in (5, 8, 13):
            rng, hit, all_ = random.Random(5), 0, 0
            for _ in range(500):
                t = rng.sample(range(m + 2), m) if distinct else [rng.randrange(m - 1) for _ in range(m)]
                some = lambda: [rng.randrange(m + 2) for _ in range(rng.randrange(m))]  # noqa: B023, E731
                a = some() + [x if rng.random() < 0.85 else rng.randrange(m + 2) for x in t if rng.random() < 0.95] + some()
                made = license_scan.Template("t", t)
                want = any(lcs(a[i : i + 2 * m], t) >= made.need for i in range(len(a)))
                got = license_scan.windows([x for x in a if x in t], [i for i, x in enumerate(a) if x in t], made)
                assert (want or not got) and all(lcs(a[f : e + 1], t) >= n >= made.need and e - f < 2 * m for n, f, e in got)
                hit, all_ = hit + bool(got), all_ + want
            assert hit >= least * all_ > 0, (distinct, m, hit, all_)


def test_license_recall():
    """Notices and license texts planted with a tenth of their words changed or dropped, between other words, are found where they stand."""
    (made, vocabulary), rng, hit, all_ = licenses(), random.Random(13), 0, 0
    for _ in range(60):
        words, spots = [], []
        for name in rng.sample(sorted(license_scan.TEMPLATES), 3):
            words += [f"n{rng.randrange(500)}" if rng.random() < 0.9 else rng.choice(["the", "of", "license", "software"]) for _ in range(rng.randrange(300))]
            own = license_scan.words_of(license_scan.TEMPLATES[name])
            edit = set(rng.sample(range(len(own)), len(own) // 10))
            spots.append((name, len(words)))
            words += [w.decode() if k not in edit else "edited" for k, w in enumerate(own) if k not in edit or rng.random() < 0.5]
        got = license_scan.scan_text(" ".join(words), made, vocabulary)[2]
        hit += sum(any(g[0] == name and abs(g[3] - at) <= 12 for g in got) for name, at in spots)
        all_ += len(spots)
    assert hit >= 0.95 * all_, (hit, all_)


def subsequence(c, x):
    it = iter(x)
    return all(w in it for w in c)


def test_license_rows(spark):
    got = license_scan.license_scan(docs(spark, [*ODD, "foo. Released under the MIT License."])).orderBy("doc_id").collect()
    assert len(got) == len(ODD) + 1 and [f.template for f in got[-1].found] == ["MIT notice"] and got[0].best_coverage == 0


def test_sharding(spark):
    texts = ["same text"] * 400 + [f"t{i} " * (i % 50) for i in range(800)] + [None, ""]
    got = sharding.shard_by_bytes(docs(spark, texts)).collect()
    assert len(got) == len(texts) and all(r.text_crc32 == crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 1 for r in got)
    size = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(size) - min(size) <= 2 * max(r.size for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(docs(spark, ["x"]).where("false")).count() == 0


def test_sentencepiece(spark):
    import sentencepiece

    path = tokenizers_file.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepieces.encode(docs(spark, ODD), path)
    assert "key" in got.columns and [list(r.ids) for r in got.orderBy("doc_id").collect()] == [sp.encode(t or "") for t in ODD]
    assert [r.text for r in sentencepieces.decode(got, path).orderBy("doc_id").collect()] == [sp.decode(sp.encode(t)) if t else "" for t in ODD]


def test_sentencepiece_clash(spark):
    """Columns that bear names used inside or of outputs, random strings of odd characters, an empty table."""
    import sentencepiece

    path, rng = tokenizers_file.path("piece_bpe_32k.model"), random.Random(14)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    alpha = list("abcdefghijklmnop qrstuvwxyz  \u2581éßüöä漢字\n\t'-.0123ABCXYZ\u3000ﬁ①🙂\x00")
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(120))) for _ in range(300)]
    d = spark.createDataFrame([(i, t, t, 5, "y") for i, t in enumerate(texts)], "doc_id long, text string, _text string, n_tokens int, ids string")
    got = sentencepieces.encode(d, path, digests=True).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = sp.encode(t)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r["_text"] == t
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepieces.encode(d.where("false"), path).count() == 0


def test_token_encoder(monkeypatch):
    """Random strings against the library, with a memory that turns over, and with pieces that do not line up."""
    from tokenizers import Tokenizer

    path, rng = tokenizers_file.path("byte_bpe_50k.json"), random.Random(15)
    alpha = list("abcde fghij  \n\té漢🙂'.,0123ABC")
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(150))) for _ in range(400)]
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(token_files, "REMEMBER", 300)
    enc = token_files.Encoder(open(path, encoding="utf-8").read())
    assert [x for k in range(0, 400, 50) for x in enc.encode(texts[k : k + 50])] == want
    enc.length = enc.length + 1
    enc.young, enc.old = {}, {}
    assert enc.encode(texts) == want and not enc.plain


def test_token_file_rows(spark, monkeypatch):
    """Null and repeated ids, several files a task."""
    monkeypatch.setattr(token_files, "FILE_BYTES", 400)
    path, out = tokenizers_file.path("byte_bpe_50k.json"), common.new_dir(spark, "t")
    texts = near_texts(9, 6, 8)
    rows = [(None, "no id"), (None, None), *((i // 3, t) for i, t in enumerate(texts))]
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, out)
    assert manifest.count() > 3
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, len(r.ids) // r.width) for r in token_files.read(manifest, out).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted(-1 if i is None else i for i, _ in rows)
    assert [g[1] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]


def test_proximity(spark):
    rng = random.Random(17)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(60)] + [None, ""]
    ids = {c.encode(): i for i, c in enumerate("abcdefgh")}
    phrases = {0: [0, 1, 2], 1: [3, 3], 2: [7, 4, 7, 1]}
    rows = spark.createDataFrame([(p, o, t) for p, ts in phrases.items() for o, t in enumerate(ts)], "phrase long, off int, term int")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    for slop in (0, 2):
        got = {(r.doc_id, r.phrase, r.pos) for r in decontaminate.proximity(decontaminate.postings(d, ids), rows, slop).collect()}
        count = [sum((t or "").split().count(c) for t in [*texts, texts[0]]) for c in "abcdefgh"]
        want = set()
        for i, t in [*enumerate(texts), (None, texts[0])]:
            w = [ids[x.encode()] for x in (t or "").split()]
            for p, ts in phrases.items():
                o = min(range(len(ts)), key=lambda o: (count[ts[o]], ts[o], o))
                for k, x in enumerate(w):
                    if x == ts[o] and all(any(w[q] == y and abs(q - (k - o + z)) <= slop for q in range(len(w))) for z, y in enumerate(ts)):
                        want.add((i, p, k))
        assert got == want and want, slop


def test_decontaminate_blocks(spark, monkeypatch):
    """Several blocks of windows give what one block gives; repeated and null ids, an empty table on either side."""
    rng = random.Random(18)
    word = lambda: f"w{rng.randrange(25)}"
    items = [(i % 5, " ".join(word() for _ in range(rng.randrange(3, 30)))) for i in range(9)]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) + " " + rng.choice(items)[1] for _ in range(40)]
    d = spark.createDataFrame([(i // 2 if i else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = lambda: sorted((r.doc_id if r.doc_id is not None else -1, r.th, r.n_words, r.n_hit, sorted(r["items"])) for r in decontaminate.decontaminate(d, bench).collect())
    whole = told()
    monkeypatch.setattr(decontaminate, "BLOCK", 12)
    assert told() == whole and len(whole) == len(texts) + 2 and all(r[3] for r in whole if r[2])
    assert decontaminate.decontaminate(d, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(d.where("false"), bench).count() == 0


def test_ftrl():
    """The fit against a plain FTRL-proximal loop over single coordinates."""
    rng = random.Random(19)
    rows = [(np.array(sorted(rng.sample(range(32), 6))), rng.randrange(2)) for _ in range(80)]
    bias, at, w = toxicity.ftrl(rows, bits=5, epochs=16)
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        l1 = 0 if i == 32 else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(16):
        for f, y in rows:
            i = [*f.tolist(), 32]
            v = [weight(k) for k in i]
            g = 1 / (1 + np.exp(-sum(v))) - y
            for k, old in zip(i, v):
                s = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA
                z[k] += g - s * old
                n[k] += g * g
    want = {k: weight(k) for k in range(32) if weight(k)}
    assert want.keys() == set(at.tolist()) and np.allclose([want[k] for k in at.tolist()], w) and abs(bias - weight(32)) < 1e-9


def test_toxicity_repeats(spark):
    """A doc_id on many rows is learnt from once; empty tables."""
    d = spark.createDataFrame([(1, f"bad {i}") for i in range(500)] + [(k, "good words") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(60)], "doc_id long, toxic int")
    assert d.select(toxicity.score(d, toxicity.fit(d, labels)).alias("s")).where("s is null").count() == 0
    assert toxicity.fit(d.where("false"), labels)[0] == -35
