"""Token counts, importance resampling and conversation repair against libraries and brute force, with their odd cases."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from docpipe.llm import conversation_repair as cr
from docpipe.llm import resample as rs
from docpipe.llm import token_counts as tc

tokenizers_file = pytest.importorskip("public_tokenizers")
R = random.Random(5)
TEXTS = [
    None, "", " ", "  ", "a ", "ab  cd", "▁x ▁ y", " lead", "a" * 5000, " " * 3000, "=-" * 2000, "漢字仮名" * 900, "hello <|endoftext|> world <s> " * 200,
    "é　ﬁ① \x00 漢字", "".join(R.choice("ab  \n=é漢😀▁.") for _ in range(6000)), "".join(R.choice("aaab ") for _ in range(9000)), "x" * 3000 + " " + "y" * 3000,
]


def library(name):
    path = tokenizers_file.path(name)
    if name.endswith(".model"):
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_file=path)
        return lambda t: len(sp.encode(t))
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(path)
    return lambda t: len(k.encode(t, add_special_tokens=False))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("sizes", [{"huge": 500, "size": 300, "overlap": 8}, {}])
def test_token_counts(spark, name, sizes):
    """Chunked or not, counts are the library's; where no boundary is near, overlaps are widened to the end of the run."""
    df = spark.createDataFrame([(i if i % 5 else None, t, "kept", 7) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, doc string, n_tokens int")
    count = library(name)
    got = tc.token_counts(df, tokenizers_file.path(name), limit=50, **sizes)
    assert got.columns == ["doc_id", "doc", "n_bytes", "n_tokens", "over_limit"]
    want = [(len((t or "").encode()), count(t or "")) for t in TEXTS * 2]
    assert sorted((r.n_bytes, r.n_tokens) for r in got.collect()) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 50) and r.doc == "kept" for r in got.collect())
    assert tc.token_counts(df.limit(0), tokenizers_file.path(name), **sizes).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_stable_boundaries(name):
    """Cut at any boundary that is told stable, a text has the tokens of its parts, for each pair of texts around it."""
    rng = random.Random(2)
    with open(tokenizers_file.path(name), "rb") as f:
        c = tc.counter(name, f.read())
    for _ in range(150):
        text = "".join(rng.choice(["the ", "in", " ", "\n", "é", "漢", "ing", "▁", "==", "a", "1", "😀"]) for _ in range(60))
        p = c.stable(text, 10)
        if p is None:
            continue
        starts, measure = c.starts(text)
        assert measure(p) in set(starts.tolist())
        for other in ("", "zz ", "漢 a"):  # what stands left of it does not matter to what begins behind it
            again, m2 = c.starts(other + text[p - 1 :])
            assert (again >= m2(len(other) + 1)).sum() == (starts >= measure(p)).sum()


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def features_of(text):
    w = words_of(text)
    return [crc32(x) % 10000 for x in w + [a + b" " + b for a, b in zip(w, w[1:])]]


def test_features():
    texts = ["", "One two-THREE é漢 x1", " ", "a" * 64 + " " + "b" * 65 + " c", "z" * 300 + " " + "y" * 200, "no_word", "漢", "end"]
    for some in (texts, texts[2:5], []):
        doc, bucket, words = rs.features(pa.array(texts, pa.string()).slice(2, 3) if len(some) == 3 else pa.array(some, pa.string()))
        got = Counter(zip(doc.tolist(), bucket.tolist()))
        assert got == Counter((i, b) for i, t in enumerate(some) for b in features_of(t))
        assert words.tolist() == [len(words_of(t)) for t in some]


def resampled(docs, target, percent=25, least=20):
    s, t = (Counter(b for x in xs for b in features_of(x)) for xs in ([x for _, x in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ns + 10000.0) / ((s[b] + 1.0) * (nt + 10000.0)))) for b in range(10000)]
    out = []
    for i, x in docs:
        f = features_of(x)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x)) >= least])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    rank = {}
    for k, x in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(tuple(x), []).append(k + 1)
    return sorted(((*x[:4], (rank.get(tuple(x)) or [None]).pop(0) if rank.get(tuple(x)) else None) for x in out), key=repr)


def test_resample(spark, monkeypatch):
    """Ranks are those of one sort, whatever the runs and segments; a doc_id that many equal rows share is cut as well."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(50)] + ["Über", "漢字", "x" * 70]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(0, 60))) for _ in range(300)]
    docs = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 200 + [(6, None), (7, "")]
    target = [" ".join(rng.choices(vocab[:10], k=30)) for _ in range(20)] + [None]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(5)
    to = spark.createDataFrame([(t,) for t in target], "text string")
    for run, segment, marked in ((rs.RUN, rs.SEGMENT, rs.MARKED), (20, 30, 5 * 7)):
        for k, v in {"RUN": run, "SEGMENT": segment, "MARKED": marked}.items():
            monkeypatch.setattr(rs, k, v)
        for percent in (25, 100):
            got = [tuple(r) for r in rs.resample(df, to, percent=percent).collect()]
            assert sorted(got, key=repr) == resampled(docs, target, percent)
    assert rs.resample(df.limit(0), to).count() == 0
    assert all(r["rank"] is None for r in rs.resample(df, to.limit(0), percent=0).collect())


def cheapest(rows):
    """(cost, audit) by a search over all edits, least cost and then least audit first."""
    seen, faults = set(), []
    for _, role, text, _ in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    ok = lambda x: re.fullmatch("(s?(ua)+)?", x)
    begun = lambda x: re.fullmatch("s?(ua)*u?", x)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, text = heapq.heappop(heap)
        if i == len(rows) and ok(shape):
            return faults, cost, audit, text
        if (i, shape[-1:]) in done:
            continue
        done.add((i, shape[-1:]))
        steps = [("I", 2, i, x, f"{n}:") for x, n in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            _, role, t, _ = rows[i]
            steps.append(("D", 3, i + 1, "", None))
            if faults[i] not in ("b", "d"):
                more = faults[i] == "t"
                steps.append(("K", more, i + 1, role[:1] or "-", f"{role}:{t}"))
                steps += [("R", 2 + more, i + 1, x, f"{n}:{t}") for x, n in (("u", "user"), ("a", "assistant"))]
        for e, c, j, x, line in steps:
            if begun(shape + x):
                heapq.heappush(heap, (cost + c, audit + e, j, shape + x, text if line is None else (*text, line)))


def conversation(rng, n):
    roles = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool", " "], ["assistant"], ["user"]])
    texts = ["Yes.", "No!", "why", " \t", "", "Fine?  ", "go on…", "a.b"]
    return [(t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.", 0) for t in range(n)]


def test_repair_against_search(spark):
    rng = random.Random(4)
    every = {c: conversation(rng, rng.randrange(0, 9)) for c in range(250)}
    want = {}
    for c, rows in every.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, cost, audit, text = cheapest(rows)
        got = cr.repaired(rows)
        assert (got["cost"], got["audit"]) == (cost, audit), rows
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(text).encode()).hexdigest()
        assert [got[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(x) for x in "bdt"]
        want[c] = got
    df = spark.createDataFrame([(c or None, *r) for c, rows in every.items() for r in rows], "conv_id long, turn long, role string, text string, copy int").repartition(3)
    ids = spark.createDataFrame([(c or None,) for c in every], "conv_id long")
    for long_rows, block in ((cr.LONG_ROWS, cr.BLOCK_ROWS), (3, 40), (0, 7)):
        got = {r["conv_id"] or 0: r.asDict() for r in cr.repair(df, ids, long_rows, cr.LONG_BYTES, block).collect()}
        assert {c: {k: v for k, v in r.items() if k != "conv_id"} for c, r in got.items()} == want
    assert cr.repair(df.limit(0)).count() == 0


def test_long_conversation(spark):
    """Half of all rows are one conversation: blocks give what one pass gives; equal rows are duplicates across blocks."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Same.", "", f"T{t}.", f"open {t}"]), 0) for t in range(3000)] + [(1, 7, "user", "Again.", 0)] * 20
    rows += [(c, t, "user", "Hi.", 0) for c in range(2, 300) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy int")
    want = cr.repaired([r[1:] for r in rows if r[0] == 1])
    got = cr.repair(df, long_rows=100, block_rows=333).where("conv_id = 1").first().asDict()
    assert {k: v for k, v in got.items() if k != "conv_id"} == want


def test_runs():
    """A run by binary powers is the run row by row; matrices of parts compose."""
    rng = random.Random(1)
    for _ in range(200):
        symbols = rng.choices([0, *range(1, 9)], k=rng.randrange(1, 40)) if rng.random() < 0.5 else [rng.randrange(9)] * rng.randrange(1, 400)
        v = cr.END
        for s in reversed(symbols):
            v = cr.times(cr.power(s, 0), v)
        assert (cr.costs(cr.runs_of(symbols), cr.END)[0] == v).all()
        m = np.where(np.eye(4) > 0, 0, cr.NEVER)
        for run in reversed(cr.runs_of(symbols)):
            m = cr.advanced(run, m)
        assert (cr.times(m, cr.END) == v).all()


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(8) for t in range(40)] + [(None, None, None, None), (None, 1, "user", None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        hit = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if hit:
            want[c, t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text] += 1 + (hit == 3)
    assert got == want
