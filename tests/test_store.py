"""Search and the points table: odd vectors, dealt queries, pruned pairs, documents that are replaced and deleted."""

import numpy as np
import pyarrow as pa
import pytest

from docpipe.operators import search as se
from docpipe.streaming import ingest as ing

ODD = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0]]
POINT = "id long, embedding array<double>"


def exact(vectors, queries, k, metric):
    out = set()
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and (metric != "cosine" or any(v))
    for q, a in queries:
        s = []
        for i, b in vectors:
            if ok(a) and ok(b) and len(a) == len(b):
                a_, b_ = np.array(a) / (max(map(abs, a)) if metric == "cosine" else 1), np.array(b) / (max(map(abs, b)) if metric == "cosine" else 1)
                v = {"dot": lambda: a_ @ b_, "cosine": lambda: a_ @ b_ / np.linalg.norm(a_) / np.linalg.norm(b_), "euclid": lambda: np.linalg.norm(a_ - b_)}[metric]()
                s.append((round(float(v), 6), i))
        s.sort(key=lambda x: (x[0] if metric == "euclid" else -x[0], x[1]))
        out |= {(q, r + 1, i, v) for r, (v, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("block", [7, se.BLOCK])
def test_knn(spark, monkeypatch, metric, block):
    """Few queries are broadcast, more are dealt; both give what all pairs give, whatever stands among the vectors."""
    monkeypatch.setattr(se, "BLOCK", block)
    monkeypatch.setattr(se, "POINTS", 16)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=2 + i % 3).tolist()) for i in range(60)] + [(100 + i, v) for i, v in enumerate(ODD)]
    queries = [(f"q{i}", rng.normal(size=2 + i % 2).tolist()) for i in range(20)] + [(f"odd{i}", v) for i, v in enumerate(ODD)]
    p, q = spark.createDataFrame(vectors, POINT), spark.createDataFrame(queries, "query_id string, embedding array<double>")
    got = se.knn(p, q, 4, metric)
    assert {(r.query_id, r["rank"], r.id, round(r.score, 6)) for r in got.collect()} == exact(vectors, queries, 4, metric)
    assert se.knn(p.limit(0), q, 4, metric).count() == se.knn(p, q.limit(0), 4, metric).count() == 0
    if metric == "cosine":
        big = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-170, 0.0])], POINT)
        one = spark.createDataFrame([("q", [3.0, 3.0])], "query_id string, embedding array<double>")
        assert [(r.id, round(r.score, 6)) for r in se.knn(big, one, 2).orderBy("rank").collect()] == [(1, 1.0), (2, round(0.5**0.5, 6))]


def all_pairs(vectors, top):
    ok = [(i, np.array(v) / np.abs(v).max()) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    s = {(min(i, j), max(i, j), round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12)) for n, (i, a) in enumerate(ok) for j, b in ok[:n] if len(a) == len(b) and i != j}
    return [(i, j, round(v, 6)) for i, j, v in sorted(s, key=lambda x: (-x[2], x[0], x[1]))[:top]]


@pytest.mark.parametrize("side", [5, 512])
def test_similar_pairs(spark, side):
    rng = np.random.default_rng(5)
    good = [(1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [0.0, 1.0])]
    for odd in [[], [(9, [0.0, 0.0])], [(9, None)], [(8 + i, v) for i, v in enumerate(ODD)]]:
        got = se.similar_pairs(spark.createDataFrame(good + odd, POINT), 3, side).collect()
        assert [(r.i, r.j, round(r.score, 6)) for r in got] == all_pairs(good, 3)
    many = [(i, (rng.normal(size=3 + i % 2) * 10.0 ** rng.integers(-200, 140)).tolist()) for i in range(60)] + [(i, [1.0, 2.0, 3.0]) for i in range(20, 24)] + [(5, None), (7, [1.0])] * 2
    for top in (1, 6, 40):
        got = se.similar_pairs(spark.createDataFrame(many, POINT), top, side).collect()
        assert [(r.i, r.j, round(r.score, 6)) for r in got] == all_pairs(many, top)
    assert se.similar_pairs(spark.createDataFrame([], POINT)).count() == se.similar_pairs(spark.createDataFrame(good[:1], POINT)).count() == 0


def test_pairs_are_pruned(spark):
    """In clusters, few pairs are compared, and the result is that of all pairs; a cluster may hold a third of all rows."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 16))
    vectors = [(i, (centers[0 if i % 3 == 0 else i % 40] + rng.normal(size=16) * 0.05).tolist()) for i in range(6000)]
    copies = [(6000 + i, (np.array(vectors[i * 7][1]) * 1.001 + 1e-4).tolist()) for i in range(6)]  # so near that a grid is of use
    for some, share in ((vectors, 3), (vectors + copies, 4)):
        compared, every = se.compared_pairs(spark.createDataFrame(some, POINT), 5, side=100)
        assert every == len(some) * (len(some) - 1) // 2 and compared * share < every
        x = np.array([v for _, v in some])
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = x @ x.T
        i, j = np.triu_indices(len(some), 1)
        at = np.argsort(-s[i, j], kind="stable")[:5]
        assert [(r.i, r.j) for r in se.similar_pairs(spark.createDataFrame(some, POINT).repartition(4), 5, side=100).collect()] == [(int(i[a]), int(j[a])) for a in at]


def test_equal_vectors(spark):
    """A third of all rows are one vector: of them only the smallest ids can be in a first pair."""
    rows = [(i * 37 % 1000, [1.0, 2.0] if i % 3 else [float(i), 1000.0]) for i in range(1000)]
    got = se.similar_pairs(spark.createDataFrame(rows, POINT), 5, 50).collect()
    ids = sorted(i for i, v in rows if v == [1.0, 2.0])
    assert [(r.i, r.j, r.score) for r in got] == [(ids[0], ids[k], 1.0) for k in range(1, 6)]


def test_pairs_meet_in_blocks_of_cells(spark):
    """Directions without clusters: a vector travels once for each other block, not for each cell; the result is that of all pairs.
    Pairs of one id take no place of others."""
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=32).tolist()) for i in range(1200)]
    rows, cells, near, *_ = se._paired(spark.createDataFrame(vectors, POINT), 5, 10, 64)
    met, _ = se._met_blocks(rows, cells, near, 10)
    assert len(near) > 1000 and met.count() < 10 * len(vectors) and met.groupBy("a", "b").count().agg({"count": "max"}).first()[0] <= 4 * se.MEET * 10
    got = se.similar_pairs(spark.createDataFrame(vectors, POINT), 5, 10, 64).collect()
    assert [(r.i, r.j, round(r.score, 6)) for r in got] == all_pairs(vectors, 5)
    same = [(1, [1.0, 0.001 * k]) for k in range(9)] + [(2, [1.0, 0.5]), (3, [0.0, 1.0])]
    assert [(r.i, r.j) for r in se.similar_pairs(spark.createDataFrame(same, POINT), 2).collect()] == [(1, 2), (1, 2)]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_scores_are_held_in_tiles(spark, monkeypatch, metric):
    """Few scores are held at once, and equal vectors rank by their ids wherever they stand."""
    seen = []
    first = se._first
    monkeypatch.setattr(se, "SCORES", 64)
    monkeypatch.setattr(se, "_first", lambda q, x, k, m: (seen.append(len(q) * len(x)), first(q, x, k, m))[1])
    rng = np.random.default_rng(9)
    base = rng.normal(size=(5, 33))
    points = pa.record_batch({"id": pa.array(np.arange(60)[::-1]), "embedding": pa.array([base[i % 5].tolist() for i in range(60)])})
    queries = pa.record_batch({"query_id": pa.array(range(40)), "embedding": pa.array(rng.normal(size=(40, 33)).tolist())})
    got = pa.Table.from_batches(se._best(queries, se._matrices(queries["embedding"], metric), points, 3, metric)).to_pylist()
    assert max(seen) <= 64 and len(got) == 40 * 3
    for q in range(40):
        mine = [r for r in got if r["query_id"] == q]
        assert len({r["score"] for r in mine}) == 1 and len({r["id"] % 5 for r in mine}) == 1 and sorted(r["id"] for r in mine)[-1] < 15


def run(spark, tmp_path, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.mode("append").parquet(str(tmp_path / "in"))
    ing.ingest(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), **kw).awaitTermination()
    return held(spark, tmp_path)


def held(spark, tmp_path):
    out: dict = {}
    for r in ing.current(spark, str(tmp_path / "out")).orderBy("document_uri", "chunk_index").collect():
        out.setdefault(r.document_uri, []).append((r.chunk_index, r.content))
    return out


def test_first_batch_without_words(spark, tmp_path):
    assert ing.current(spark, str(tmp_path / "out")).count() == 0
    assert run(spark, tmp_path, [(1, ""), (2, None), (3, "  ")]) == {}
    assert run(spark, tmp_path, [(1, "now words"), (None, "no name")]) == {"1": [(0, "now words")], "": [(0, "no name")]}
    assert run(spark, tmp_path, [(None, "other")]) == {"1": [(0, "now words")], "": [(0, "other")]}


def test_documents_are_replaced_and_deleted(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(2000))
    assert [len(v) for v in run(spark, tmp_path, [(1, long), (2, "two"), (2, "two longer")]).values()] == [5, 1]
    got = run(spark, tmp_path, [(1, "short now"), (3, "three")])
    assert got == {"1": [(0, "short now")], "2": [(0, "two longer")], "3": [(0, "three")]}
    table, uris = str(tmp_path / "out"), lambda *x: spark.createDataFrame([(u,) for u in x], "document_uri string")
    assert ing.delete(spark, table, uris("1", "3", "none", "3")) == 2 and held(spark, tmp_path) == {"2": [(0, "two longer")]}
    assert ing.delete(spark, table, uris("1")) == 0 and ing.delete(spark, table, uris()) == 0
    assert run(spark, tmp_path, [(2, "")]) == {}
    assert run(spark, tmp_path, [(1, "back"), (2, "again")]) == {"1": [(0, "back")], "2": [(0, "again")]}


def test_versions_go_after_their_grace(spark, tmp_path):
    table = str(tmp_path / "out")
    for i in range(3):
        run(spark, tmp_path, [(1, f"text {i}")])
    assert len(ing._versions(spark, table)) == 3 and ing.clean(spark, table) == 0
    before = ing.current(spark, table)
    assert ing.clean(spark, table, 0) == 2 and [r.content for r in before.collect()] == ["text 2"]
    assert len(ing._versions(spark, table)) == 1 and held(spark, tmp_path) == {"1": [(0, "text 2")]}


def test_a_batch_again(spark, tmp_path):
    """A batch that failed half-way is run again: the table is the same as after one run."""
    table, d = str(tmp_path / "out"), spark.createDataFrame([("1", "a b"), ("2", "c")], "doc_id string, text string")
    for _ in range(2):
        ing.replace(spark, table, d.selectExpr("doc_id as document_uri"), ing.points_of(d))
    assert held(spark, tmp_path) == {"1": [(0, "a b")], "2": [(0, "c")]}
    assert ing.replace(spark, table, d.selectExpr("doc_id as document_uri"), ing.points_of(d.limit(1))) == {"deleted": 2, "inserted": 1}
