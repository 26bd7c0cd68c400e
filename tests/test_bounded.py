"""What a Python worker holds and how often pages are parsed: pieces and rows go on in small batches, folds are sweeps, one parse a job."""

import pyarrow as pa

from docpipe.operators import chunking as ch
from docpipe.operators import html_rows as hr
from docpipe.plans import jobs


def swept(df, monkeypatch, make):
    """(the function that make runs in Arrow batches, its result)."""
    held = []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **kw: (held.append(f), plain(self, f, *a, **kw))[1])
    return make(df), held[0]


def test_pieces_go_on_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(ch, "HELD", 10_000)
    texts = ["word; " * (i * 10) for i in range(100)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for keep in (None, ["doc_id"]):
        out, run = swept(df, monkeypatch, lambda d, keep=keep: ch.plain_windows(d, "text", most=50, overlap=5, keep=keep))
        given = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
        batches = list(run(iter([given])))
        assert len(batches) > 20 and max(b.nbytes for b in batches) < 30_000 and out.columns[: 1 if keep else 2] == ["doc_id", "text"][: 1 if keep else 2]
        want = [(i, *p) for i, t in enumerate(texts) for p in ch.plain_windows_of(t, most=50, overlap=5)]
        assert [(r["doc_id"], *[r[c] for c in ("chunk_index", "content", "token_count", "start_token", "end_token")]) for b in batches for r in b.to_pylist()] == want
        assert out.count() == len(want)


def test_rows_of_pages_go_on_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(hr, "HELD", 1000)
    pages = [f"<h1>t{i}</h1>" + "".join(f'<p class="T" id="p{k}">text {k}</p>' for k in range(10)) for i in range(200)] + [""]
    df = spark.createDataFrame(list(enumerate(pages)), "doc long, html string")
    out, run = swept(df, monkeypatch, lambda d: hr.html_rows(d, "doc", "html"))
    batches = list(run(iter([pa.record_batch({"doc": pa.array(range(len(pages))), "html": pa.array(pages)})])))
    assert len(batches) > 20 and max(b.num_rows for b in batches) <= 11 * 4
    assert sum(b.num_rows for b in batches) == out.count() == 200 * 11


def test_folds_are_sweeps(spark):
    """A document's rows are folded in a sorted sweep, whatever batch they lie in; there is no call of pandas for each document."""
    pages = spark.createDataFrame([(i, "<p>a</p>" * (3000 if i == 1 else i % 3)) for i in range(50)] + [(None, "<p>none</p>")], "doc long, html string")
    found = hr.group_sections(hr.html_rows(pages, "doc", "html"), 0)
    chunks = ch.semantic_chunks(found, most=50, overlap=0)
    assert "InPandas" not in chunks._jdf.queryExecution().toString()
    got = {r.doc: r.content for r in found.collect()}
    assert got == {i: "\n".join("a" * (3000 if i == 1 else i % 3)) for i in range(50) if i == 1 or i % 3} | {None: "none"}
    assert {r.doc: r.content for r in chunks.collect()} == {None if k is None else str(k): v for k, v in got.items()}


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, '<p id="p1">a b</p>')], "doc int, html string")
    contents = spark.createDataFrame([(1, 0, "p1", "p1", "C", "u", 0)], "doc int, pos int, np string, npe string, caption string, unit string, lvl int")
    placed = jobs.placed_paragraphs(hr.html_rows(pages, "doc", "html"), contents)
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r.text, r.links) for r in placed.collect()] == [("a b", None)]


def test_structure_is_parsed_once(spark, tmp_path):
    """Where there is a checkpoint folder, what follows the parser reads its rows from there."""
    pages = spark.createDataFrame([(i, f"<title>T{i}</title><h1>A</h1><p>one</p><h2>B</h2><p>two</p>") for i in range(5)], "doc int, html string")
    before = sorted(jobs.structure_chunks(pages).drop("tags").collect())
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    out = jobs.structure_chunks(pages)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and len(list(tmp_path.glob("*/rdd-*"))) == 2  # the cut of sections alone
    assert sorted(out.drop("tags").collect()) == before and len(before) == 10
