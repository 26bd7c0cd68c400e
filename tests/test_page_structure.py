"""General web pages: tables, code, sections, titles, metadata and chunks on literal pages and against a plain reading of the given ones."""

import random

from pyspark.sql import functions as F

from docpipe.operators import page_structure as ps
from docpipe.plans import jobs


def rows_of(spark, *pages):
    return ps.structure_rows(spark.createDataFrame(list(enumerate(pages)), "page int, html string"), "page", "html")


def tables(spark, html, **kw):
    return [r.text.removeprefix("[TABLE]\n").removesuffix("\n[/TABLE]") for r in ps.table_texts(rows_of(spark, html), **kw).orderBy("tab").collect()]


NESTED = "<table><tr><td>a<td rowspan=2>b<table><tr><td>n1</td><td>n2</td></tr></table>rest<tr><th colspan='2'>c<tr><td>d</td></tr></table>"
RAGGED = "<table><thead><tr><th>h1</th><th> </th><th>h3</th></tr></thead><tbody><tr><td>x</td></tr><tr></tr><tr><td></td><td>y<br>z</td><td>w</td><td>v</td></tr></tbody></table>"


def test_tables(spark):
    assert tables(spark, NESTED) == ["a | b rest\nc\nd", "n1 | n2"]
    assert tables(spark, RAGGED) == ["h1 | h3\nx\ny z | w | v"]
    spans = "<table><tr><td rowspan=3>r</td><td colspan=2>c</td></tr><tr><td>1</td><td rowspan='9'>2</td></tr><tr><td>3</td></tr></table>"
    assert tables(spark, spans) == ["r | c\n1 | 2\n3"]
    assert tables(spark, spans, repeat=True) == ["r | c | c\nr | 1 | 2\nr | 3 | 2"]
    cells = {(r.row, r.col): r.text for r in rows_of(spark, spans).where("kind = 'cell'").collect()}
    assert cells == {(0, 0): "r", (0, 1): "c", (1, 1): "1", (1, 2): "2", (2, 1): "3"}
    assert tables(spark, "<table><tr><td rowspan=x colspan=-3>a</td><td colspan=99999999>b") == ["a | b"]
    assert tables(spark, "<table></table><td>no table</td>") == [""]
    assert tables(spark, "<table><tr><td>a<template><table><tr><td>x</table></template></table><table><tr><td>b</table>") == ["a", "b"]
    deep = "".join(f"<table><tr><td>{i}" for i in range(30))
    assert tables(spark, deep) == [str(i) for i in range(30)]
    outer = {r.tab: r.outer for r in ps.table_texts(rows_of(spark, deep)).collect()}
    assert outer == {i: i - 1 if i else None for i in range(30)}


def test_code(spark):
    html = "<pre class='x language-py'>if a &lt; b:\n  <b>c</b>\n</pre><pre><code class='language-rs'>fn</code></pre><pre> t </pre><p><code>inline</code>"
    got = [r.text for r in ps.flow(rows_of(spark, html)).orderBy("seq").collect()]
    assert got == ["[CODE lang=py]\nif a < b:\n  c\n[/CODE]", "[CODE lang=rs]\nfn\n[/CODE]", "[CODE lang=text]\nt\n[/CODE]", "inline"]


def found(spark, html):
    return [(r.heading, r.level, r.tag, r.content) for r in ps.sections(rows_of(spark, html)).orderBy("section_index").collect()]


def test_sections(spark):
    html = f"<body>before<h1>One</h1>x<p>p1<p>p2<h3>Deep <i>er</i></h3>{RAGGED}<section>s<h2>In</h2>in</section>back<div class='a chapter'>ch</div><h2>Empty</h2><h1>Last</h1>z</body>"
    assert found(spark, html) == [
        ("One", 1, "h1", "x\n\np1\n\np2"), ("Deep er", 3, "h3", "[TABLE]\nh1 | h3\nx\ny z | w | v\n[/TABLE]\n\nback"), ("", 0, "section", "s"), ("In", 2, "h2", "in"), ("", 0, "div", "ch"), ("Last", 1, "h1", "z"),
    ]
    assert found(spark, "<html><head><title>t</title></head><body>only <b>te</b>xt<p>more<h2>no content</h2><script>x</script>") == [("Document", 1, "body", "only text\n\nmore")]
    assert found(spark, "") == found(spark, "<script>a</script><style>b") == found(spark, "<h1>head only</h1>") == []
    assert found(spark, "<article><h2>A</h2>in</article>out<h2>B</h2>b") == [("A", 2, "h2", "in"), ("B", 2, "h2", "b")]
    both = ps.sections(rows_of(spark, "<h1>é</h1>éé<h1>b</h1>c", None, "<h1>x</h1>y")).orderBy("doc", "section_index").collect()
    assert [(r.doc, r.start_position, r.end_position) for r in both] == [(0, 0, 4), (0, 4, 5), (2, 0, 1)]


def test_titles_and_metadata(spark):
    meta = "<meta name=AUTHOR content=first><meta property='og:author' content=og><meta name=author content=last><meta property='og:locale' content=de><meta name=keywords content=' a, ,b c'><meta property='article:tag' content=' t '><meta name=category content=k1><meta name=category content=k2><meta name=description><meta charset=utf-8>"
    pages = [f"<title>  T &amp; t </title>{meta}<h1>H</h1>", f"<title> </title>{meta}<h1>H <b>h</b></h1>", "<h1> </h1><h1>second</h1><meta property='og:title' content=' og '>", "<meta name='Twitter:Title' content='tw'><p>x", "<p>none", None]
    got = {r.doc: r.title for r in ps.page_titles(rows_of(spark, *pages)).collect()}
    assert got == {0: "T & t", 1: "H h", 2: "og", 3: "tw", 4: None}
    r = ps.page_metadata(rows_of(spark, pages[0] + "<p>" + "w " * 400)).first()
    assert (r.author, r.description, r.language, r.tags, r.categories) == ("last", None, "de", ["a", "b c", " t "], ["k1", "k2"])
    assert (r.word_count, r.reading_minutes) == (401, 3)
    r = ps.page_metadata(rows_of(spark, "<meta property='og:author' content=x><meta property='og:author' content=y>")).first()
    assert (r.author, r.word_count, r.reading_minutes, r.tags) == ("x", 0, 0, [])


def test_split_section():
    assert ps.split_section_of("aa\n\nbb\n\ncccc\n\nd", 6) == ["aa\n\nbb", "cccc\n\nd"]
    assert ps.split_section_of("é" * 9 + "\n\na", 4) == ["é" * 9, "a"] and ps.split_section_of("", 4) == []
    rng = random.Random(3)
    for _ in range(200):
        text = "\n\n".join("x" * rng.randrange(0, 9) for _ in range(rng.randrange(1, 12)))
        out, now = [], ""
        for p in text.split("\n\n"):  # the rule, word by word
            if now and len(now) + len(p) > 10:
                out.append(now)
                now = ""
            now = f"{now}\n\n{p}" if now else p
        assert ps.split_section_of(text, 10) == out + [now] * bool(now)


def test_structure_job(spark):
    """The given pages: chunks joined are the sections, paths are heads from the outline, no chunk but single paragraphs is too long."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").alias("doc"), "html")
    rows = ps.structure_rows(pages, "doc", "html")
    want = {(r.doc, r.section_index): r for r in ps.sections(rows).collect()}
    got: dict = {}
    for r in jobs.structure_chunks(pages, tokens=100).orderBy("doc", "section_index", "chunk_index").collect():
        assert r.id == f"section_{r.section_index}_chunk_{r.chunk_index}" and r.path == r.heading.replace("$", "") and r.hierarchy_level == 0 and r.title
        assert len(r.content.encode()) <= 402 or "\n\n" not in r.content
        got.setdefault((r.doc, r.section_index), []).append(r)
    assert got.keys() == want.keys()
    for k, chunks in got.items():
        assert "\n\n".join(r.content for r in chunks) == want[k].content and all(r.total_chunks == len(chunks) for r in chunks)
    html = "<h1>A</h1>a<h3>B$</h3>b<h2>C</h2>c<h1>D</h1>d"
    out = jobs.structure_chunks(spark.createDataFrame([(1, html)], "doc int, html string")).orderBy("section_index").collect()
    assert [(r.path, r.hierarchy_level) for r in out] == [("A", 0), ("A->B", 1), ("A->C", 1), ("D", 0)]


def test_headings_cut_in_a_reference(spark):
    """A heading cut behind &quot or &amp: HTML reads both without their semicolon, also before a tag; &quo is text."""
    assert found(spark, "<h1>x &amp y = &quot</h1>a<h2>&quo</h2>b") == [('x & y = "', 1, "h1", "a"), ("&quo", 2, "h2", "b")]


def test_titles_cut_in_a_reference(spark):
    """As for headings, in the title element and in an h1 that stands for it."""
    got = ps.page_titles(rows_of(spark, "<title>x &amp y = &quot</title>", "<title> </title><h1>x = &quot</h1>", "<title>&quo</title>")).orderBy("doc").collect()
    assert [r.title for r in got] == ['x & y = "', 'x = "', "&quo"]
