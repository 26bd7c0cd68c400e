"""The outline job: what goes through, what is left out and why; rules of the chunkers that a literal fails without."""

from pyspark.sql import functions as F

from docpipe.operators import chunking as ch
from docpipe.operators import html_rows as hr
from docpipe.plans import jobs

CONTENTS = "doc int, pos int, np string, npe string, caption string, unit string, lvl int"
PAGE = (
    '<div id="text"><p id="p1">Chapter <span class="mark">(as of <b>then</b>)</span>one.</p><p class="F" id="p9">noise</p><p id="p2">x<span class="W9">2</span> and more<label>label</label></p>'
    '<p id="p3">deep</p><p class="A">gone <span>too</span></p></div>'
)


def run(spark, contents, **kw):
    pages = spark.createDataFrame([(d, PAGE) for d in (1, 2, 3)], "doc int, html string")
    heads = spark.createDataFrame([(d, "law") for d in (1, 2, 3)], "doc int, kind string")
    c = spark.createDataFrame(contents, CONTENTS)
    got = jobs.page_outline_chunks(pages, c, heads, most=30, overlap=3, **kw).orderBy("doc", "idx").collect()
    out = jobs.outline_rejects(hr.html_rows(pages, "doc", "html", root_id=kw.get("root_id"), drop=True), c).orderBy("doc", "reason", "detail").collect()
    return [(r.doc, r.idx, r.path, r.content) for r in got], [tuple(r) for r in out]


def test_failed_documents_and_rejected_nodes(spark):
    contents = [(1, 0, "p1", "p3", "Whole", "u", 0), (2, 0, "p1", "p3", "Whole", "u", 0), (2, 1, "p2", "x2", "Part", "u", 1), (2, 2, None, "p3", "Other", "u", 1), (3, 0, "p1", "p2", "Nine", "u", 9), (3, 1, "p3", "p3", "Ten", "u", 10)]
    got, out = run(spark, contents)
    assert got == [(1, 0, "Whole", "Chapter one."), (1, 1, "Whole->", "x^2 and more"), (1, 2, "Whole->", "deep"), (3, 0, "Nine", "Chapter one.")]
    assert out == [(2, "unreadable contents row", "p2:x2"), (3, "level too deep", "2:2:10"), (3, "level too deep", "3:3:10")]
    got, out = run(spark, contents[:1], root_id="none")
    assert got == [] and {r[:2] for r in out} == {(1, "no root element"), (2, "no root element"), (3, "no root element")}


def test_noise_and_converter(spark):
    contents = [(1, 0, "p1", "p3", "Whole", "u", 0)]
    got, _ = run(spark, contents, converter=str.upper)
    assert [r[3] for r in got if r[0] == 1] == ["CHAPTER ONE.", "X^2 AND MORE", "DEEP"]
    kept, _ = run(spark, contents, drop=False)
    assert any(r[3] == "noise" for r in kept) and any("label" in r[3] for r in kept)


def test_all_documents_fail(spark):
    got, out = run(spark, [(d, 0, "1", "2", "c", "u", 0) for d in (1, 2, 3)])
    assert got == [] and [r[:2] for r in out] == [(d, "unreadable contents row") for d in (1, 2, 3)]


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_plain_windows_back_up(spark):
    """The cut lies before the token that ends a clause, not past half the window and not behind an abbreviation; the next window
    begins overlap tokens before it."""
    cut = lambda text, overlap=0: [(c[1], c[3], c[4]) for c in ch.plain_windows_of(text, most=20, overlap=overlap)]
    text = words(8) + "; " + words(10, 8)  # the mark is token 15
    assert cut(text)[0] == (words(8), 0, 15) and cut(text)[1][0].startswith("; w8")
    assert cut(text, 4)[1][1] == 11
    early = words(3) + "; " + words(20, 3)  # the mark is before half
    assert cut(early)[0][2] == 20
    short = words(7) + " т.д. " + words(10, 8)
    assert cut(short)[0][2] != 17 and "".join(c for c, _, _ in cut(short)) == short
    assert cut(words(30))[0][2] == 20 and ch.plain_windows_of("", most=20) == ch.plain_windows_of(None, most=20) == []


def test_char_windows_to_a_blank_line():
    """Without a sentence end ahead, a window goes on to the next blank line; without either it is cut."""
    text = "a" * 12 + "\n\n" + "b" * 12 + "\n\n" + "c" * 5
    assert ch.char_windows_of(text, 10, 0) == [("a" * 12, False), ("b" * 12, True), ("c" * 5, True)]
    assert ch.char_windows_of(text, 10, 0, blank_line=False)[0] == ("a" * 10, False)
    assert ch.char_windows_of("a" * 12 + ". b\n\nc", 10, 0)[0] == ("a" * 12 + ".", False)  # a sentence end comes first


def test_semantic_overlap_is_chained(spark):
    """A chunk is led by the last tokens of the one before with its own lead; the last chunk has none."""
    bodies = ["a1 a2 a3", "b", "c", "d1 d2 d3"]
    rows = [("x", i, "", b, "Paragraph") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "doc string, section_index int, heading string, content string, section_type string")
    got = [(r.content, r.total_chunks) for r in ch.semantic_chunks(df, most=50, overlap=3).orderBy("chunk_index").collect()]
    assert [c for c, _ in got] == ["a1 a2 a3", "a2 a3b", "a2 a3bc", "d1 d2 d3"]  # "c" is led by the lead of "b" too
    assert {n for _, n in got} == {4}
    assert [r.content for r in ch.semantic_chunks(df, most=50, overlap=0).orderBy("chunk_index").collect()] == bodies


def test_packing_sums():
    """Sizes are those of the joined text at every step, seeds included."""
    for sep in ("\n\n", "\n"):
        for size, overlap in ((12, 0), (12, 5), (30, 11), (5, 100)):
            for text in (sep.join("x" * (1 + i * 7 % 9) for i in range(25)), sep.join(["a", "", " b ", "c" * 40, "d"])):
                for c, _ in ch.pack_paragraphs_of(text, size, overlap, sep):
                    assert c
                plain = [c for c, o in ch.pack_paragraphs_of(text, size, 0, sep)]
                assert overlap or all(len(c) <= size for c in plain if sep in c.strip())


def test_outline_chunks_keep_headers(spark):
    pages = spark.createDataFrame([(1, '<p id="p1">a b</p>'), (2, None)], "doc int, html string")
    c = spark.createDataFrame([(1, 0, "p1", "p1", "C", "u", 0)], CONTENTS)
    heads = spark.createDataFrame([(1, "law"), (2, "act")], "doc int, kind string").withColumn("more", F.lit(1))
    got = jobs.page_outline_chunks(pages, c, heads).collect()
    assert [(r.doc, r.content, r.kind, r.more) for r in got] == [(1, "a b", "law", 1)]
