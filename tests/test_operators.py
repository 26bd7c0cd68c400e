"""Operators on small literal inputs."""

from pyspark.sql import functions as F

from docpipe.functions import text as tx
from docpipe.operators import chunking as ch
from docpipe.operators import html_rows as hr
from docpipe.operators import outline as ol
from docpipe.operators import records as rc
from docpipe.operators import search as se

TREE = [(1, 0, 0, 1000, 0, "Root"), (1, 1, 0, 100, 1, "A"), (1, 2, 200, 300, 1, "B"), (1, 3, 400, 500, 1, "C"), (1, 4, 10, 30, 2, "A1"),
        (1, 5, 40, 60, 2, "A2"), (1, 6, 70, 90, 2, "A3"), (1, 7, 12, 18, 3, "P1"), (1, 8, 20, 25, 3, "P2")]


def tree(spark, rows=TREE):
    return spark.createDataFrame(rows, "doc int, idx int, st int, en int, lvl int, caption string")


def test_outline(spark):
    n = tree(spark)
    up = {r.idx: r.parent for r in ol.parents(n).collect()}
    assert up == {0: None, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 4, 8: 4}
    assert {r.idx: r.path for r in ol.paths(n).collect()}[8] == "Root->A->A1->P2"
    assert sorted(r.anc_idx for r in ol.ancestors(n).where("idx = 8").collect()) == [0, 1, 4]
    s = ol.stats(n).first()
    assert (s.total_nodes, list(s.by_level[:4]), s.nodes_with_children, s.total_children, s.max_children) == (9, [1, 3, 3, 2], 3, 8, 3)
    assert ol.validate(n).first().is_valid


def test_outline_odd_cases(spark):
    n = tree(spark, [(1, 0, 0, 10, 1, "a"), (1, 1, 2, 5, 1, "b"), (1, 2, 90, 210, 2, "c"), (1, 3, 1, 1, 10, "deep")])
    assert [tuple(r) for r in ol.overlaps(n).collect()] == [(1, 1, 0, 1)]
    assert ol.overlaps(n, symmetric=False).count() == 0
    assert ol.parents(n).where("idx = 2").first().parent is None
    assert ol.cap_levels(n).count() == 3


def test_word_windows(spark):
    for n, want in ((3, 1), (4, 1), (5, 2), (7, 2), (8, 3)):
        d = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "t string")
        got = [r.content for r in ch.word_windows(d, "t", 4, 1).orderBy("chunk_index").collect()]
        assert len(got) == want and got[-1].endswith(f"w{n - 1}")


def test_token_windows():
    text = "word " * 12 + "end. " + "more " * 30
    got = ch.token_windows_of(text, most=30, overlap=3)
    assert got[0][1].endswith("end. ") and got[-1][4] == len(ch.regex_tokens(text))
    assert all(b[3] == a[4] - 3 for a, b in zip(got, got[1:]))
    assert ch.token_windows_of("", most=30, overlap=3) == []
    assert not ch.token_windows_of("word " * 12 + "Dr. " + "more " * 30, most=30, overlap=3)[0][1].endswith("Dr. ")


def test_packing():
    assert [c for c, _ in ch.pack_paragraphs_of("a\n\nb\n\n" + "c" * 9, 10)] == ["a\n\nb", "c" * 9]
    long = "One two three. Four five six. Seven eight nine."
    assert all(c.endswith(".") for c, o in ch.pack_paragraphs_of(long, 10) if not o)
    assert ch.pack_paragraphs_of("", 10) == [] and ch.char_windows_of("") == []
    assert "".join(c for c, _ in ch.char_windows_of("x" * 95, 10, 0, emit_tail=False)) == "x" * 95


def test_parser():
    one = lambda h, **k: hr.parse_page(h, **k)[0]
    assert one('<p id="p5">item 11<span class="W9">3</span> x&nbsp;y</p>')[5] == "item 11^3 x y"
    assert one("<p>H<span class='W8'>2</span>O</p>")[5] == "H_2O"
    assert one('<p>a<span class="mark">note</span>b</p>')[5] == "ab"
    nested = '<p>a<span class="markx">n <span class="cmd">z</span></span>b</p>'
    assert one(nested, drop=True)[5] == "ab" and one(nested)[5] == "azb"
    assert one('<p><span cmdprm="gohash=abc goparaid=0">L</span></p>')[6] == ["abc"]
    assert one('<p><span cmdprm="gohash=abc">L</span></p>')[6] is None
    assert hr.parse_page("<p>x</p>", root_id="text_content") is None
    assert [r[1] for r in hr.parse_page("<p>a<p>b<script>'</p>'</script><h2>c</h2>")] == ["p", "p", "h2"]


def test_records(spark):
    d = spark.createDataFrame([("153. на 01.03.2025 (№ 171-ФЗ от 08.07.2024), с изменениями",), ("2. * на 01.03.2025 (№ 171-ФЗ)",), ("актуальная",)], "c string")
    got = [(r.source_number, str(r.source_date)) for r in rc.with_caption_source(d, "c").collect()]
    assert got == [("171-ФЗ", "2024-07-08"), ("171-ФЗ", "None"), (None, "None")]
    e = spark.createDataFrame([("37,102162745", "37 - от 03.07.2016 № 306-ФЗ (изм.)"), ("n", "38 - от 03.07.2016 № 313-ФЗ (изм.)(x)")], "value string, text string")
    got = [(r.edition_id, r.is_ready, str(r.edition_date), r.number, r.comment) for r in rc.parse_editions(e).collect()]
    assert got == [(37, True, "2016-07-03", "306-ФЗ", "изм."), (None, False, "2016-07-03", "313-ФЗ", "изм.")]


def test_search(spark):
    s = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.5)], "query_id int, id string, score double")
    k = spark.createDataFrame([(1, "y", 1.0), (1, "z", 1.0)], "query_id int, id string, score double")
    assert [(r.id, round(r.score, 2)) for r in se.combine(s, k, 0.7, 0.3, 2).orderBy("rank").collect()] == [("y", 0.65), ("x", 0.63)]
    q = spark.createDataFrame([("и в (закон) на об x1",)], "q string")
    assert q.select(tx.keywords(F.col("q"))).first()[0] == ["закон", "об"]
    p = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, document_uri int")
    left, gone = se.delete_documents(p, spark.createDataFrame([(1,)], "document_uri int"))
    assert [r.id for r in left.collect()] == ["c"] and gone.first().deleted == 2
    assert se.upsert(se.upsert(p, p), p).count() == 3


def test_queries_and_oracles_agree_on_names():
    from docpipe.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_ingest(spark, tmp_path):
    from docpipe.streaming.ingest import current, ingest

    src = tmp_path / "in"
    d = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    d.write.parquet(str(src))
    for _ in range(2):
        ingest(spark, str(src), d.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    table = str(tmp_path / "out")
    assert current(spark, table).count() == 2
    more = spark.createDataFrame([(2, "changed text"), (3, "new")], "doc_id long, text string")
    more.write.mode("append").parquet(str(src))
    ingest(spark, str(src), d.schema, table, str(tmp_path / "cp")).awaitTermination()
    got = {r.document_uri: r.content for r in current(spark, table).collect()}
    assert got == {"1": "a b c", "2": "changed text", "3": "new"}


def test_token_cut():
    """F8: marks in the last fifth, the range that is looked at, commas, abbreviations, words, hard cuts; total_chunks of each text."""
    cut = lambda text, most=30: [c[1] for c in ch.token_windows_of(text, most=most, overlap=3)]
    assert cut("a b c")[0] == "a b c" and len(cut("a b c")) == 1
    assert cut("w " * 13 + "x, " + "y " * 20)[0] == "w " * 13 + "x, "
    assert cut("w " * 11 + "etc. " + "y " * 20)[0] == "w " * 11 + "etc. y y "
    assert cut("w " * 11 + "end. " + "y " * 20)[0] == "w " * 11 + "end. "
    assert cut("w" + "-" * 80)[0] == "w" + "-" * 29
    assert cut("one two " * 40)[0].endswith(" ")
    assert {c[5] for c in ch.token_windows_of("w " * 50, most=30, overlap=3)} == {4}


def test_token_windows_columns(spark):
    """total_chunks is each row's own, whatever other columns there are."""
    d = spark.createDataFrame([("en", 1, "a b c d " * 10), ("en", 2, "x y"), ("fr", 3, None)], "lang string, doc_id int, text string")
    got = {r.doc_id: r.total_chunks for r in ch.token_windows(d, "text", most=30, overlap=3).collect()}
    assert got == {1: 3, 2: 1}
    assert ch.token_windows(d.select("text"), "text", most=30, overlap=3).count() == 4


def test_packing_cases():
    """sections under the budget, a long paragraph, overlap rows, nothing, characters and not bytes."""
    assert len(ch.pack_paragraphs_of("a" * 1616, 2000, 100)) == 1 and len(ch.pack_paragraphs_of("é" * 1616, 2000, 100)) == 1
    ten = "\n\n".join("p" * 200 for _ in range(10))
    got = ch.pack_paragraphs_of(ten, 512, 50)
    assert all(c for c, _ in got) and any(o for _, o in got) and [c for c, o in got if o] == ["p" * 200] * sum(o for _, o in got)
    assert [c for c, _ in ch.char_windows_of("One. Two two. Three", 6, 0, emit_tail=False)] == ["One. Two two.", "Three"]
    assert ch.char_windows_of("ab. cd. ef", 4, 2)[1][1]


def test_sections(spark):
    s = spark.createDataFrame([("u", 0, "a" * 30), ("u", 1, "b" * 20), ("v", 0, "")], "uri string, section_index int, content string")
    got = [(r.uri, r.chunk_index, r.total_chunks, r.char_count) for r in ch.chunk_sections(s, size=40, overlap=0).orderBy("uri", "chunk_index").collect()]
    assert got == [("u", 0, 2, 30), ("u", 1, 2, 20)]
    m = spark.createDataFrame([("d", 0, "H", "one two", "Header"), ("d", 1, "", "three", "Citation"), ("d", 2, "", "four", "Header")], "doc string, section_index int, heading string, content string, section_type string")
    got = [(r.content, r.tags, r.total_chunks) for r in ch.semantic_chunks(m, most=50, overlap=2).orderBy("chunk_index").collect()]
    assert got == [("H\none two\n\nthree", ["legal_document", "Header", "Citation"], 2), ("four", ["legal_document", "Header"], 2)]


def test_plain_windows():
    got = ch.plain_windows_of("word " * 8 + "end; " + "more " * 20, most=24, overlap=4)
    assert got[0][3] == 0 and got[-1][4] == len(ch.regex_tokens("word " * 8 + "end; " + "more " * 20)) and all(a[4] - b[3] in (0, 4) for a, b in zip(got, got[1:]))
    assert ch.plain_windows_of("") == []


def test_knn_odd_vectors(spark):
    kind = "id int, embedding array<double>"
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.5, 0.5]), (7, [])], kind)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, None), (4, [0.0, 0.0])], "query_id int, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.id, round(r.score, 3)) for r in se.knn(p, q, 5).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 6, 0.707), (2, 1, 4, 1.0)]
    assert sorted((r.query_id, r.id) for r in se.knn(p, q, 1, "dot").collect()) == [(1, 1), (2, 4), (4, 1)]


def test_keyword_search(spark, monkeypatch):
    p = spark.createDataFrame([(1, "the lawyer's law"), (2, "an outlaw"), (3, ""), (4, None), (5, "закон о праве")], "id int, text string")
    q = spark.createDataFrame([(1, "law law lawyer"), (2, "закон!"), (3, "и")], "query_id int, text string")
    want = [(1, 1, 1, 1.0), (1, 2, 2, 0.667), (2, 1, 5, 1.0)]
    for most in (200_000, 1):
        monkeypatch.setattr(se, "KEYWORDS", most)
        assert sorted((r.query_id, r.rank, r.id, round(r.score, 3)) for r in se.keyword_search(p, q, 5).collect()) == want


def test_landed(spark, tmp_path):
    import json

    import pytest

    from docpipe.sources import landed

    def land(name, *rows):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
        return str(tmp_path / name)

    card = {"docid": 1, "docnames": "n", "docdescription": "", "docpass0date": "20240708", "docpass0number": "171", "dochash": "h", "publications": ["x"]}
    got = landed.read_cards(spark, land("cards", {"docs": [card, card], "docscount": 2, "error": ""})).collect()
    assert len(got) == 2 and got[0].description is None and str(got[0].sign_date) == "2024-07-08"
    assert landed.read_cards(spark, land("none", {"docs": [], "docscount": 0})).count() == 0
    with pytest.raises(Exception, match="holds an error"):
        landed.read_cards(spark, land("bad", {"docs": [card], "error": "down"})).collect()
    red = {"dochash": "h", "redactions": [{"redid": 7, "redcaption": "153. на 01.03.2025 (№ 171-ФЗ от 08.07.2024), с", "redreason": "", "actual": True}, {"redid": 8, "redcaption": "актуальная"}]}
    rows = landed.read_redactions(spark, land("red", red)).orderBy("pos").collect()
    assert [(r.redid, r.source_number, str(r.source_date), r.redreason) for r in rows] == [(7, "171-ФЗ", "2024-07-08", None), (8, None, "None", None)]
    with pytest.raises(Exception, match="no redactions of h"):
        landed.read_redactions(spark, land("nored", {"dochash": "h", "redactions": []})).collect()
    one = json.dumps({"data": [{"id": "a", "np": "p6", "npe": "p117", "caption": "c", "unit": "u", "lvl": 0}], "error": None})
    c = landed.contents_rows(spark.createDataFrame([(1, one)], "doc int, j string"), "j", "doc").collect()
    assert [(r.doc, r.pos, r.np, r.npe, r.lvl) for r in c] == [(1, 0, "p6", "p117", 0)]
    good, bad = landed.read_texts(spark, land("texts", {"redtext": "<p>x</p>", "error": ""}, {"redtext": None, "error": "gone"}))
    assert [r.html for r in good.collect()] == ["<p>x</p>"] and bad.count() == 1
    (tmp_path / "enc").mkdir()
    (tmp_path / "enc" / "p.html").write_bytes("<p>Закон</p>".encode("windows-1251"))
    assert landed.read_encoded_pages(spark, str(tmp_path / "enc")).first().html == "<p>Закон</p>"
    page = '<select name="doc_editions"><option value="37,1">37 - от 03.07.2016 № 306-ФЗ (изм.)</option><option selected value="n"> 38 </option></select>'
    assert [(r.value, r.text) for r in landed.edition_options(spark.createDataFrame([(page,)], "html string")).collect()] == [("37,1", "37 - от 03.07.2016 № 306-ФЗ (изм.)"), ("n", "38")]
    table = str(tmp_path / "points")
    assert landed.ensure_table(spark, table, 8) and not landed.ensure_table(spark, table, 8)
    assert landed.vector_spec(spark.read.parquet(table)) == {"dim": 8, "metric": "cosine"}


def test_store_chunks(spark, tmp_path):
    import pytest

    from docpipe.sources import landed

    c = spark.createDataFrame([("u", 0, "a b"), ("u", 1, None)], "document_uri string, chunk_index int, embedding_text string")
    got = landed.store_chunks(c, str(tmp_path / "a"), 64, batch_size=1)
    assert {(r.document_uri, r.chunk_index) for r in got.collect()} == {("u", 0), ("u", 1)} and got.select("id").distinct().count() == 2
    with pytest.raises(Exception, match="a vector of 8 components"):
        landed.store_chunks(c, str(tmp_path / "b"), 8)


def test_jobs(spark):
    from docpipe.plans import jobs

    html = '<p id="p1">Chapter one.</p><p id="p2">A b c<span cmdprm="gohash=abc goparaid=0">L</span></p><p class="I" id="p3">signed</p><p id="p4">Last words.</p>'
    pages = spark.createDataFrame([(1, html)], "doc int, html string")
    contents = spark.createDataFrame([(1, 0, "p1", "p4", "Whole", "u", 0), (1, 1, "p2", "p2", "$Part", "u", 1)], "doc int, pos int, np string, npe string, caption string, unit string, lvl int")
    head = spark.createDataFrame([(1, "law")], "doc int, kind string")
    got = jobs.page_outline_chunks(pages, contents, head, most=30, overlap=3).orderBy("idx").collect()
    assert [(r.idx, r.path, r.content, r.kind, r.links) for r in got] == [
        (0, "Whole", "Chapter one.", "law", None), (1, "Whole->Part", "A b cL", "law", ["abc"]), (2, "", "Last words.", "law", None)
    ]
    got = jobs.page_section_chunks(pages, most=50, overlap=0).collect()
    assert got and all(r.total_chunks == len(got) and r.tags[0] == "legal_document" for r in got)
    assert "".join(r.content for r in jobs.page_section_chunks(pages, semantic=False).collect()).startswith("Chapter one.")
    s = spark.createDataFrame([("u", ["T"], 0, "art", "x y\n\nz"), ("u", ["T"], 1, None, "w")], "uri string, title array<string>, section_index int, article string, content string")
    got = jobs.section_points(s, size=100, overlap=0).orderBy("chunk_index").collect()
    assert [(r.document_uri, r.chunk_index, r.embedding_text) for r in got] == [("u", 0, "Документ: T\nСтатья: art\nx y\n\nz"), ("u", 1, "Документ: T\nw")] and len(got[0].embedding) == 64


def test_parser_sections(spark):
    pages = spark.createDataFrame([(1, '<p class="T">Law</p><p class="T">On words</p><p class="I">от 3 декабря № 5-ФЗ</p><p class="H">Article 1</p><p>one\u00a0two</p><p class="H">Article 2</p><p>three</p>')], "doc int, html string")
    b = hr.html_rows(pages, "doc", "html")
    assert [(r.section_index, r.article, r.content) for r in hr.build_sections(b, "Article").orderBy("section_index").collect()] == [(0, "Article 1", "one two"), (1, "Article 2", "three")]
    assert hr.titles(b).first().titles == ["Law", "On words"]
    assert hr.doc_metadata(b).first().meta == {"law_number": "от 3 декабря № 5-ФЗ", "date": "от 3 декабря № 5-ФЗ", "title": "On words"}
    assert hr.plain_text(b).first().text.startswith("Law\n\nOn words")
    assert [r.section_type for r in hr.group_sections(b, 0).orderBy("section_index").collect()][:2] == ["Paragraph", "Title"]
