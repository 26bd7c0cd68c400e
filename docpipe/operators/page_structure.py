"""General web pages to sections, titles, metadata, tables, code and section chunks.

One parser pass in Arrow batches gives rows in page order; everything after it is DataFrame code. A row's kind says what it is:

* ``start`` a heading h1 to h6 (text, level) or a section, article, div.section or div.chapter (level 0, no text); ``resume`` where
  the text of an outer one goes on behind an inner one, or of none. Both carry ``section``, the number of the one that now holds.
* ``text`` a run of text between block boundaries, blanks collapsed; ``code`` a pre element (name: its language);
* ``table`` where a table begins, with the lines of its cells that have text, ``cell`` a cell of it, placed by row and column under the
  row and column spans around it;
* ``title`` and ``meta`` (name in lower case, prop, text: content) of the head.

A heading holds up to the next one or to the end of the element it stands in, the others to their own end. Script, style and
template elements are nothing. A page is read by one task and its rows are grouped by page, so a page is what a task holds.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpipe.functions.text import words
from docpipe.operators.headings import heading_outline
from docpipe.operators.html_rows import BLOCKS, VOID

# What opens a level-0 section, what is no text, how tables and code are marked, the heading of a page without
# sections, words read in a minute, bytes a token has, tokens a chunk of a section holds.
SECTIONS, SECTION_CLASSES = ("section", "article"), ("section", "chapter")
ROWS = 256  # pages, or sections, that are held at once
NO_TEXT = ("script", "style", "template")
TABLE, CODE = ("[TABLE]\n", "\n[/TABLE]"), ("[CODE lang=", "]\n", "\n[/CODE]")
WHOLE_PAGE, WORDS_A_MINUTE, BYTES_A_TOKEN, SECTION_TOKENS = "Document", 200, 4, 2000
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # spans beyond these are cut, as browsers do
BREAKS = BLOCKS | frozenset(("li", "tr", "td", "th", "dt", "dd", "body", "html", "head", "title", "caption", "thead", "tbody", "tfoot", "figure", "figcaption"))
ROW = "seq int, kind string, section int, tag string, level int, name string, prop string, text string, tab int, outer int, row int, col int, rowspan int, colspan int"
FIELDS = [x.split() for x in ROW.split(", ")]


def _span(value: str | None, most: int) -> int:
    return max(1, min(most, int(value))) if value and value.strip().isdecimal() else 1


class _Table:
    def __init__(self, number: int, outer: int | None):
        self.number, self.outer, self.row, self.col = number, outer, -1, 0
        self.taken: dict[int, int] = {}  # column: rows, this one included, that a cell above reaches
        self.cell: dict | None = None
        self.head: dict = {}  # its row of kind table
        self.lines: dict[int, list[str]] = {}  # row: texts of its cells

    def next_row(self):
        self.row, self.col = self.row + 1, 0
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}

    def place(self, rows: int, cols: int) -> int:
        """The column of a new cell: the first that no cell from above reaches."""
        if self.row < 0:
            self.next_row()
        while self.col in self.taken:
            self.col += 1
        at = self.col
        self.taken |= {c: rows for c in range(at, at + cols)}
        self.col = at + cols
        return at


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[str] = []  # open elements
        self.silent = 0  # depth at which silence began, 0: none
        self.text: list[str] = []
        self.tables: list[_Table] = []
        self.n_tables = self.n_sections = 0
        self.scopes: list[tuple[dict, int]] = []  # sections that hold, outer ones first, and the depth that ends each
        self.head: dict | None = None  # the heading that is read now
        self.pre: dict | None = None
        self.title: list[str] | None = None

    def add(self, kind: str, **row):
        self.rows.append({"seq": len(self.rows), "kind": kind, **row})

    def flush(self):
        text, self.text = " ".join("".join(self.text).split()), []
        if text:
            self.add("text", text=text)

    def hold(self):
        self.add("resume", **(self.scopes[-1][0] if self.scopes else {}))

    def begin(self, tag: str, level: int, text: str, ends: int):
        self.n_sections += 1
        row = {"section": self.n_sections - 1, "tag": tag, "level": level, "text": text}
        self.scopes.append((row, ends))
        self.add("start", **row)

    def end_cell(self):
        t = self.tables[-1]
        if t.cell is not None:
            cell, t.cell = t.cell, None
            text = " ".join("".join(cell["text"]).split())
            self.add("cell", tab=t.number, outer=t.outer, **cell | {"text": text})
            if text:
                t.lines.setdefault(cell["row"], []).append(text)

    def closed(self, tag: str):
        """What the end of an element, whose depth is now gone, means."""
        depth = len(self.open) + 1
        if self.silent == depth:
            self.silent = 0
        if self.head is not None and self.head["depth"] == depth:
            h, self.head = self.head, None
            while self.scopes and self.scopes[-1][1] == depth - 1 and self.scopes[-1][0]["level"]:
                self.scopes.pop()  # an earlier heading of the same element
            self.begin(h["tag"], int(h["tag"][1]), " ".join("".join(h["text"]).split()), depth - 1)
        if self.pre is not None and self.pre["depth"] == depth:
            p, self.pre = self.pre, None
            self.add("code", name=p["lang"] or "text", text="".join(p["text"]).strip())
        if tag == "table" and self.tables and not self.silent:
            self.end_cell()
            t = self.tables.pop()
            t.head["text"] = "\n".join(" | ".join(x) for x in t.lines.values())
        if tag in ("td", "th", "tr") and self.tables and not self.silent:
            self.end_cell()
        if tag == "title" and self.title is not None:
            self.add("title", text=" ".join("".join(self.title).split()))
            self.title = None
        held = len(self.scopes)
        while self.scopes and self.scopes[-1][1] >= depth:
            self.scopes.pop()
        if len(self.scopes) != held:
            self.flush()
            self.hold()

    def pop_to(self, k: int):
        while len(self.open) > k:
            self.closed(self.open.pop())

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        classes = a.get("class", "").split()
        if tag == "meta" and not self.silent:
            if "content" in a:
                self.add("meta", name=a["name"].lower() if "name" in a else None, prop=a.get("property"), text=a["content"])
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.handle_data("\n" if tag == "br" else "")
            return
        if tag in BREAKS and self.pre is None:
            if self.cell() is not None:
                self.cell()["text"].append(" ")
            elif self.head is None and self.title is None:
                self.flush()
            last = len(self.open) - 1 - self.open[::-1].index("p") if "p" in self.open else -1
            if tag in BLOCKS and last >= 0 and not {"td", "th", "table"} & set(self.open[last:]):
                self.pop_to(last)
        if tag in ("tr", "td", "th") and self.tables:
            for inner in ("td", "th", "tr")[: 3 if tag == "tr" else 2]:  # left open before it, in this table
                base = len(self.open) - 1 - self.open[::-1].index("table") if "table" in self.open else 0
                if inner in self.open[base:]:
                    self.pop_to(base + self.open[base:].index(inner))
        self.open.append(tag)
        depth = len(self.open)
        if self.silent:
            return
        if tag in NO_TEXT:
            self.silent = depth
        elif tag == "title" and "svg" not in self.open:
            self.title = []
        elif tag == "table":
            self.n_tables += 1
            self.tables.append(_Table(self.n_tables - 1, self.tables[-1].number if self.tables else None))
            self.add("table", tab=self.n_tables - 1, outer=self.tables[-1].outer)
            self.tables[-1].head = self.rows[-1]
        elif tag == "tr" and self.tables:
            self.end_cell()
            self.tables[-1].next_row()
        elif tag in ("td", "th") and self.tables:
            t = self.tables[-1]
            self.end_cell()
            rows, cols = _span(a.get("rowspan"), MOST_ROWS), _span(a.get("colspan"), MOST_COLUMNS)
            col = t.place(rows, cols)
            t.cell = {"tag": tag, "row": t.row, "col": col, "rowspan": rows, "colspan": cols, "text": []}
        elif self.pre is not None:
            if tag == "code" and not self.pre["lang"]:
                self.pre["lang"] = self.language(classes)
        elif tag == "pre" and self.cell() is None:
            self.pre = {"depth": depth, "lang": self.language(classes), "text": []}
        elif self.cell() is None and self.head is None:
            if tag[0] == "h" and tag[1:] in tuple("123456"):
                self.head = {"tag": tag, "depth": depth, "text": []}
            elif tag in SECTIONS or tag == "div" and set(SECTION_CLASSES) & set(classes):
                self.begin(tag, 0, "", depth)

    @staticmethod
    def language(classes: list[str]) -> str:
        return next((c.removeprefix("language-") for c in classes if c.startswith("language-")), "")

    def cell(self) -> dict | None:
        return self.tables[-1].cell if self.tables else None

    def handle_endtag(self, tag):
        if tag in VOID or tag not in self.open:
            return
        k = len(self.open) - 1 - self.open[::-1].index(tag)
        if tag in ("tr", "td", "th", "p") and "table" in self.open[k + 1 :]:
            return  # of a table around this one, which is still open
        if tag in BREAKS:
            if self.cell() is not None:
                self.cell()["text"].append(" ")
            elif self.head is None and self.pre is None and self.title is None:
                self.flush()
        self.pop_to(k)

    def handle_data(self, data):
        if self.silent:
            return
        if self.title is not None:
            self.title.append(data)
        elif self.pre is not None:
            self.pre["text"].append(data)
        elif self.cell() is not None:
            self.cell()["text"].append(data)
        elif self.head is not None:
            self.head["text"].append(data)
        else:
            self.text.append(data)

    def ended(self) -> list[dict]:
        self.close()
        self.flush()
        self.pop_to(0)
        self.flush()
        return self.rows


def parse_structure(html: str | None) -> list[dict]:
    p = _Page()
    p.feed(html or "")
    return p.ended()


def structure_rows(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, seq, kind, ...) of each page in its order; a null or empty page gives no rows."""
    kinds = {"int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in FIELDS])

    def run(batches):
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for i, page in enumerate(b.column("html").to_pylist()):
                if rows := parse_structure(page):
                    made = pa.RecordBatch.from_pylist(rows, schema)
                    yield pa.record_batch([b.column("doc").take(pa.array([i] * len(rows))), *made.columns], names=["doc", *schema.names])

    return pages.select(F.col(doc).alias("doc"), F.col(html).alias("html")).mapInArrow(run, f"doc {pages.schema[doc].dataType.simpleString()}, {ROW}")


def _repeated(rows: DataFrame) -> DataFrame:
    """(_d, _t, body): the lines of each table with text, where a cell stands in every row and column that it spans."""
    over = lambda c, n: F.explode(F.sequence(F.col(c), F.col(c) + F.col(n) - 1))
    height = Window.partitionBy("doc", "tab")
    cells = rows.where("kind = 'cell'").withColumn("rowspan", F.least("rowspan", F.max("row").over(height) - F.col("row") + 1)).where("text <> ''")  # no row but the table's own
    cells = cells.withColumn("row", over("row", "rowspan")).withColumn("col", over("col", "colspan"))
    line = cells.groupBy("doc", "tab", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("x")).select("doc", "tab", "row", F.array_join("x.text", " | ").alias("line"))
    held = line.groupBy("doc", "tab").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("x"))
    return held.select(F.col("doc").alias("_d"), F.col("tab").alias("_t"), F.array_join("x.line", "\n").alias("body"))


def _marked(body: Column) -> Column:
    return F.concat(F.lit(TABLE[0]), F.coalesce(body, F.lit("")), F.lit(TABLE[1]))


def table_texts(rows: DataFrame, repeat: bool = False) -> DataFrame:
    """(doc, tab, outer, text): a line for each row with text, its cells parted by bars, cells without text left out. repeat: a cell
    stands in every row and column that it spans."""
    heads = rows.where("kind = 'table'")
    if not repeat:
        return heads.select("doc", "tab", "outer", _marked(F.col("text")).alias("text"))
    met = heads.select("doc", "tab", "outer").join(_repeated(rows), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("tab") == F.col("_t")), "left")
    return met.select("doc", "tab", "outer", _marked(F.col("body")).alias("text"))


def code_text(lang: Column, text: Column) -> Column:
    return F.concat(F.lit(CODE[0]), lang, F.lit(CODE[1]), text, F.lit(CODE[2]))


def flow(rows: DataFrame) -> DataFrame:
    """(doc, seq, kind, section, heading, level, tag, text): what a page shows in order, tables and code as marked text, each with the
    section that holds there (null: none)."""
    at = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    now = F.last(F.when(F.col("kind").isin("start", "resume"), F.struct("section", F.col("text").alias("heading"), "level", "tag")), True).over(at)
    shown = rows.where("kind in ('start', 'resume', 'text', 'code', 'table')").withColumn("now", now).where("kind in ('text', 'code', 'table')")
    text = F.when(F.col("kind") == "code", code_text(F.col("name"), F.col("text"))).when(F.col("kind") == "table", _marked(F.col("text"))).otherwise(F.col("text"))
    return shown.select("doc", "seq", "kind", "now.section", "now.heading", "now.level", "now.tag", text.alias("text"))


def sections(rows: DataFrame) -> DataFrame:
    """(doc, section_index, heading, level, tag, content, start_position, end_position) of sections with content; a page that has none
    is one section over all it shows. Positions are of the contents' UTF-8 bytes, one behind the other."""
    page = Window.partitionBy("doc")
    shown = flow(rows).withColumn("any", F.max(F.col("section").isNotNull()).over(page))
    whole = lambda c, other: F.when(F.col("any"), F.col(c)).otherwise(F.lit(other)).alias(c)
    held = shown.where("section is not null or not any").select("doc", "seq", whole("section", 0), whole("heading", WHOLE_PAGE), whole("level", 1), whole("tag", "body"), "text")
    joined = held.groupBy("doc", "section").agg(F.first("heading").alias("heading"), F.first("level").alias("level"), F.first("tag").alias("tag"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x"))
    out = joined.withColumn("content", F.array_join("x.text", "\n\n"))
    order = page.orderBy("section")
    end = F.sum(F.octet_length("content")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("section_index", F.row_number().over(order) - 1).withColumn("end_position", end)
    return out.select("doc", "section_index", "heading", "level", "tag", "content", (F.col("end_position") - F.octet_length("content")).alias("start_position"), "end_position")


def _trimmed(c: str) -> Column:
    return F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")


def page_titles(rows: DataFrame) -> DataFrame:
    """(doc, title): the first source with text of: the first title element, the first h1, the first og:title, the first
    twitter:title. Pages without rows have no row, those without a source a null title."""
    sources = [F.col("kind") == "title", (F.col("kind") == "start") & (F.col("tag") == "h1"), (F.col("kind") == "meta") & (F.col("prop") == "og:title"), (F.col("kind") == "meta") & (F.col("name") == "twitter:title")]
    firsts = rows.groupBy("doc").agg(*[F.min_by(F.when(s, _trimmed("text")), F.when(s, F.col("seq"))).alias(f"t{i}") for i, s in enumerate(sources)])
    return firsts.select("doc", F.coalesce(*[F.nullif(f"t{i}", F.lit("")) for i in range(len(sources))]).alias("title"))


def page_metadata(rows: DataFrame) -> DataFrame:
    """(doc, author, description, language, tags, categories, word_count, reading_minutes). author, description and language: the last
    meta of that name, else the first og: one; tags: keywords parted by commas and article:tag, categories: category, in page order."""
    meta = F.col("kind") == "meta"

    def last_or_first(name: str, prop: str, alias: str) -> Column:
        named, other = meta & (F.col("name") == name), meta & (F.col("prop") == prop)
        return F.coalesce(F.max_by(F.when(named, F.col("text")), F.when(named, F.col("seq"))), F.min_by(F.when(other, F.col("text")), F.when(other, F.col("seq")))).alias(alias)

    every = lambda at, value: F.collect_list(F.when(at, F.struct("seq", value)))
    split = F.filter(F.transform(F.split("text", ","), lambda x: F.trim(x)), lambda x: x != "")
    tags = F.when(F.col("name") == "keywords", split).otherwise(F.array("text"))
    found = rows.groupBy("doc").agg(
        last_or_first("author", "og:author", "author"), last_or_first("description", "og:description", "description"), last_or_first("language", "og:locale", "language"),
        every(meta & ((F.col("name") == "keywords") | (F.col("prop") == "article:tag")), tags.alias("v")).alias("tags"),
        every(meta & (F.col("name") == "category"), F.col("text").alias("v")).alias("categories"),
        F.sum(F.when(F.col("kind").isin("text", "code", "cell") | (F.col("kind") == "start"), F.size(words(F.coalesce("text", F.lit(""))))).otherwise(0)).alias("word_count"),
    )
    return found.select(
        "doc", "author", "description", "language", F.flatten(F.array_sort("tags")["v"]).alias("tags"), F.array_sort("categories")["v"].alias("categories"),
        "word_count", F.ceil(F.col("word_count") / WORDS_A_MINUTE).alias("reading_minutes"),
    )


def split_section_of(text: str, most: int) -> list[str]:
    """Paragraphs packed up to ``most`` UTF-8 bytes, the blank lines inside a chunk counted; a longer paragraph is a chunk by itself."""
    out, held, size = [], [], 0
    for p in text.split("\n\n"):
        n = len(p.encode())
        if size and size + n > most:
            out.append("\n\n".join(held))
            size = 0
        held, size = ([*held, p], size + 2 + n) if size else ([p], n)
    if size:
        out.append("\n\n".join(held))
    return out


def section_chunks(found: DataFrame, tokens: int = SECTION_TOKENS) -> DataFrame:
    """Sections (doc, section_index, heading, level, content) to chunks (id, doc, section_index, chunk_index, total_chunks, heading, path,
    hierarchy_level, content): each with the path of headings above it, long ones split between paragraphs."""
    outline = heading_outline(found.select("doc", F.col("section_index").alias("idx"), F.col("level").alias("lvl"), F.col("heading").alias("caption")))
    path = outline.select(F.col("doc").alias("_d"), F.col("idx").alias("_i"), "path", F.col("lvl").alias("hierarchy_level"))
    most = tokens * BYTES_A_TOKEN

    def cut(batches):
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            pieces = [split_section_of(t or "", most) for t in b.column("content").to_pylist()]
            at = pa.array([i for i, p in enumerate(pieces) for _ in p], pa.int64())
            kept = b.drop_columns(["content"]).take(at)
            made = {"chunk_index": pa.array([k for p in pieces for k in range(len(p))], pa.int32()), "total_chunks": pa.array([len(p) for p in pieces for _ in p], pa.int32()), "content": pa.array([x for p in pieces for x in p], pa.string())}
            yield pa.record_batch([*kept.columns, *made.values()], names=[*kept.schema.names, *made])

    given = found.select("doc", "section_index", "heading", "content")
    own = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in ("doc", "section_index", "heading"))
    pieces = given.mapInArrow(cut, f"{own}, chunk_index int, total_chunks int, content string")
    met = pieces.join(path, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("section_index") == F.col("_i")))
    name = F.concat(F.lit("section_"), F.col("section_index").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return met.select(name.alias("id"), "doc", "section_index", "chunk_index", "total_chunks", "heading", "path", "hierarchy_level", "content")
