"""Pages to rows: one parser pass in Arrow batches gives a row per block; everything after it is DataFrame code."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import folded
from .records import carry_last, section_type, text_paragraphs

# What is noise, what the marks for upper and lower digits are, and the block elements that end a paragraph.
NOISE = (("span", "mark"), ("span", "markx"), ("p", "F"), ("p", "A"), ("label", None))
MARKS = {"w9": "^", "w8": "_"}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SCHEMA = "seq int, tag string, elem_id string, classes array<string>, text string, clean_text string, links array<string>"
ARROW = {"seq": pa.int32(), "tag": pa.string(), "elem_id": pa.string(), "classes": pa.list_(pa.string()), "text": pa.string(), "clean_text": pa.string(), "links": pa.list_(pa.string()), "found_root": pa.bool_()}
HELD = 1 << 20  # characters of pages whose rows are held at once


class _Rows(HTMLParser):
    """Block rows of one page: p and h1-h6 elements, script and style ignored, an open p closed by the next block."""

    def __init__(self, root_id: str | None, drop: bool):
        super().__init__(convert_charrefs=True)
        self.root_id, self.drop = root_id, drop
        self.rows, self.open, self.spans = [], None, []
        self.skipped, self.root_depth, self.depth, self.pending = 0, None if root_id else -1, 0, None

    def _noise(self, tag, classes):
        return self.drop and any(tag == t and (c is None or c in classes) for t, c in NOISE)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag in VOID:
            return
        if self.open is not None and tag in BLOCKS:
            self._close()
        self.depth += 1
        if self.root_id and self.root_depth is None and a.get("id") == self.root_id:
            self.root_depth = self.depth
        self.spans.append((tag, bool(self.skipped) or tag in ("script", "style") or self._noise(tag, classes)))
        self.skipped += self.spans[-1][1]
        if self.skipped or self.root_depth is None:
            return
        if tag == "p" or tag[0] == "h" and tag[1:] in tuple("123456"):
            self.open = {"tag": tag, "id": a.get("id"), "classes": classes, "text": [], "clean": [], "links": []}
        if self.open is not None and tag == "span":
            low = [c.lower() for c in classes]
            self.pending = "" if "mark" in low or "markx" in low else next((MARKS[c] for c in low if c in MARKS), None)
            head, blank, _ = a.get("cmdprm", "").partition(" ")
            if blank:
                self.open["links"].append(head.removeprefix("gohash="))

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if self.open is not None and tag == self.open["tag"]:
            self._close()
        if tag not in [t for t, _ in self.spans]:
            return
        while self.spans:
            t, s = self.spans.pop()
            self.depth -= 1
            self.skipped -= s
            if t == tag:
                break
        if self.root_depth is not None and 0 < self.root_depth and self.depth < self.root_depth:
            self.root_depth = 1 << 30

    def handle_data(self, data):
        if self.skipped or self.open is None:
            return
        self.open["text"].append(data)
        mark, self.pending = self.pending, None
        if mark != "":
            self.open["clean"].append((mark or "") + data.replace("\u00a0", " "))

    def _close(self):
        o, self.open, self.pending = self.open, None, None
        self.rows.append((len(self.rows), o["tag"], o["id"], o["classes"], "".join(o["text"]), "".join(o["clean"]), o["links"] or None))


def parse_page(html: str, root_id: str | None = None, drop: bool = False) -> list[tuple] | None:
    """Block rows; None when root_id is asked for and missing."""
    p = _Rows(root_id, drop)
    p.feed(html or "")
    p.close()
    if p.open is not None:
        p._close()
    return None if root_id and p.root_depth is None else p.rows


def html_rows(pages: DataFrame, doc: str, html: str, root_id: str | None = None, drop: bool = False, converter=None) -> DataFrame:
    """(doc, seq, tag, elem_id, classes, text, clean_text, links, found_root); a page without its root gives one row with found_root false.
    converter: a function of a block's clean text, run with the parser."""

    def run(batches):
        for b in batches:
            html, out, at, held = b.column("html"), [], [], 0
            for i in range(b.num_rows):
                page = html[i].as_py()
                rows = parse_page(page, root_id, drop)
                if rows is None:
                    out.append((0, None, None, None, None, None, None, False))
                for r in rows or []:
                    out.append((*r[:5], converter(r[5]) if converter else r[5], r[6], True))
                at += [i] * (len(out) - len(at))
                held += len(page)
                if held >= HELD or i == b.num_rows - 1:
                    cols = zip(*out, strict=True) if out else [[]] * len(ARROW)
                    yield pa.record_batch([b.column("doc").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, ARROW.values(), strict=True))], names=["doc", *ARROW])
                    out, at, held = [], [], 0

    kind = pages.schema[doc].dataType.simpleString()
    return pages.select(F.col(doc).alias("doc"), F.coalesce(html, F.lit("")).alias("html")).mapInArrow(run, f"doc {kind}, {SCHEMA}, found_root boolean")


def scrub_attributes(html: Column) -> Column:
    return F.regexp_replace(html, r'\s?class="edx?"', "")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def link_rows(blocks: DataFrame) -> DataFrame:
    return blocks.where("links is not null").select("doc", "seq", F.explode("links").alias("link_hash"))


def build_sections(blocks: DataFrame, article_prefix: str) -> DataFrame:
    """(doc, section_index, article, content): class-less non-blank paragraphs, each with the last heading that begins with the prefix."""
    is_head = F.array_contains("classes", "H") & F.startswith(F.col("text"), F.lit(article_prefix))
    with_article = carry_last(blocks, "doc", "seq", is_head, F.trim("text"), "article")
    body = with_article.where((F.col("tag") == "p") & (F.size("classes") == 0) & (F.trim(F.replace("text", F.lit("\u00a0"), F.lit(" "))) != ""))
    from pyspark.sql.window import Window

    return body.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("seq")) - 1).alias("section_index"), "article", F.replace("text", F.lit("\u00a0"), F.lit(" ")).alias("content"))


def titles(blocks: DataFrame) -> DataFrame:
    t = blocks.where(F.array_contains("classes", "T")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"))
    return t.select("doc", F.col("t.text").alias("titles"))


def doc_metadata(blocks: DataFrame) -> DataFrame:
    """(doc, meta map): law_number, date and title where found."""
    cls = lambda c: F.array_contains("classes", c)
    dated = F.col("text").contains("декабря") | F.col("text").contains("года")
    firsts = blocks.where("tag = 'p'").groupBy("doc").agg(
        F.min_by(F.when(cls("I") & F.col("text").contains("№") & F.col("text").contains("ФЗ"), F.col("text")), F.when(cls("I") & F.col("text").contains("№") & F.col("text").contains("ФЗ"), F.col("seq"))).alias("law_number"),
        F.min_by(F.when(cls("I") & dated, F.col("text")), F.when(cls("I") & dated, F.col("seq"))).alias("d1"),
        F.min_by(F.when(cls("T") & dated, F.col("text")), F.when(cls("T") & dated, F.col("seq"))).alias("d2"),
        F.array_sort(F.collect_list(F.when(cls("T"), F.struct("seq", "text")))).alias("t"),
    )
    pairs = F.array(F.struct(F.lit("law_number").alias("k"), F.col("law_number").alias("v")), F.struct(F.lit("date").alias("k"), F.coalesce("d1", "d2").alias("v")), F.struct(F.lit("title").alias("k"), F.get("t", F.lit(1))["text"].alias("v")))
    return firsts.select("doc", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("meta"))


def plain_text(blocks: DataFrame) -> DataFrame:
    """(doc, text): non-blank paragraphs joined by blank lines."""
    p = blocks.where((F.col("tag") == "p") & (F.trim("text") != "")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))).alias("x"))
    return p.select("doc", F.array_join("x.t", "\n\n").alias("text"))


def group_sections(blocks: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(doc, section_index, heading, level, content, section_type): classed elements begin sections once there is content; small ones of one kind are merged."""
    typed = blocks.select("doc", "seq", "text", section_type(F.col("classes")).alias("kind"))
    kind = typed.schema["doc"].dataType.simpleString()

    def fold(rows):
        got: list[list] = []
        now = ["", "", "Paragraph"]
        for _, text, kind in rows:
            text = (text or "").strip()
            if not text:
                continue
            if kind != "Paragraph":
                if now[1].strip():
                    got.append(now)
                    now = ["", "", kind]
                    if kind == "Header":
                        now[0] = text
                        continue
                    now[1] = text
                    continue
            now[1] = f"{now[1]}\n{text}" if now[1] else text
        if now[1].strip() or now[0]:
            got.append(now)
        merged: list[list] = []
        for s in got:
            if merged and len(s[1].encode()) < min_bytes and merged[-1][2] == s[2]:
                merged[-1][1] += "\n\n" + s[1]
            else:
                merged.append(s)
        return [(i, h, 1, c, k) for i, (h, c, k) in enumerate(merged)]

    made = {"section_index": pa.int32(), "heading": pa.string(), "level": pa.int32(), "content": pa.string(), "section_type": pa.string()}
    dealt = typed.repartition("doc").sortWithinPartitions("doc", "seq")
    return dealt.mapInArrow(folded(fold, made), f"doc {kind}, section_index int, heading string, level int, content string, section_type string")


def numbered_paragraphs(blocks: DataFrame) -> DataFrame:
    """Text paragraphs with an id p<N> as (doc, seq, pid, text, links)."""
    from .records import paragraph_number

    return text_paragraphs(blocks).withColumn("pid", paragraph_number(F.col("elem_id"))).where("pid is not null").select("doc", "seq", "pid", F.col("clean_text").alias("text"), "links")
