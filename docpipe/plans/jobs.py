"""Whole jobs made of the operators: pages to outline chunks, pages to section chunks, sections to points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpipe.functions.text import embedding_text
from docpipe.operators import chunking as ch
from docpipe.operators import html_rows as hr
from docpipe.operators import outline as ol
from docpipe.operators import page_structure as ps
from docpipe.operators.search import to_points
from docpipe.operators.vectors import checked_size, encode


def placed_paragraphs(blocks: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc, seq, st, en, lvl, caption, unit, text, links): numbered paragraphs of documents whose contents can be read, in their outline."""
    failed = ol.failed_documents(contents).select("doc")
    paragraphs = hr.numbered_paragraphs(blocks).join(failed, "doc", "left_anti")
    return ol.attach_outline(paragraphs, ol.toc_intervals(contents), ["links"])


def outline_nodes(blocks: DataFrame, contents: DataFrame, levels: int = ol.MAX_LEVELS) -> DataFrame:
    """(doc, idx, st, en, lvl, caption, unit, text, links): what is placed, numbered in order. What is left out is in outline_rejects."""
    placed = ol.cap_levels(placed_paragraphs(blocks, contents), levels)
    return placed.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("seq")) - 1).drop("seq")


def outline_rejects(blocks: DataFrame, contents: DataFrame, levels: int = ol.MAX_LEVELS) -> DataFrame:
    """(doc, reason, detail): what the outline job leaves out. A contents row that can't be read fails its document, a node that lies
    too deep goes alone, a page without the asked root has no paragraphs."""
    rootless = blocks.where("not found_root").select("doc", F.lit("no root element").alias("reason"), F.lit("").alias("detail"))
    return ol.failed_documents(contents).unionByName(ol.too_deep(placed_paragraphs(blocks, contents), levels)).unionByName(rootless)


def assemble_chunks(nodes: DataFrame, headers: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row per node and chunk of its text: cut's columns, the path of captions, and the document's header columns."""
    rows = ol.with_chains(nodes).where("text is not null").drop("parent", "ancestors")
    return ol.with_header(cut(rows), headers)


def page_outline_chunks(
    pages: DataFrame, contents: DataFrame, headers: DataFrame, most: int = 8192, overlap: int | None = None, root_id: str | None = None, tokenizer: Callable = ch.regex_tokens,
    drop: bool = True, converter: Callable[[str], str] | None = None,
) -> DataFrame:
    """Pages (doc, html) and their contents rows to token chunks with path, links and header. drop: noise goes with all it holds;
    converter: what a paragraph's clean text becomes. See outline_rejects for what is left out."""
    nodes = outline_nodes(hr.html_rows(pages, "doc", "html", root_id=root_id, drop=drop, converter=converter), contents)
    return assemble_chunks(nodes, headers, lambda rows: ch.token_windows(rows, "text", tokenizer, most, overlap))


def page_section_chunks(pages: DataFrame, semantic: bool = True, most: int = 512, overlap: int = 50, tokenizer: Callable = ch.regex_tokens) -> DataFrame:
    """Pages (doc, html) to chunks (doc, chunk_index, content, token_count, tags, total_chunks, meta): sections joined up to the
    budget, or plain windows over the page's text; meta holds what the page says of itself."""
    blocks = hr.html_rows(pages, "doc", "html")
    if semantic:
        chunks = ch.semantic_chunks(hr.group_sections(blocks).withColumn("doc", F.col("doc").cast("string")), tokenizer, most, overlap)
    else:
        text = hr.plain_text(blocks).select(F.col("doc").cast("string").alias("doc"), "text")
        cut = ch.plain_windows(text, "text", tokenizer, most, overlap)
        total = F.count("*").over(Window.partitionBy("doc"))
        chunks = cut.select("doc", "chunk_index", "content", "token_count", F.array(F.lit("legal_document")).alias("tags"), total.cast("int").alias("total_chunks"))
    meta = hr.doc_metadata(blocks).select(F.col("doc").cast("string").alias("doc"), "meta")
    return chunks.join(meta, "doc", "left")


def section_points(sections: DataFrame, dim: int = 64, encoder=None, by_paragraphs: bool = True, size: int = 512, overlap: int = 50, separator: str = "\n\n", batch_size: int = 256) -> DataFrame:
    """Sections (uri, title, section_index, article, content) to points: packed or windowed, led by title and article, encoded,
    checked for their size, with an id made of uri and chunk_index."""
    chunks = ch.chunk_sections(sections, by_paragraphs, size, overlap, separator)
    led = chunks.withColumn("embedding_text", embedding_text(F.col("title"), F.col("article"), F.col("content"))).withColumnRenamed("uri", "document_uri")
    return checked_size(encode(to_points(led), "embedding_text", encoder, batch_size), dim)


def _once(rows: DataFrame) -> DataFrame:
    """rows, made now and read from the checkpoint folder wherever they are used."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows


def structure_chunks(pages: DataFrame, tokens: int = ps.SECTION_TOKENS) -> DataFrame:
    """Pages (doc, html) to chunks of their sections with the path of headings, and the page's title and language. Pages are parsed once,
    their rows and then the sections stand in spark.checkpoint.dir; where that is unset, each use parses them again."""
    rows = _once(ps.structure_rows(pages, "doc", "html"))
    chunks = ps.section_chunks(_once(ps.sections(rows)), tokens)
    heads = ps.page_titles(rows).join(ps.page_metadata(rows).select("doc", "language", "tags", "reading_minutes"), "doc")
    return chunks.join(heads, "doc", "left")
