"""Text expressions: sizes, previews, templates, keyword extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, instructions and the stop words of keyword extraction.
TITLE_LABEL, ARTICLE_LABEL, NO_TITLE = "Документ: ", "Статья: ", "Без названия"
QUESTION_INSTRUCTION = "Represent this question for searching relevant passages: "
DOCUMENT_INSTRUCTION = "Represent this document for retrieval: "
QUESTION_WORDS = ("как", "почему")
STOP_WORDS = ("и", "в", "на", "с", "по", "для", "что", "это")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def words(c: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def preview(c: Column, n: int, mark: str = "...") -> Column:
    """The first n characters, marked if something is cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def char_slice(c: Column, start: int, end: int) -> Column:
    return F.substring(c, start + 1, max(0, end - start))


def embedding_text(titles: Column, article: Column, content: Column) -> Column:
    """Title line and article line, each where present, then the content."""
    head = F.when(F.size(titles) > 0, F.concat(F.lit(TITLE_LABEL), F.array_join(titles, " "), F.lit("\n"))).otherwise("")
    mid = F.when(article.isNotNull(), F.concat(F.lit(ARTICLE_LABEL), article, F.lit("\n"))).otherwise("")
    return F.concat(head, mid, content)


def with_instruction(text: Column) -> Column:
    asks = text.contains("?")
    for w in QUESTION_WORDS:
        asks = asks | text.contains(w)
    return F.concat(F.when(asks, F.lit(QUESTION_INSTRUCTION)).otherwise(F.lit(DOCUMENT_INSTRUCTION)), text)


def rerank_wrap(text: Column) -> Column:
    return F.when(text.contains("[CLS]"), text).otherwise(F.concat(F.lit("[CLS]"), text, F.lit("[SEP]")))


def keywords(query: Column) -> Column:
    """Words without outer punctuation, stop words and words of two bytes or less; case and repeats stay."""
    bare = F.transform(F.split(query, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: ~F.lower(w).isin(*STOP_WORDS) & (F.octet_length(w) > 2))
