"""Selecting and reading records: search, unique lookup, current version, captions, editions, payload filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns of captions and edition lists, and classes of paragraphs that are no text.
CAPTION = r"(?U)\d{1,}[.]\s+(?:[*]\s+)?\w{2}\s+\d{2}[.]\d{2}[.]\d{4}\s+[(]№\s+(\d{1,}-[ФЗК]+)(?:\s+\w{2}\s+(\d{2}[.]\d{2}[.]\d{4}))?[)]"
EDITION = r"(?U)\d{1,}\s+-\s+\w{2}\s+(\d{2}[.]\d{2}[.]\d{4})\s+(?:№\s+(\d{1,}-[ФЗК]+))?\s+(?:[(]([^)]+))?"
DATE = "dd.MM.yyyy"
SKIPPED_CLASSES = ("I", "C", "T", "Z", "Y", "mark", "markx")
SECTION_TYPES = (("C", "Citation"), ("T", "Title"), ("H", "Header"), ("I", "Signature"))


def search_documents(cards: DataFrame, date: str, key: str, date_to, kinds=None, date_from=None, kind: str = "kind", number=None, page_size: int = 20) -> DataFrame:
    """Cards up to date_to (inclusive), of the kinds and number if given, newest first."""
    at = F.col(date) <= F.lit(date_to).cast("timestamp")
    at = at & (F.col(date) >= F.lit(date_from).cast("timestamp")) if date_from else at
    at = at & F.col(kind).isin(list(kinds)) if kinds else at
    at = at & (F.col(key) == number) if number is not None else at
    return cards.where(at).orderBy(F.desc(date), key).limit(page_size)


def lookup_unique(cards: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted plus n and status (ok, ambiguous, missing) of its match in cards."""
    n = cards.groupBy(*keys).agg(F.count("*").alias("n"))
    out = wanted.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ambiguous").otherwise("missing"))


def pick_current(rows: DataFrame, doc: str, pos: str, flag: Column) -> DataFrame:
    """Per document the first row (by pos) for which flag holds; documents without one keep a null struct."""
    row = F.struct(*[c for c in rows.columns if c != doc])
    return rows.groupBy(doc).agg(F.min_by(F.when(flag, row), F.when(flag, F.col(pos))).alias("current"))


def with_caption_source(df: DataFrame, col: str) -> DataFrame:
    number = F.regexp_extract(col, CAPTION, 1)
    date = F.regexp_extract(col, CAPTION, 2)
    return df.withColumn("source_number", F.nullif(number, F.lit(""))).withColumn("source_date", F.try_to_date(F.nullif(date, F.lit("")), DATE))


def parse_editions(options: DataFrame, value: str = "value", text: str = "text") -> DataFrame:
    """One row per match of the edition pattern: edition_id (null: not ready), is_ready, edition_date, number, comment."""
    first = F.split_part(F.col(value), F.lit(","), F.lit(1))
    out = options.withColumn("edition_id", F.when(first != "n", first.try_cast("long"))).withColumn("is_ready", first != "n")
    out = out.withColumn("m", F.explode(F.regexp_extract_all(text, F.lit(EDITION), F.lit(0))))
    part = lambda i: F.nullif(F.regexp_extract("m", EDITION, i), F.lit(""))
    return out.withColumns({"edition_date": F.try_to_date(part(1), DATE), "number": part(2), "comment": part(3)}).drop("m")


def find_first(rows: DataFrame, wanted: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """wanted plus the value of its first match (by pos)."""
    first = rows.groupBy(*keys).agg(F.min_by(value, pos).alias(value))
    return wanted.join(first, keys, "left")


def paragraph_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^p(\d+)$", 1).try_cast("int")


def text_paragraphs(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("tag") == "p") & ~F.arrays_overlap("classes", F.array(*map(F.lit, SKIPPED_CLASSES))))


def section_type(classes: Column) -> Column:
    out = F
    for css, name in SECTION_TYPES:
        out = out.when(F.array_contains(classes, css), name)
    return out.otherwise("Paragraph")


@dataclass(frozen=True)
class Eq:
    column: str
    value: object


@dataclass(frozen=True)
class Range:
    column: str
    gt: object = None
    lt: object = None


def build_filter(conditions: list, mode: str = "and") -> Column:
    """One predicate of exact matches and open ranges; mode joins them."""

    def one(c) -> Column:
        if isinstance(c, Eq):
            return F.col(c.column) == F.lit(c.value)
        parts = [F.col(c.column) > F.lit(c.gt)] * (c.gt is not None) + [F.col(c.column) < F.lit(c.lt)] * (c.lt is not None)
        return reduce(Column.__and__, parts, F.lit(True)) if parts else F.lit(True)

    every = [one(c) for c in conditions]
    return reduce(Column.__and__ if mode == "and" else Column.__or__, every) if every else F.lit(True)


def dimension_status(points: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    return points.withColumn("dim_ok", F.coalesce(F.size(col) == dim, F.lit(False)))


def carry_last(df: DataFrame, doc: str, order: str, flag: Column, value: Column, name: str) -> DataFrame:
    """The value of the last row up to here for which flag holds."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(flag, value), True).over(w))
