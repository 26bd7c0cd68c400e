"""Readers of landed files (JSON answers, encoded pages) and the points table on disk."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docpipe.functions.text import null_if_empty
from docpipe.operators.records import with_caption_source
from docpipe.operators.search import to_points
from docpipe.operators.vectors import checked_size, encode

# The layouts of the landed answers.
CARDS = "docs array<struct<docid: bigint, docstampname: string, docnames: string, docdescription: string, docpassing: string, docstate: string, docimagepath: string, publications: array<string>, dockind: string, kindrank: string, docpass0date: string, docpass0numberint: bigint, docpass0number: string, dochash: string>>, docscount bigint, error string"
REDACTIONS = "docid bigint, dochash string, serverdate string, error string, redactions array<struct<redid: bigint, reddocrefid: bigint, reddate: string, reddatetimed: string, redstateid: bigint, stateclass: bigint, statename: string, redelements: smallint, redtype: int, redcaption: string, redstatus: string, redreason: string, redflags: bigint, redcompleted: boolean, redchecked: boolean, redofficial: boolean, actual: boolean, redinitial: boolean, hascontent: boolean, contentcomplete: boolean>>"
CONTENTS = "data array<struct<id: string, np: string, npe: string, caption: string, unit: string, lvl: int>>, error string, status tinyint, typeact string, lockkey bigint"


def _checked(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.assert_true(null_if_empty(F.col("error")).isNull(), F.concat(F.lit("landed answer holds an error: "), F.col("error"))).isNull(), F.lit(True)))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    d = _checked(spark.read.schema(CARDS).json(path)).select(F.explode("docs").alias("d")).select("d.*")
    e = lambda c: null_if_empty(F.col(c))
    return d.select(F.col("docid").alias("doc_id"), e("docstampname").alias("stamp_name"), e("docnames").alias("name"), e("docdescription").alias("description"), F.col("docstate").alias("doc_state"), "publications", e("dockind").alias("kind"), e("kindrank").alias("kind_rank"), F.try_to_date("docpass0date", "yyyyMMdd").alias("sign_date"), F.col("docpass0numberint").alias("number_int"), F.col("docpass0number").alias("number"), F.col("dochash").alias("hash"))


def read_redactions(spark: SparkSession, path: str) -> DataFrame:
    """Redactions in order, with the number and date of the law that a caption names; an answer without any is an error."""
    d = _checked(spark.read.schema(REDACTIONS).json(path))
    empty = F.coalesce(F.size("redactions"), F.lit(0)) <= 0
    d = d.where(F.assert_true(~empty, F.concat(F.lit("no redactions of "), F.coalesce("dochash", F.lit("?")))).isNull())
    rows = d.select(F.col("dochash").alias("doc_hash"), F.posexplode("redactions").alias("pos", "r")).select("doc_hash", "pos", "r.*")
    for c in ("redreason", "redstatus", "statename", "reddate", "reddatetimed"):
        rows = rows.withColumn(c, null_if_empty(F.col(c)))
    return with_caption_source(rows, "redcaption")


def contents_rows(df: DataFrame, json_col: str, doc: str) -> DataFrame:
    d = _checked(df.select(F.col(doc).alias("doc"), F.from_json(json_col, CONTENTS).alias("j")).select("doc", "j.*"))
    return d.select("doc", F.posexplode("data").alias("pos", "c")).select("doc", "pos", "c.*")


def read_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages with html, quarantined rows with an error)."""
    d = spark.read.schema("redtext string, error string").json(path).withColumn("source_file", F.input_file_name())
    bad = null_if_empty(F.col("error")).isNotNull()
    return d.where(~bad).select("source_file", F.col("redtext").alias("html")), d.where(bad)


def read_encoded_pages(spark: SparkSession, path: str, charset: str = "windows-1251") -> DataFrame:
    """(path, html): strict decoding, a byte that the charset lacks is an error."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "html": [bytes(c).decode(charset) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, html string")


OPTION = r'<option[^>]*value="([^"]*)"[^>]*>([^<]*)'


def edition_options(pages: DataFrame, html: str = "html") -> DataFrame:
    """(value, text) rows of the list of editions in a page."""
    block = F.regexp_extract(html, r'(?s)<select[^>]*name="doc_editions"[^>]*>(.*?)</select>', 1)
    got = pages.withColumn("o", F.explode(F.regexp_extract_all(block, F.lit(OPTION), F.lit(0))))
    return got.withColumn("value", F.regexp_extract("o", OPTION, 1)).withColumn("text", F.trim(F.regexp_extract("o", OPTION, 2))).drop("o")


def ensure_table(spark: SparkSession, path: str, dim: int, metric: str = "cosine") -> bool:
    """Create an empty points table with its vector spec in the field's metadata; False, and nothing done, if it is there."""
    from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

    try:
        spark.read.parquet(path)
        return False
    except AnalysisException:
        spec = {"dim": dim, "metric": metric}
        schema = StructType([StructField("id", StringType()), StructField("embedding", ArrayType(FloatType()), True, spec), StructField("document_uri", StringType()), StructField("chunk_index", LongType()), StructField("text", StringType())])
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return True


def vector_spec(table: DataFrame) -> dict:
    return json.loads(json.dumps(table.schema["embedding"].metadata))


def write_points(points: DataFrame, path: str) -> None:
    """A new snapshot folder; the table being read is never written over."""
    points.write.mode("errorifexists").parquet(path)


def store_chunks(chunks: DataFrame, path: str, dim: int, encoder=None, batch_size: int = 32) -> DataFrame:
    """Chunks (document_uri, chunk_index, embedding_text, ...) encoded batch_size at a time, checked to have dim components and
    written as a new snapshot; returns the ids as (id, document_uri, chunk_index)."""
    points = checked_size(encode(to_points(chunks), "embedding_text", encoder, batch_size), dim)
    write_points(points, path)
    return chunks.sparkSession.read.parquet(path).select("id", "document_uri", "chunk_index")
