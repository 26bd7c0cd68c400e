"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next one's
docs. All but the last return the columns of documents; whole documents are kept or go. Duplicates are found on five-word
shingles at a similarity of 0.8 or more; the row of the smallest doc_id of a group stays. Rows equal in doc_id and text are
one document; rows that share a doc_id only are documents of their own. Rows without a doc_id are no duplicates of anything,
but go if toxic or contaminated. ORACLE_SQL is None: SQL expresses neither the classifier nor the tokenizer;
tests/llm/test_pipeline.py compares stages and whole with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm import decontaminate, jaccard, sentencepieces, toxicity
from docpipe.llm.common import parted, staged

ORACLE_SQL = None


def _matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of docs with staged (doc_id, th) rows. Only documents whose doc_id may be among them are moved."""
    rows = rows.select(F.col("doc_id").alias("_other_id"), F.col("th").alias("_other_text"))
    maybe, never = parted(docs, "doc_id", rows, "_other_id")
    same = maybe["doc_id"].eqNullSafe(rows["_other_id"]) & (F.xxhash64(F.coalesce(maybe["text"], F.lit(""))) == rows["_other_text"])
    found = maybe.join(rows, same, how)
    return never.union(found) if how == "left_anti" else found


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(docs, model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = _matching(docs, jaccard.near_copies(docs, n=5, pct=80), "left_anti")
    known = docs.where("doc_id is not null").groupBy("doc_id", jaccard.text_hash())
    twice = staged(known.agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "th"), "repeats")
    if twice.isEmpty():
        return left
    return _matching(left, twice, "left_anti").unionByName(_matching(left, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _matching(docs, staged(found.where("n_hit > 0").select("doc_id", "th").distinct(), "contaminated"), "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
