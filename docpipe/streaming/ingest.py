"""Incremental ingest and delete: documents through chunks and vectors into a points table that keeps one version of each.

The table is dealt into ``BUCKETS`` by document. A write replaces all chunks of its documents, whether they have more, fewer or none
now, and rewrites only the buckets these fall into, each as a new version below ``b=<bucket>/e=<version>``; a bucket's newest version
is what the table holds. Each version has a marker row, so that a bucket whose last document went is a version as well. A batch that
is run again, after a failure half-way, replaces the same documents once more and gives the same table. Superseded versions stay for
a grace period, for readers that have begun, and go at the next write behind it. One writer at a time is assumed, as with any table
that is files.

Cases: a document that comes twice in a batch counts with its longest text (then the largest); null and blank texts have no chunks,
so their documents leave the table; rows without a doc_id are the document of an empty name; a table that has nothing yet is empty.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from docpipe.operators.chunking import word_windows
from docpipe.operators.search import to_points
from docpipe.operators.vectors import encode

BUCKETS = 256
GRACE = 3600  # seconds that a superseded version stays


def points_of(docs: DataFrame, encoder=None, size: int = 512, overlap: int = 50) -> DataFrame:
    uri = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("document_uri")
    chunks = word_windows(docs.select(uri, "text"), "text", size, overlap).drop("text")
    return to_points(encode(chunks.withColumn("embedding_text", F.col("content")), "embedding_text", encoder))


def point_schema(spark: SparkSession) -> StructType:
    return points_of(spark.createDataFrame([], "doc_id string, text string")).schema


def _versions(spark: SparkSession, table: str) -> list[tuple[int, int, str, float]]:
    """(bucket, version, folder, seconds since the epoch it was written) of all versions, from folder names alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/b=*/e=*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in fs.globStatus(path) or []:
        p = s.getPath()
        out.append((int(p.getParent().getName()[2:]), int(p.getName()[2:]), p.toString(), s.getModificationTime() / 1000))
    return out


def _newest(versions: list) -> dict[int, tuple]:
    out: dict[int, tuple] = {}
    for v in versions:
        if v[0] not in out or v[1] > out[v[0]][1]:
            out[v[0]] = v
    return out


def current(spark: SparkSession, table: str, buckets: list[int] | None = None, markers: bool = False) -> DataFrame:
    """The points of the newest version of every bucket (buckets: of these)."""
    schema = point_schema(spark)
    full = StructType([*schema, StructField("b", IntegerType()), StructField("e", LongType())])
    paths = [v[2] for b, v in _newest(_versions(spark, table)).items() if buckets is None or b in buckets]  # BUCKETS at most
    rows = spark.read.schema(full).option("basePath", table).parquet(*paths) if paths else spark.createDataFrame([], full)
    return rows if markers else rows.where("id is not null").select(*schema.names)


def bucket_of(uri: Column) -> Column:
    return F.pmod(F.xxhash64(uri), F.lit(BUCKETS)).cast("int")


def replace(spark: SparkSession, table: str, uris: DataFrame, new: DataFrame | None, grace: float = GRACE) -> dict[str, int]:
    """Replace all points of the documents uris (document_uri) by new ones, or by none. Returns how many went and came."""
    asked = uris.select("document_uri").distinct().withColumn("b", bucket_of(F.col("document_uri"))).persist()
    try:
        buckets = [r.b for r in asked.select("b").distinct().collect()]  # BUCKETS at most
        versions = _versions(spark, table)
        version = 1 + max((v[1] for v in versions), default=-1)
        schema = point_schema(spark)
        old = current(spark, table, buckets)
        kept = old.join(asked.select("document_uri"), "document_uri", "left_anti").select(*schema.names)
        gone = old.join(asked.select("document_uri"), "document_uri", "left_semi").count()
        came = 0
        if new is not None:
            new = new.select(*schema.names).persist()
            came = new.count()
        if gone or came:
            rows = (kept if new is None else kept.unionByName(new)).withColumn("b", bucket_of(F.col("document_uri")))
            marks = spark.createDataFrame([(b,) for b in buckets], "b int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], "b")
            # a task writes the rows of whole buckets, so a bucket is a file
            out = rows.unionByName(marks).withColumn("e", F.lit(version).cast("long")).repartition("b")
            out.write.mode("append").partitionBy("b", "e").parquet(table)
        if new is not None:
            new.unpersist()
    finally:
        asked.unpersist()
    clean(spark, table, grace)
    return {"deleted": gone, "inserted": came}


def clean(spark: SparkSession, table: str, grace: float = GRACE) -> int:
    """Remove versions that were superseded more than ``grace`` seconds ago; returns how many."""
    versions = _versions(spark, table)
    since: dict[int, list] = {}
    for v in versions:
        since.setdefault(v[0], []).append(v)
    n = 0
    for every in since.values():
        every.sort(key=lambda v: v[1])
        for v, later in zip(every, every[1:]):
            if time.time() - later[3] >= grace:
                path = spark._jvm.org.apache.hadoop.fs.Path(v[2])
                n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def delete(spark: SparkSession, table: str, uris: DataFrame, grace: float = GRACE) -> int:
    """Remove documents (document_uri); returns how many points went."""
    return replace(spark, table, uris, None, grace)["deleted"]


def ingest(spark: SparkSession, source: str, schema, table: str, checkpoint: str, encoder=None, grace: float = GRACE):
    """Start a query that takes the files now below source and merges their documents into the table. Returns the query."""

    def step(batch: DataFrame, epoch: int) -> None:
        text = F.coalesce("text", F.lit(""))
        docs = batch.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")).agg(F.max_by(text, F.struct(F.length(text), text)).alias("text"))
        docs.persist()
        try:
            replace(batch.sparkSession, table, docs.select(F.col("doc_id").alias("document_uri")), points_of(docs, encoder), grace)
        finally:
            docs.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
