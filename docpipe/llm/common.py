"""Shared helpers of the training-data operators: staged tables, star components, worker-side files."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir); a temporary one where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found if re.match(r"\w+:", found) else "file://" + found


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/docpipe-{tag}-{uuid.uuid4().hex}"


#: Set while a table is staged. Shuffle files go when the query ends (they would stay until the driver collects garbage; lost ones
#: are made anew), and an Arrow batch holds no more text than this, for a worker and its JVM hold it several times.
WHILE_STAGED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "1m",
}


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and outlives executors."""
    spark = df.sparkSession
    path, before = new_dir(spark, tag), {k: spark.conf.get(k) for k in WHILE_STAGED}
    try:
        for k, v in WHILE_STAGED.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more; what was made from it is staged itself."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if "/docpipe-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(run):
    """run over batches; when its task ends, what the worker has freed goes back to the machine, for workers outlive tasks and stages."""

    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return to_the_end


def pages(lengths: np.ndarray, most: int = 1 << 22):
    """(from, to) of runs of texts of about ``most`` characters, one text at least."""
    at, ends = 0, np.cumsum(lengths)
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


#: Bits of the bitmap by which rows are parted; it is broadcast as a row for each 64 of them, so in some 10 MB at most.
BITS = 1 << 24


def parted(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may stand in wanted, rows whose key does not), by a bitmap of key hashes; nulls count as a key.

    A join with wanted then moves the first part only. Where wanted outgrows the bitmap, the first part holds more rows that
    the join has to look up, and no row is told wrongly."""

    def bit(col):
        at = F.pmod(F.xxhash64(col), F.lit(BITS))
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))

    word, mask = bit(wanted[wanted_key])
    words = F.broadcast(wanted.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")))
    word, mask = bit(rows[key])
    there = (word == words["word"]) & (mask.bitwiseAND(words["mask"]) != 0)
    return rows.join(words, there, "left_semi"), rows.join(words, there, "left_anti")


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v) edges where each task has replaced its own by stars around their smallest nodes; of the same components."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                root[max(u, v)] = min(u, v)
        out = np.array([(x, find(x)) for x in list(root)], np.int64).reshape(-1, 2)
        out = out[out[:, 0] != out[:, 1]]
        for k in range(0, len(out), 1 << 14):
            yield pa.record_batch({"u": out[k : k + (1 << 14), 0], "v": out[k : k + (1 << 14), 1]})

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _with_least(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the u's own row of low (u, m, c). Nodes on more than a thousandth of all edges, 2,000 at most, are
    joined by broadcast, so that none of them is one task."""
    hot = low.where(F.col("c") * 1000 > total).select("u", F.col("m").alias("hm"))
    both = edges.join(F.broadcast(hot), "u", "left")
    rest = both.where("hm is null").join(low.where(F.col("c") * 1000 <= total).select("u", "m"), "u").select("u", "v", "m")
    return both.where("hm is not null").select("u", "v", F.col("hm").alias("m")).unionByName(rest)


#: Contracted edges that one task may end alone (4 MB; some 60 MB as its dictionary): rounds over so few cost only their tasks.
FEW = 1 << 18


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """Connected components of (a, b) rows by alternating large-star and small-star steps.

    Returns (node, component), component the smallest node reachable; nodes without an edge have no row. Each task first
    contracts the edges it holds, so few rounds are needed; where no more than ``few`` edges are left, contracting these once
    more is the last round. A step needs only a minimum per node, which is combined before its shuffle, so a hub with a third
    of all edges is no single task. Only a count and a checksum reach the driver.
    """
    e = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = staged(contracted(e), "edges")
    seen = told(e)
    at_once = seen[0] <= few
    if at_once and seen[0]:
        was, e = e, staged(contracted(e.coalesce(1)), "edges")
        discard(was)
    for _ in range(0 if at_once else max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = _with_least(both.where("v > u"), low, seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = (
            _with_least(large, low2, seen[0])
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v").where("u <> v").distinct()
        )
        was, e = e, staged(small, "edges")
        discard(was)
        now = told(e)
        if now == seen:
            break
        seen = now
    else:
        if not at_once:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def put_file(uri: str, data: bytes) -> None:
    """Write a file whole or not at all: repeated and speculative attempts of a task leave one good copy."""
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, path)


def get_file(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)
