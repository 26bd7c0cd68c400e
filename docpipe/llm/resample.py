"""Importance resampling towards a target: documents drawn by hashed n-gram likelihood and Gumbel noise, ranked by a parallel sort.

Features of a text are its words and its pairs of neighbouring words, repeats included, hashed by crc32 into ``BUCKETS`` slots. One
pass sums slots over all source rows and all target rows (an array a task), the gain of each slot is an array of fixed length that
goes to every task, and a second pass scores texts by lookups in it: words and crc32 sums come from whole Arrow buffers at once, a
pair's sum from those of its words. Ranks come from parallel sorting by regular sampling: a task sorts its rows into runs and marks
regularly spaced ones, these give splitters, the runs are cut at them and exchanged, a segment's pieces are merged in one task, and
counts of the segments before it turn places into exact ranks. Keys end in run and place, so ties of any size are split as well. No
document reaches the driver but the marked ones (``MARKED`` in all, or one a task where tasks are more).

Cases: null and empty texts have no features and the weight 0; a null doc_id is hashed as an empty string and ranks behind other
doc_ids of its score; repeated rows are each scored and drawn; equal rows of one doc_id differ in rank only; with an empty target or
source its counts are 0; an empty table gives an empty result; extra columns are dropped. doc_id must be an integer.
"""

from __future__ import annotations

import hashlib
import math
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pages, staged, tidied

BUCKETS, MARKED, SEGMENT, RUN = 10_000, 1 << 18, 50_000, 200_000
LONG = 64  # bytes of a word up to which its sum is taken by table
#: Every byte that ends a word becomes a blank; A-Z become a-z. Bytes of non-ASCII characters are 128 and more.
TABLE = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def crc_table() -> np.ndarray:
    """The 256 remainders of bytes for the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of a sum, if it is b, becomes when n zero bytes follow."""
    now = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(LONG):
        now = CRC[now & 255] ^ now >> 8
        out.append(now)
    return np.stack(out)


SHIFT = _shifts()


def _shifted(crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return SHIFT[n, 0, crc & 255] ^ SHIFT[n, 1, crc >> 8 & 255] ^ SHIFT[n, 2, crc >> 16 & 255] ^ SHIFT[n, 3, crc >> 24]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of string texts without nulls, and how many words each text has."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    data = TABLE[raw]
    word = np.concatenate([[False], data != 32, [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True  # words end where texts do
    start = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    stop = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    size = stop - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int16), kind="stable")
    at, run = start[order], crc.copy()
    left = np.bincount(np.minimum(size, LONG + 1), minlength=LONG + 2)[::-1].cumsum()[::-1]  # words of so many bytes at least
    for j in range(LONG):
        n = left[j + 1]
        if not n:
            break
        run[:n] = CRC[(run[:n] ^ data[at[:n] + j]) & 255] ^ run[:n] >> 8
    crc[order] = ~run
    big = np.flatnonzero(size > LONG)
    for i in big:
        crc[i] = crc32(data[start[i] : stop[i]])
    doc = np.searchsorted(ends, start, "right") - 1
    two = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else doc
    led = _shifted(crc[two], 1) ^ np.uint32(crc32(b" "))  # a word and a blank
    pair = _shifted(led, np.minimum(size[two + 1], LONG)) ^ crc[two + 1]
    for i in np.flatnonzero(size[two + 1] > LONG):
        pair[i] = crc32(data[start[two[i] + 1] : stop[two[i] + 1]], int(led[i]))
    return np.concatenate([doc, doc[two]]), np.concatenate([crc, pair]) % BUCKETS, np.bincount(doc, minlength=len(texts))


def _paged(batch, column: int):
    texts = batch.column(column)
    for at, to in pages(pc.binary_length(texts).to_numpy(zero_copy_only=False), 1 << 20):
        yield at, to - at, features(texts.slice(at, to - at))


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, (_, bucket, _) in _paged(b, 0):
                total += np.bincount(bucket, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(there.astype(np.int32)), "n": pa.array(total[there])})

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(tidied(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + BUCKETS) / ((a + 1.0) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("run", pa.int64()), ("pos", pa.int64()), ("gap", pa.int64())])


def scored_runs(docs: DataFrame, gain: np.ndarray, seed: int, min_words: int, text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, run, pos, gap): a task's rows as sorted runs; run null: too few words to be drawn. gap of a
    marked row: how many rows of its run it stands for."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    marks = max(1, min(256, MARKED // max(1, given.rdd.getNumPartitions())))

    def sorted_run(rows: list[tuple], name: int) -> pa.RecordBatch:
        ids, n, weight, score, words = zip(*rows, strict=True)
        null = np.array([i is None for i in ids])
        ids = np.array([0 if i is None else i for i in ids], np.int64)
        n, weight, score = (np.array(x, np.int64) for x in (n, weight, score))
        out = np.array(words) < min_words
        order = np.lexsort((n, ids, null, -score, out))  # those that can be drawn come first
        m = int((~out).sum())
        pos, gap = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        if m:
            cuts = np.linspace(0, m, min(marks, m) + 1).astype(np.int64)
            gap[(cuts[:-1] + cuts[1:]) // 2] = np.diff(cuts)
        cols = [pa.array(ids[order], mask=null[order]), n[order], weight[order], score[order], pa.array(np.full(len(rows), name), mask=pos >= m), pos, gap]
        return pa.record_batch([pa.array(c) for c in cols], schema=SCORED)

    def run(batches):
        from pyspark import TaskContext

        table, rows, name = sent.value, [], TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column(0)
            for at, n, (doc, bucket, words) in _paged(b, 1):
                count = np.bincount(doc, minlength=n)
                total = np.bincount(doc, table[bucket], n).astype(np.int64)  # whole numbers far below 2**53
                weight = np.where(count > 0, total // np.maximum(count, 1), 0).tolist()
                part = ids.slice(at, n).to_pylist()
                rows += zip(part, count.tolist(), weight, [w + noise(seed, i) for w, i in zip(weight, part, strict=True)], words.tolist(), strict=True)
                if len(rows) >= RUN:
                    yield sorted_run(rows, name)
                    rows, name = [], name + 1
        if rows:
            yield sorted_run(rows, name)

    return staged(given.mapInArrow(tidied(run), "doc_id long, n_features long, weight long, score long, run long, pos long, gap long"), "runs")


def _keys(t) -> list[np.ndarray]:
    ids = t.column("doc_id")
    of = lambda c: np.asarray(t.column(c).to_numpy(), np.int64)
    return [-of("score"), np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64), np.asarray(ids.fill_null(0).to_numpy(), np.int64), of("n_features"), of("run"), of("pos")]


def _segments(keys: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """How many splitters are not above each row: a binary search over rows of keys."""
    lo, hi = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(splitters))
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(splitters) - 1)
        above, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, key in enumerate(keys):
            other = splitters[mid, k]
            above |= same & (other > key)
            same &= other == key
        lo, hi = np.where(open_ & ~above, mid + 1, lo), np.where(open_ & above, mid, hi)
    return lo


def drawn(runs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all rows: rank counts from the highest score, ties from the smaller doc_id, up to
    percent of those that can be drawn; null for all others."""
    spark = runs.sparkSession
    able = runs.where("run is not null")
    marked = able.where("gap > 0").select(F.negate("score"), F.col("doc_id").isNull().cast("int"), F.coalesce("doc_id", F.lit(0)), "n_features", "run", "pos", "gap")
    marked = np.array(sorted(map(tuple, marked.collect())), np.int64).reshape(-1, 7)  # MARKED rows or one a task
    stands = marked[:, 6].cumsum()
    total = int(stands[-1]) if len(stands) else 0
    limit = percent * total // 100
    parts = max(1, min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SEGMENT))))
    at = np.unique(np.searchsorted(stands, np.arange(1, parts) * total / parts)) if total else np.zeros(0, np.int64)
    sent = spark.sparkContext.broadcast(marked[at, :6])

    def cut(batches):
        for b in batches:
            seg = _segments(_keys(b), sent.value) if len(sent.value) else np.zeros(len(b), np.int64)
            yield b.append_column("segment", pa.array(seg, pa.int64()))

    kept = "doc_id long, n_features long, weight long, score long, run long, pos long"
    pieces = staged(able.drop("gap").mapInArrow(cut, f"{kept}, segment long"), "pieces")
    sizes = sorted((r.segment, r.n) for r in pieces.groupBy("segment").agg(F.count("*").alias("n")).collect())  # a row for each segment
    before = dict(zip([s for s, _ in sizes], accumulate((n for _, n in sizes), initial=0), strict=False))
    reached = [s for s in before if before[s] < limit]
    first = spark.sparkContext.broadcast(before)

    def merge(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.lexsort(tuple(reversed(_keys(t))))
        rank = first.value[t.column("segment")[0].as_py()] + 1 + np.arange(len(t))
        return t.take(pa.array(order)).select(["doc_id", "n_features", "weight", "score"]).append_column("rank", pa.array(rank, pa.int64(), mask=rank > limit))

    inside = F.col("segment") <= (max(reached) if reached else -1)
    merged = pieces.where(inside).groupBy("segment").applyInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")
    rest = pieces.where(~inside).drop("segment").unionByName(runs.where("run is null").drop("gap"))
    return merged.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = 20) -> DataFrame:
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return drawn(scored_runs(docs, gain, seed, min_words), percent)


def op12_resample(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


_BYTES = "list_transform(range(0, strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"
CRC_SQL = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: xor(({CRC.tolist()}::BIGINT[])[(xor(c, b) & 255) + 1], c >> 8)))"

OP12_SQL = rf"""WITH texts AS (SELECT 0 AS target, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT target, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT target, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
b AS MATERIALIZED (SELECT f, {CRC_SQL.format("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM f)),
n AS (SELECT b, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM f JOIN b USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n)::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n)::DOUBLE + 10000))))::BIGINT AS gain FROM n),
m AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE target = 0 GROUP BY r),
d AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (r) WHERE target = 0),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
y AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND rank <= 25 * (SELECT count(*) FROM d WHERE able) // 100 THEN rank END::BIGINT AS rank FROM y"""
