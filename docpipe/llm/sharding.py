"""Shards of near-equal size by sampled splitters; DataFrame functions only.

Records are ordered by (hash of the text, doc_id). A size-weighted sample of these keys, drawn by a hash so that a
repeated task draws the same one, gives quantile splitters; every record finds its range by binary search. Ranges
that turn out overfull are sampled again and subdivided: the key goes on to doc_id, so a group of equal texts of
any size can be cut. Running sums inside each range, on top of exact sums over ranges, then place each record at
its exact byte offset in the whole order, and shards are equal stretches of it.

Law: ``bytes``. The shards' sizes differ by no more than about one record. Equal texts stand side by side, so they
share a shard unless a boundary falls among them. Cases: null text counts as empty (size 1, crc 0); repeated rows are
kept; null doc_ids sort first; an empty table gives an empty result; extra columns are dropped; one record larger than a
shard's share leaves neighbouring shards with less or nothing.

Bounds: at most ``MAX_RANGES`` splitters and about ``SAMPLES_A_RANGE`` times as many sampled keys reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

MIN_RANGES, MAX_RANGES, ROWS_A_RANGE, SAMPLES_A_RANGE, ROUNDS = 256, 8192, 1_000_000, 8, 4


def _literal(cuts: list[tuple[int, int]]) -> Column:
    text = "[" + ",".join(f'{{"k":{k},"d":{d}}}' for k, d in cuts) + "]"
    return F.from_json(F.lit(text), "array<struct<k:bigint,d:bigint>>")


def range_of(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are <= (k, d): a binary search, log2(len(cuts)) steps a row."""
    if not cuts:
        return F.lit(0)
    at, here = _literal(cuts), F.struct(F.col("k"), F.col("d"))
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda n, s: F.when((n + s <= len(cuts)) & (F.get(at, n + s - 1) <= here), n + s).otherwise(n),
    )


def _sample(rows: DataFrame, unit: Column, seed: int) -> DataFrame:
    """Keys kept with probability size / unit; each stands for max(size, unit) bytes."""
    u = F.pmod(F.xxhash64("k", "d", "size", F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)
    return rows.where(u * unit < F.col("size")).select("k", "d", F.greatest(F.col("size").cast("double"), unit).alias("w"))


def _quantiles(keys: list, every: float) -> list[tuple[int, int]]:
    cuts, run, step = [], 0.0, 1
    for k, d, w in keys:
        run += w
        if run >= every * step:
            cuts.append((k, d))
            step = int(run / every) + 1
    return cuts


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("k"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"),
    )
    rows = staged(rows, "shardkeys")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_ranges = min(MAX_RANGES, max(MIN_RANGES, n // ROWS_A_RANGE))
    every = max(1.0, total / n_ranges)
    unit = every / SAMPLES_A_RANGE
    cuts = _quantiles(sorted(map(tuple, _sample(rows, F.lit(unit), 1).collect())), every)
    for seed in range(2, 2 + ROUNDS):
        held = rows.groupBy(range_of(cuts).alias("r")).agg(F.sum("size").alias("b"), F.min(F.struct("k", "d")).alias("lo"), F.max(F.struct("k", "d")).alias("hi"))
        over = {x.r: x.b for x in held.where((F.col("b") > 2 * every) & (F.col("lo") != F.col("hi"))).collect()}
        if not over or len(cuts) >= MAX_RANGES:
            break
        r = range_of(cuts)
        again = _sample(rows.withColumn("r", r).where(F.col("r").isin(list(over))), F.lit(unit / 2), seed)
        cuts = sorted({*cuts, *_quantiles(sorted(map(tuple, again.collect())), every / 2)})
    order = [F.col("k"), F.col("d"), F.col("size"), F.col("crc")]
    inside = Window.partitionBy("r").orderBy(*order)
    ranged = rows.withColumn("r", range_of(cuts))
    sums = ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    upto = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range, MAX_RANGES at most
    before = sums.select("r", F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("c0"))
    placed = (
        ranged.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(inside))
        .join(F.broadcast(before), "r")
        .withColumn("mid", 2 * (F.col("b0") + F.col("run")) - F.col("size"))
        .select("id", "size", "crc", F.expr(f"cast(least({n_shards - 1}, mid * {n_shards} div {2 * max(total, 1)}) as int)").alias("shard"), (F.col("c0") + F.col("rn") - 1).alias("g"))
    )
    placed = staged(placed, "shards")
    first = placed.groupBy("shard").agg(F.min("g").alias("g0"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("g") - F.col("g0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
