"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, neighbouring pairs and one-word skip pairs, hashed into ``2**BITS`` slots; a
slot counts once a text. Words are ASCII-lower-cased runs of digits, letters and non-ASCII characters. The fit takes
at most ``MAX_FIT`` labelled rows (those with the smallest hash of doc_id, so the same at every run) and visits them
in hash order; L1 leaves a few thousand weights, which are all that reaches the driver (at most 2**BITS) and the
workers. Scoring is one pass without a shuffle.

Cases: null and empty texts score by the bias alone; a label row that is null in doc_id or label is not learnt from;
a doc_id with several labels or texts is learnt from once, as toxic if any label says so; repeated documents are each scored; no usable
label gives the score 0 everywhere (all predicted 0); an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, tidied

BITS, MAX_FIT, EPOCHS = 20, 5_000, 10
#: L1 exceeds EPOCHS, so no feature of a single document can gather a weight.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
#: Every byte that ends a word becomes a blank; A-Z become a-z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def slots(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed features of the whole text, repeats included."""
    words = (text or "").encode("utf-8", "replace").translate(TABLE).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    two = h * np.uint64(0x9E3779B97F4A7C15)
    near, skip = two[:-1] + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F), two[:-2] + h[2:] * np.uint64(0x165667B19E3779F9)
    mixed = np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), near * np.uint64(0xFF51AFD7ED558CCD), skip * np.uint64(0xC4CEB9FE1A85EC53)])
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(rows, bits: int = BITS, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """rows: (distinct slots, label) in the order of visits. Returns bias, and the slots and values of non-zero weights."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias, free of L1

    def weights(i):
        zi = z[i]
        l1 = np.where(i == size, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for idx, y in rows:
            i = np.append(idx, size)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    keep = np.flatnonzero(w[:size])
    return float(w[size]), keep, w[keep]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights learnt from labelled documents outside the held-out fifth."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    there = docs.select("doc_id").where(~held_out(F.col("doc_id"))).distinct()
    picked = known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    # max_fit rows, one of each doc_id: of several texts the one with the smallest hash
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches):
        for b in batches:
            f = [np.unique(slots(t)).astype(np.int32) for t in b["text"]]
            yield pd.DataFrame({"at": b["at"], "toxic": b["toxic"], "f": f})

    def train(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(n=[len(f) for f in p["f"]], s=[int(np.sum(f)) for f in p["f"]]).sort_values(["at", "n", "s"])
        rows = list(zip(p["f"], p["toxic"].tolist(), strict=True))
        bias, idx, w = ftrl(rows)
        return pd.DataFrame({"idx": np.append(idx, -1), "w": np.append(w, bias)})

    made = (
        texts.select(F.xxhash64("doc_id").alias("at"), F.col("toxic").cast("int").alias("toxic"), "text")
        .mapInPandas(tidied(features), "at long, toxic int, f array<int>")
        .withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "idx long, w double")  # max_fit rows at most
    )
    got = staged(made, "weights").toPandas()  # at most 2**BITS rows, a few thousand as a rule
    if got.empty:
        return -35.0, np.zeros(0, np.int64), np.zeros(0)
    bias = float(got.loc[got.idx < 0, "w"].iloc[0])
    got = got[got.idx >= 0].sort_values("idx")
    return bias, got["idx"].to_numpy(np.int64), got["w"].to_numpy()


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> Column:
    """A column expression: probability that docs.text is toxic."""
    bias, idx, w = model
    sent = docs.sparkSession.sparkContext.broadcast((bias, idx.astype(np.int32), w))

    @F.pandas_udf("double")
    def toxic_probability(texts: pd.Series) -> pd.Series:
        b, at, val = sent.value
        dense = np.zeros(1 << BITS)
        dense[at] = val
        out = []
        for t in texts:
            i = slots(t)
            i = np.unique(i[dense[i] != 0])
            out.append(1 / (1 + np.exp(-np.clip(b + dense[i].sum(), -35, 35))))
        return pd.Series(out, dtype="float64")

    return toxic_probability(F.col("text"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
