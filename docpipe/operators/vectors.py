"""Embedding jobs: batched encoding, pooling, averages."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from docpipe.functions.vector_math import l2_normalize

from .chunking import word_windows


def hashed_encoder(dim: int = 64):
    """A model-free encoder: signed counts of hashed words, L2-normalised. Give ``encode`` another maker for a real model."""

    def make():
        from zlib import crc32

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                h = np.fromiter((crc32(w.encode()) for w in (t or "").lower().split()), np.int64)
                np.add.at(out[i], h % dim, np.where(h & (1 << 20), 1.0, -1.0))
            n = np.sqrt((out * out).sum(1, keepdims=True))
            return np.divide(out, n, out=out, where=n > 0)

        return predict

    return make


def encode(df: DataFrame, text: str, encoder=None, batch_size: int = 256, out: str = "embedding") -> DataFrame:
    udf = predict_batch_udf(encoder or hashed_encoder(), return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.coalesce(text, F.lit(""))))


def average_vectors(df: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """(group, embedding): element-wise mean; partial sums are combined before the shuffle."""
    flat = df.select(group, F.posexplode(vec).alias("pos", "v")).groupBy(group, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    packed = flat.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x"))
    return packed.select(group, F.col("x.v").alias("embedding"))


def masked_mean(tokens: DataFrame, group: str, vec: str = "embedding", mask: str = "mask") -> DataFrame:
    """(group, embedding): mean of the vectors whose mask is 1, L2-normalised."""
    flat = tokens.select(group, F.col(mask).cast("double").alias("m"), F.posexplode(vec).alias("pos", "v")).groupBy(group, "pos").agg((F.sum(F.col("m") * F.col("v")) / F.sum("m")).alias("v"))
    packed = flat.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x"))
    return packed.select(group, l2_normalize(F.col("x.v")).alias("embedding"))


def encode_long(df: DataFrame, key: str, text: str, encoder=None, size: int = 512, overlap: int = 50) -> DataFrame:
    """(key, embedding): the average over a text's word windows; texts without words have no row."""
    return average_vectors(encode(word_windows(df.select(key, text), text, size, overlap), "content", encoder), key)


def first_token(tokens: DataFrame, group: str, order: str, vec: str = "embedding") -> DataFrame:
    """(group, embedding): each text's vector is that of its first token."""
    return tokens.groupBy(group).agg(F.min_by(vec, order).alias("embedding"))


def truncated(tokens: Column, most: int) -> Column:
    """The first tokens of an array, as many as an encoder takes."""
    return F.slice(tokens, 1, most)


def checked_size(points: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """points; the job fails at a vector that is null or of another size."""
    told = F.concat(F.lit(f"a vector of {dim} components is wanted, not "), F.coalesce(F.size(vec).cast("string"), F.lit("none")))
    return points.where(F.assert_true(F.coalesce(F.size(vec) == dim, F.lit(False)), told).isNull())
