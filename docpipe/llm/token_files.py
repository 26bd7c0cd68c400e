"""Token-id files: one zstandard dictionary for all, every document compressed by itself, offsets for direct access.

File format (little-endian), one file per run of documents in doc_id order::

    b"DPTOK1\\0\\0"  width u32 (bytes an id)  n u32  sha256 of the dictionary (32 bytes)  index offset u64
    n compressed documents, back to back
    index: n rows of doc_id i64, offset u64, length u32, n_tokens u64 (null doc_id: the smallest i64)

The dictionary, trained on serialised id arrays of at most ``TRAIN_DOCS`` documents (those with the smallest hash; long
ones in pieces of ``TRAIN_IDS`` ids), lies beside the files as ``<sha256>.dict``. Documents are range-partitioned and sorted
by doc_id; tasks close a file after ``FILE_BYTES``; files are named by content, so a repeated task writes the same name.
``read`` opens the listed files in tasks; ``read_one`` fetches one document by index without reading the rest.

Ids come from the tokenizers library. A byte-level vocabulary never joins across a blank that follows or precedes
something else, so texts are cut there and each worker keeps the ids of pieces it has met (about ``REMEMBER``, those of
late use); new ones go to the library, many at a time. Texts with a special string of the vocabulary or with white space beside
a blank, and all texts for other kinds of vocabulary, go to the library whole.

Cases: null and empty texts hold just the end id; repeated rows are each written, in order of doc_id and a hash of the
text; null doc_ids come first; an empty table gives no files and no rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from itertools import compress, repeat
from operator import is_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import get_file, new_dir, pages, put_file, staged, tidied

MAGIC, HEAD, ROW = b"DPTOK1\0\0", "<8sII32sQ", "<qQIQ"
HEAD_BYTES, ROW_BYTES = struct.calcsize(HEAD), struct.calcsize(ROW)
TRAIN_DOCS, TRAIN_IDS, DICT_BYTES, FILE_BYTES, REMEMBER, LEVEL = 1000, 1024, 65_536, 32 << 20, 700_000, 1
NO_ID = -(1 << 63)
MANIFEST = pa.schema([("uri", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("dict_sha256", pa.string()), ("part", pa.int32())])
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """One vocabulary in a Python worker, with the serialised ids of pre-tokens it has seen."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(vocabulary)
        spec = json.loads(vocabulary)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation")
        self.plain = plain
        self.length = np.array([len(self.tok.id_to_token(i) or "") for i in range(self.tok.get_vocab_size())])  # a character a byte
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.type = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> bool:
        """Ids of blank-led pieces, many in one call of the library: their bytes tell which ids are whose. False: they don't
        line up, so this vocabulary joins across blanks."""
        for k in range(0, len(new), 4000):
            part = new[k : k + 4000]
            raw = self._library(["".join([" " + w for w in part])])[0]
            ends = np.cumsum(self.length[np.frombuffer(raw, self.type)])
            wanted = np.cumsum([len(w.encode()) + 1 for w in part])
            at = np.searchsorted(ends, wanted)
            if at[-1] >= len(ends) or not np.array_equal(ends[at], wanted):
                return False
            cuts = [0, *((at + 1) * self.type.itemsize).tolist()]
            self.young.update((w, raw[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if not self.plain or self.added and self.added.search(t) else t.split(" ") for t in texts]
        first = [t if c is None else c.pop(0) for t, c in zip(texts, cut, strict=True)]
        if len(self.young) > REMEMBER // 2:
            self.young, self.old = {}, self.young
        get, parts, gaps, missing = self.young.get, [], [], set()
        for c in cut:
            p = list(map(get, c or ()))
            at = list(compress(range(len(p)), map(is_, p, repeat(None))))
            missing.update([c[i] for i in at])
            parts.append(p)
            gaps.append(at)
        known = {w: self.old[w] for w in missing if w in self.old}
        # a piece with white space at an end may be part of a longer run: it is not remembered, and its text is looked at
        new = [w for w in missing if w not in known and w and not w[0].isspace() and not w[-1].isspace()]
        self.young |= known
        if not self._learn(new):
            self.plain, self.young, self.old = False, {}, {}
            return self.encode(texts)
        for k, (c, p, at) in enumerate(zip(cut, parts, gaps, strict=True)):
            for i in at:
                p[i] = get(c[i])
            if at and None in p:
                first[k], parts[k] = texts[k], ()
        return [a + b"".join(p) for a, p in zip(self._library(first), parts, strict=True)]


def encoder(vocabulary: str) -> Encoder:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:  # a vocabulary file of the installation
        return f.read()


def train_dictionary(docs: DataFrame, vocabulary, end_id: int) -> bytes:
    """Dictionary bytes; empty when there is too little to learn from. One task trains on TRAIN_DOCS documents at most."""
    few = docs.where("length(text) > 0").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(TRAIN_DOCS).select("text")

    def train(batches):
        import zstandard

        enc, pieces = encoder(vocabulary.value), []
        for b in batches:
            for raw in enc.encode(b["text"].tolist()):
                raw += np.array([end_id], enc.type).tobytes()
                step = TRAIN_IDS * enc.type.itemsize
                pieces += [raw[i : i + step] for i in range(0, len(raw), step)]
        try:
            d = zstandard.train_dictionary(DICT_BYTES, pieces[: TRAIN_DOCS * 8]).as_bytes() if len(pieces) >= 20 else b""
        except zstandard.ZstdError:
            d = b""
        yield pd.DataFrame({"d": [d]})

    got = [bytes(r.d) for r in few.coalesce(1).mapInPandas(train, "d binary").collect()]
    return got[0] if got else b""


def write(docs: DataFrame, vocabulary_path: str, out_uri: str, end_id: int = 0) -> DataFrame:
    """Write files below out_uri; returns the manifest (uri, first_id, n_docs, n_tokens, n_bytes, dict_sha256), a staged table."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = spark.sparkContext.broadcast(_vocabulary(vocabulary_path))
    dictionary = train_dictionary(docs, vocabulary, end_id)
    digest = hashlib.sha256(dictionary).digest()
    put_file(f"{out_uri}/{digest.hex()}.dict", dictionary)

    def files(batches):
        import zstandard

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([close() | {"part": n_file}], MANIFEST)

        enc = encoder(vocabulary.value)
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        end = np.array([end_id], enc.type).tobytes()
        blobs, rows, at = [], [], HEAD_BYTES

        def close():
            body = b"".join([struct.pack(HEAD, MAGIC, enc.type.itemsize, len(rows), digest, at), *blobs, *(struct.pack(ROW, *r) for r in rows)])
            uri = f"{out_uri}/{hashlib.sha256(body).hexdigest()}.tok"
            put_file(uri, body)
            return {"uri": uri, "first_id": rows[0][0], "n_docs": len(rows), "n_tokens": sum(r[3] for r in rows), "n_bytes": len(body), "dict_sha256": digest.hex()}

        n_file = 0
        for b in batches:
            for k, to in pages(pc.utf8_length(b.column("text")).to_numpy(zero_copy_only=False)):
                p = b.slice(k, to - k)
                for i, raw in zip(p.column("doc_id").fill_null(NO_ID).to_pylist(), enc.encode(p.column("text").to_pylist()), strict=True):
                    raw += end
                    c = z.compress(raw)
                    blobs.append(c)
                    rows.append((i, at, len(c), len(raw) // enc.type.itemsize))
                    at += len(c)
                    if at > FILE_BYTES:
                        yield told()
                        blobs, rows, at, n_file = [], [], HEAD_BYTES, n_file + 1
        if rows:
            yield told()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = ordered.mapInArrow(tidied(files), "uri string, first_id long, n_docs long, n_tokens long, n_bytes long, dict_sha256 string, part int")
    return staged(made.withColumn("pid", F.spark_partition_id()), "manifest")


def _rows(body: bytes):
    magic, width, n, digest, index = struct.unpack_from(HEAD, body)
    if magic != MAGIC:
        raise ValueError("not a token file")
    return width, digest, [struct.unpack_from(ROW, body, index + ROW_BYTES * i) for i in range(n)]


def read(manifest: DataFrame, out_uri: str) -> DataFrame:
    """(doc_id, start, ids as little-endian bytes, width) of every document of the files; start counts the ids before it."""
    order = Window.orderBy("pid", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    listed = manifest.select("uri", "pid", "part", "dict_sha256", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    spread = listed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uri")

    def load(batches):
        import zstandard

        known: dict[str, zstandard.ZstdDecompressor] = {}
        for b in batches:
            for uri, name, before in zip(*(b.column(c).to_pylist() for c in ("uri", "dict_sha256", "before")), strict=True):
                body = get_file(uri)
                width, digest, rows = _rows(body)
                if digest.hex() != name:
                    raise ValueError(f"{uri} was written with another dictionary")
                if name not in known:
                    d = get_file(f"{out_uri}/{name}.dict")
                    if hashlib.sha256(d).hexdigest() != name:
                        raise ValueError(f"dictionary {name} is damaged")
                    known[name] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None)
                for k in range(0, len(rows), 256):
                    part, start, ids = rows[k : k + 256], [], []
                    for _, at, size, n in part:
                        start.append(before)
                        ids.append(known[name].decompress(body[at : at + size]))
                        before += n
                    doc = pa.array([None if r[0] == NO_ID else r[0] for r in part], pa.int64())
                    yield pa.record_batch([doc, pa.array(start, pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * len(part), pa.int32())], names=["doc_id", "start", "ids", "width"])

    return spread.mapInArrow(load, "doc_id long, start long, ids binary, width int")


def read_one(uri: str, dict_uri: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document: reads the header, the index and the document's own bytes."""
    import zstandard

    _, width, n, digest, index = struct.unpack(HEAD, get_file(uri, 0, HEAD_BYTES))
    raw = get_file(uri, index, n * ROW_BYTES)
    ids = np.frombuffer(raw, np.dtype([("id", "<i8"), ("at", "<u8"), ("len", "<u4"), ("n", "<u8")]))
    k = int(np.searchsorted(ids["id"], doc_id))
    if k == n or ids["id"][k] != doc_id:
        return None
    d = get_file(f"{dict_uri}/{digest.hex()}.dict")
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None)
    return np.frombuffer(z.decompress(get_file(uri, int(ids["at"][k]), int(ids["len"][k]))), f"<u{width}").astype(np.uint32)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    from zlib import crc32

    import public_tokenizers

    out = new_dir(spark, "tokens")
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), out)

    @F.pandas_udf("long")
    def crc(ids: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(ids, width, strict=True)], dtype="int64")

    got = read(manifest, out)
    return got.select("doc_id", "start", (F.octet_length("ids") / F.col("width")).cast("long").alias("n_tokens"), crc("ids", "width").alias("ids_crc32"))
