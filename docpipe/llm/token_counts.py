"""Token counts of whole texts, as the libraries give them for a vocabulary file (sentencepiece for .model, tokenizers for .json).

A huge text (more than ``HUGE`` characters) is no single call: it is cut into chunks of ``SIZE`` characters that overlap, which
any task may encode with offsets. Two neighbours are spliced at the first boundary in their overlap that both encodings have and
that is proven stable; tokens before it count for the left chunk, those behind it for the right one. Where an overlap holds no
such boundary, it is widened, to one whole chunk, to three, to seven, until it does or the text ends. A boundary is proven stable
by the vocabulary: a merge makes pieces only, so no merge reaches over two neighbouring characters that no piece holds side by
side, whatever stands around them. For byte-level pre-tokenizers it is proven between a letter, digit or mark and a blank, which
no alternative of their pattern spans. Vocabularies without a proof (other model types, normalizers with a character map,
user-defined pieces, other pre-tokenizers) have every text encoded whole.

Texts that are not huge go to the library. Where a blank behind another character is proven stable for the whole vocabulary, a
text is the sum of what its blank-led words count, and a worker asks the library once for a word it remembers.

Cases: null and empty texts have no tokens; special strings in a text are handled as is the library's default; repeated rows and
rows without a doc_id are each counted; an empty table gives an empty result; extra columns are kept as they are unless they
bear an output's name, which then replaces them.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pages, staged, tidied

HUGE, SIZE, OVERLAP = 1 << 16, 1 << 15, 256
REMEMBER = 400_000  # words whose counts a worker remembers, some 60 MB
_COUNTERS: dict[str, "Pieces | Bytes"] = {}


def _fields(message: bytes):
    """(number, value) of a serialised message of integers, four or eight bytes, and strings."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out, shift = out | (b & 127) << shift, shift + 7
            if b < 128:
                return out

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, message[at : at + n]
            at += n


class Pieces:
    """A sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece as spm

        self.sp = spm.SentencePieceProcessor(model_proto=model)
        parts = list(_fields(model))
        pieces = [dict(_fields(v)) for k, v in parts if k == 1]
        trainer, normalizer = (dict(x for k, v in parts if k == n for x in _fields(v)) for n in (2, 3))
        # fixed values of the format: types of pieces 1 normal, 4 user-defined, 5 unused, 6 byte; model type 2 merges
        kinds = [p.get(3, 1) for p in pieces]
        plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        self.proven = trainer.get(3) == 2 and bool(plain) and not {4, 5} & set(kinds) and 6 in kinds
        words = [p[1].decode() for p, kind in zip(pieces, kinds, strict=True) if kind == 1]
        self.together = {w[i : i + 2] for w in words for i in range(len(w) - 1)}
        self.by_word = self.proven and not any(re.search("[^▁]▁", w) for w in words)
        self.cut = re.compile("(?<=[^ ▁])(?= )")
        self.blank = len(self.sp.encode("a ")) - len(self.sp.encode("a"))
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def stable(self, text: str, at: int) -> int | None:
        """The first proven boundary behind ``at``."""
        shown = text.replace(" ", "▁")
        return next((p for p in range(at + 1, len(text)) if shown[p - 1 : p + 1] not in self.together), None)

    def starts(self, text: str) -> tuple[np.ndarray, callable]:
        """Where tokens start, and the same measure for a position of the text."""
        got = self.sp.encode(text, return_type="proto")
        return np.array([p.begin for p in got.pieces], np.int64), lambda p: len(text[:p].encode())

    def segments(self, text: str) -> tuple[str, list[str]]:
        """The text up to its first cut, then what follows cuts, without the blank that leads each."""
        if "▁" in text or "  " in text or text[:1] == " ":
            first, *rest = self.cut.split(text)
            return first, [s[1:] for s in rest]
        first, *rest = text.split(" ")
        return first, rest

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(i) for i in self.sp.encode(texts, num_threads=1)]
        cut = [self.segments(t) for t in texts]
        if len(self.young) > REMEMBER // 2:
            self.young, self.old = {}, self.young
        new = set(chain.from_iterable(rest for _, rest in cut)).union(first for first, _ in cut).difference(self.young)
        known = {s: self.old[s] for s in new if s in self.old}
        ask = [s for s in new if s not in known]
        self.young |= known | dict(zip(ask, map(len, self.sp.encode(ask, num_threads=1)), strict=True))
        of = self.young.__getitem__
        return [(of(first) if first else 0) + sum(map(of, rest)) + self.blank * rest.count("") for first, rest in cut]


class Bytes:
    """A tokenizers file."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        told = json.loads(model)
        self.tokenizer, pre = Tokenizer.from_str(model.decode()), told.get("pre_tokenizer") or {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = told.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer")
        self.proven = bool(plain) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added)
        self.before_blank = re.compile(r"(?<=[!-~\w])(?= )")

    def stable(self, text: str, at: int) -> int | None:
        found = self.before_blank.search(text, at + 1)
        return found.start() if found else None

    def starts(self, text: str) -> tuple[np.ndarray, callable]:
        return np.array([a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets], np.int64), lambda p: p

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def counter(key: str, model: bytes) -> Pieces | Bytes:
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = (Bytes if key.endswith(".json") else Pieces)(model)
    return _COUNTERS[key]


def spliced(c: Pieces | Bytes, text: str, body: int, first: bool, last: bool) -> tuple[int | None, int | None, int]:
    """(head, tail, n) of a chunk: where its tokens begin and end to count, and how many these are. ``body`` characters lie before
    the next chunk. head None: no boundary, another chunk counts what is here. tail None: the overlap must be widened."""
    starts, measure = c.starts(text)
    there = set(starts.tolist())

    def boundary(behind: int) -> int | None:
        p = c.stable(text, behind)
        while p is not None and measure(p) not in there:
            p = c.stable(text, p)
        return p

    head = 0 if first else boundary(0)
    if head is None:
        return None, None, 0
    tail = boundary(body)
    if tail is None and not last:
        return head, None, 0
    tail = len(text) if tail is None else tail
    return head, tail, int(((starts >= measure(head)) & (starts < measure(tail))).sum()) if tail > head else 0


def _huge_counts(huge: DataFrame, others: list[str], text: str, key: str, sent, size: int, overlap: int) -> DataFrame:
    """others, n_bytes and n_tokens of texts that are each cut into chunks."""
    spark = huge.sparkSession
    row = huge.select(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(others)], F.octet_length(f"`{text}`").cast("long").alias("n_bytes"), F.col(f"`{text}`").alias("text"))
    row = row.withColumn("doc", F.monotonically_increasing_id())
    kept = [f"o{i}" for i in range(len(others))]

    def cut(batches):
        for b in batches:
            for i in range(len(b)):
                whole = b.column("text")[i].as_py()
                every = range(0, len(whole), size)
                for k, at in enumerate(every):
                    one = b.slice(i, 1)
                    cols = {c: one.column(c) if not k else pa.nulls(1, one.schema.field(c).type) for c in (*kept, "n_bytes")}
                    cols |= {"doc": one.column("doc"), "k": pa.array([k], pa.int32()), "last": pa.array([at + size >= len(whole)]), "text": pa.array([whole[at : at + size + overlap]])}
                    yield pa.record_batch(cols)

    schema = ", ".join([*(f"{c} {row.schema[c].dataType.simpleString()}" for c in kept), "n_bytes long, doc long, k int, last boolean, text string"])
    # written once: numbers of documents stay as they are, and chunks are dealt to tasks by number and place
    chunks = staged(row.mapInArrow(cut, schema).repartition("doc", "k"), "chunks")

    told_schema = pa.schema([("doc", pa.int64()), ("k", pa.int32()), ("head", pa.int64()), ("tail", pa.int64()), ("n", pa.int64()), ("last", pa.bool_())])

    def splice(batches):
        c = counter(key, sent.value)
        for b in batches:
            out = []
            for doc, k, parts in zip(*(b.column(n).to_pylist() for n in ("doc", "k", "parts")), strict=True):
                parts.sort(key=lambda p: p["j"])
                window = "".join([*(p["text"][:size] for p in parts[:-1]), parts[-1]["text"]])
                head, tail, n = spliced(c, window, size, k == 0, parts[-1]["last"])
                head, tail = (None if p is None else k * size + p for p in (head, tail))
                out.append({"doc": doc, "k": k, "head": head, "tail": tail, "n": n, "last": parts[-1]["last"]})
            yield pa.RecordBatch.from_pylist(out, told_schema)

    def told(windows: DataFrame) -> DataFrame:
        return staged(windows.mapInArrow(tidied(splice), "doc long, k int, head long, tail long, n long, last boolean"), "splices")

    part = F.struct(F.lit(0).alias("j"), "text", "last")
    now, done, more = told(chunks.select("doc", "k", F.array(part).alias("parts"))), None, 1
    while True:
        open_ = now.where("head is not null and tail is null")
        found = now.where("head is not null and tail is not null")
        done = found if done is None else done.unionByName(found)
        if open_.isEmpty():
            break
        # a window's own chunk and the ``more`` behind it; few windows are open, and what they hold is some text's characters
        wanted = open_.select("doc", F.col("k").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(more))).alias("j")).withColumn("k", F.col("of") + F.col("j"))
        wide = wanted.join(chunks.select("doc", "k", "text", "last"), ["doc", "k"]).groupBy("doc", "of").agg(F.collect_list(F.struct("j", "text", "last")).alias("parts"))
        now, more = told(wide.withColumnRenamed("of", "k")), 2 * more + 1
    # neighbours must meet: what counts of a chunk ends where what counts of the next one with any begins
    at = Window.partitionBy("doc").orderBy("k")
    meets = done.withColumn("next", F.lead("head").over(at)).withColumn("ok", F.coalesce(F.col("tail") == F.col("next"), F.col("last")))
    sums = meets.groupBy("doc").agg(F.sum("n").alias("n_tokens"), F.bool_and("ok").alias("ok"))
    whole = chunks.where("k = 0").join(sums, "doc").withColumn("n_tokens", F.when(F.col("ok"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("chunks of a text don't meet"))))
    return staged(whole.select(*[F.col(f"o{i}").alias(c) for i, c in enumerate(others)], "n_bytes", "n_tokens"), "huge")


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096, huge: int = HUGE, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs without text, plus n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``)."""
    with open(model_path, "rb") as f:  # a vocabulary file of the installation, a few MB
        model = f.read()
    key = hashlib.sha256(model).hexdigest() + (".json" if model_path.endswith(".json") else ".model")
    sent, proven = docs.sparkSession.sparkContext.broadcast(model), counter(key, model).proven
    others = [c for c in docs.columns if c.lower() not in {text_col.lower(), "n_bytes", "n_tokens", "over_limit"}]
    held = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has

    def run(batches):
        c = counter(key, sent.value)
        for b in batches:
            lengths = pc.utf8_length(b.column(held)).to_numpy(zero_copy_only=False)
            for at, to in pages(lengths, 1 << 20):
                p = b.slice(at, to - at)
                cols = {o: p.column(o) for o in others}
                cols["n_bytes"] = pc.binary_length(p.column(held)).cast(pa.int64())
                cols["n_tokens"] = pa.array(c.counts(p.column(held).to_pylist()), pa.int64())
                yield pa.record_batch(cols)

    given = docs.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(held))
    small = given.where(F.length(held) <= huge) if proven else given
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + ["n_bytes long, n_tokens long"])
    out = small.mapInArrow(tidied(run), schema)
    if proven:
        out = out.unionByName(_huge_counts(given.where(F.length(held) > huge), others, held, key, sent, size, overlap))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
