"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is normalised by the model, cut where no piece can reach across, and every different segment is merged once by
a score-ordered agenda of adjacent symbol pairs: the best-scored, then leftmost, pair whose join is a piece is merged, and
what is left is looked up, unknown symbols as UTF-8 bytes. Short segments of one length are the rows of a matrix and take
a step of their agendas together; long ones have a heap each, where stale pairs are skipped. New segments are checked
against the sentencepiece library in the Arrow batch where they first occur; a difference is an error. A task remembers
about ``REMEMBER`` segments, those of late use. Decoding is the library's own, over all ids of a text.

Cases: null and empty texts have no tokens and decode to the empty text; repeated rows are each encoded; an empty table
gives an empty result; extra columns are kept as they are unless they bear an output's name, which then replaces them.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pages, tidied

REMEMBER, SHORT, ROWS = 160_000, 48, 1 << 13
_MODELS: dict[str, "Pieces"] = {}


class Pieces:
    """One vocabulary in a Python worker, with the segments it has seen."""

    def __init__(self, model: bytes):
        import sentencepiece as spm

        self.sp = sp = spm.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.cost = {p: -sp.get_score(i) for p, i in self.id.items() if len(p) > 1}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.fallback = sp.is_byte(self.bytes[0])
        # texts are cut before blanks if the model puts one in front and no piece has one behind another symbol
        self.cuts = sp.normalize("a")[:1] == "▁" and not any(re.search("[^▁]▁", p) for p in self.id)
        self.cut = re.compile("▁+[^▁]*")
        self.sep = next(c for c in "\n\t\0\x01" if not any(c in p for p in self.id))  # merges with nothing
        self.names = [str(i) for i in range(n)]
        # symbols: pieces by id, then all characters that are none; a pair of symbols whose join is a piece has a rank and a piece
        self.n, self.symbols, self.piece = n, n + 0x110000, [sp.id_to_piece(i) for i in range(n)]
        self.of_char = np.arange(n, self.symbols, dtype=np.int32)
        self.type = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        for c, i in self.id.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        symbol = self.id | {c: n + ord(c) for c in set("".join(self.id)) - self.id.keys()}
        rank = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
        pairs = [(symbol[p[:k]] * self.symbols + symbol[p[k:]], rank[c], self.id[p]) for p, c in self.cost.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        pairs.sort()
        self.pair, self.rank, self.joined = (np.array([x[i] for x in pairs] or [0], kind) for i, kind in enumerate((np.int64, np.int32, np.int32)))
        self.never = len(rank) if pairs else 0
        lead = sp.encode(self.sep)
        self.lead, self.between = np.array(lead, self.type).tobytes(), np.array(sp.encode(self.sep + self.sep)[len(lead) :], self.type).tobytes()
        self.young: dict[str, bytes] = {}  # a segment's ids, serialised
        self.old: dict[str, bytes] = {}

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols and what it joins to; rank ``never``: nothing."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = self.pair[at] == key
        return np.where(there, self.rank[at], np.int32(self.never)), self.joined[at]

    def merge(self, segments: list[str]) -> list[bytes]:
        out = [b""] * len(segments)
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            by_length.setdefault(len(s), []).append(k)
        for length, every in by_length.items():
            if length > SHORT:
                for k in every:
                    out[k] = self.serial(self.ids(self.by_heap(segments[k])))
                continue
            for part in range(0, len(every), ROWS):
                where = every[part : part + ROWS]
                code = np.frombuffer("".join([segments[k] for k in where]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(where), length)
                for rows, got in self.by_matrix(self.of_char[code]):
                    odd, raw, wide = (got >= self.n).any(1), got.astype(self.type).tobytes(), got.shape[1] * self.type.itemsize
                    for j, k in enumerate(rows.tolist()):
                        out[where[k]] = raw[j * wide : (j + 1) * wide]
                    for k, sym in zip(rows[odd].tolist(), got[odd].tolist()):
                        out[where[k]] = self.serial(self.ids([self.piece[s] if s < self.n else chr(s - self.n) for s in sym]))
        return out

    def serial(self, ids: list[int]) -> bytes:
        return np.array(ids, self.type).tobytes()

    def by_matrix(self, sym: np.ndarray):
        """Rows of symbols of one length: in every step each row merges its best pair; yields (rows, their symbols) as they end."""
        row = np.arange(len(sym))
        rank, to = self._look(sym[:, :-1], sym[:, 1:])
        while len(row):
            if sym.shape[1] == 1:
                yield row, sym
                return
            i = rank.argmin(1)
            lines = np.arange(len(row))
            going = rank[lines, i] < self.never
            if not going.all():
                yield row[~going], sym[~going]
                row, sym, rank, to, i = row[going], sym[going], rank[going], to[going], i[going]
                lines = np.arange(len(row))
                if not len(row):
                    return
            sym[lines, i] = to[lines, i]
            # symbol i + 1 and pair i go; the pairs on both sides of the new symbol are looked up
            col = np.arange(sym.shape[1] - 1)
            sym = np.take_along_axis(sym, col + (col > i[:, None]), 1)
            col = col[:-1]
            step = col + (col >= i[:, None])
            rank, to = np.take_along_axis(rank, step, 1), np.take_along_axis(to, step, 1)
            for side in (i - 1, i):
                ok = np.flatnonzero((side >= 0) & (side < sym.shape[1] - 1))
                k = side[ok]
                rank[ok, k], to[ok, k] = self._look(sym[ok, k], sym[ok, k + 1])

    def by_heap(self, text: str) -> list[str]:
        """A long agenda is a heap; pairs whose symbols have changed are skipped."""
        sym, get = list(text), self.cost.get
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(v, i, i + 1, p) for i in range(n - 1) if (v := get(p := text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, p = heappop(agenda)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != len(p):
                continue
            sym[i], sym[j] = p, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (v := get(q := p + sym[k])) is not None:
                    heappush(agenda, (v, i, k, q))
            if (h := before[i]) >= 0 and (v := get(q := sym[h] + p)) is not None:
                heappush(agenda, (v, h, i, q))
        return [s for s in sym if s]

    def ids(self, sym: list[str]) -> list[int]:
        out: list[int] = []
        for s in sym:
            if (i := self.id.get(s)) is not None:
                out.append(i)
            elif self.fallback:
                out.extend(self.bytes[b] for b in s.encode("utf-8"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        """What the text is cut into, each without the blank that leads it."""
        norm = self.sp.normalize(text) if text else ""
        if not norm or not self.cuts:
            return [norm] if norm else []
        return norm.split("▁")[1:] if "▁▁" not in norm else [s[1:] for s in self.cut.findall(norm)]

    def whole(self, segment: str) -> str:
        return "▁" + segment if self.cuts else segment

    def learn(self, wanted: set[str]) -> None:
        """Merge segments not seen before and check them against the library."""
        if len(self.young) > REMEMBER // 2:
            self.young, self.old = {}, self.young
        new = []
        for s in filterfalse(self.young.__contains__, wanted):
            if s in self.old:
                self.young[s] = self.old[s]
            else:
                new.append(s)
        made = self.merge([self.whole(s) for s in new])
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            want = b"".join([self.lead, *(i + self.between for i in made[at : at + 2000])])
            if self.serial(self.sp.encode(self.sep.join(["", *map(self.whole, part), ""]).replace("▁", " "), num_threads=1)) != want:
                raise ValueError(f"agenda and library differ in one of {part}")
        self.young.update(zip(new, made, strict=True))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """The ids of each text, and these in decimal with commas."""
        cut = [self.segments(t or "") for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        of, name = self.young.__getitem__, self.names.__getitem__
        ids = [np.frombuffer(b"".join(map(of, c)), self.type).tolist() for c in cut]
        return [(i, ",".join(map(name, i))) for i in ids]


def pieces(key: str, model: bytes) -> Pieces:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Pieces(model)
    return _MODELS[key]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", digests: bool = False, keep_ids: bool = True) -> DataFrame:
    """docs without text, plus n_tokens, ids (if keep_ids), and with digests ids_sha256 and decoded_sha256."""
    with open(model_path, "rb") as f:  # a vocabulary file of the installation, some hundred kB
        model = f.read()
    key = hashlib.sha256(model).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made = {"n_tokens": "long"} | ({"ids": "array<int>"} if keep_ids else {}) | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})
    others = [c for c in docs.columns if c.lower() not in {text_col.lower(), *made}]

    held = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has

    def run(batches):
        pc = pieces(key, sent.value)
        try:
            for b in batches:
                for at, to in pages(b[held].str.len().to_numpy(), 1 << 19):
                    p = b.iloc[at:to]
                    got = pc.encode(p[held].tolist())
                    cols = {c: p[c] for c in others}
                    cols["n_tokens"] = [len(i) for i, _ in got]
                    if keep_ids:
                        cols["ids"] = [i for i, _ in got]
                    if digests:
                        cols["ids_sha256"] = [hashlib.sha256(s.encode()).hexdigest() for _, s in got]
                        cols["decoded_sha256"] = [hashlib.sha256((pc.sp.decode(i) if i else "").encode("utf-8")).hexdigest() for i, _ in got]
                    yield pd.DataFrame(cols)
        finally:
            pc.young, pc.old = {}, {}  # the worker lives on, for tasks of other stages too

    given = docs.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(held))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"{k} {v}" for k, v in made.items()])
    return given.mapInPandas(tidied(run), schema)


def decode(ids: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """ids plus a column text: the library's decoding of each row's ids (null: empty)."""
    with open(model_path, "rb") as f:
        model = f.read()
    key, sent = hashlib.sha256(model).hexdigest(), ids.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(col: pd.Series) -> pd.Series:
        sp = pieces(key, sent.value).sp
        return pd.Series([sp.decode([int(i) for i in x]) if x is not None and len(x) else "" for x in col], dtype=object)

    return ids.withColumn("text", text(F.col(f"`{ids_col}`")))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True, keep_ids=False)
