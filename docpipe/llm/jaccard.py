"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its distinct ``n``-word shingles (fewer words: the whole sequence as one; none:
empty). Links are pairs of sets whose Jaccard similarity reaches the threshold; a component is what links connect.

1. Sets are computed where the text is read, a batch of texts at a time. Equal sets are collapsed by a fingerprint.
2. Tokens are ordered rare before frequent, then by hash. The frequent ones (the ``MOST_FREQUENT`` most frequent of
   those in at least ``FREQUENT`` sets' leading tokens) are few and broadcast; classes steer the work, not the result.
3. With p = n - ceil(t n) + 1, a pair that links shares at least one of its first p tokens while these are rare. Where
   rare ones do not suffice, the prefix is extended and frequent tokens, dealt into sub-classes, are indexed as
   two-token combinations: of s + 1 common leading tokens in s sub-classes two fall together. Any link then shares a
   rare token or a combination. A set whose leading tokens are all rare must share several (``must_share``).
4. Keys with the same sets under them are kept once. Under a key of at most ``FREQUENT`` sets all pairs of like sizes are
   counted, and those that share enough go on; under a larger one each set is paired with the smallest.
5. A set carries a bitmap of token parities: bits that differ between two bitmaps are tokens the sets don't share, which
   bounds the overlap from above. What passes is verified on whole texts: each set's closest candidate first, then the
   candidates that links leave in different components.
6. Under a larger key that still holds several components, the sets outside its largest one are compared with all others
   by bitmap, in blocks of ``BLOCK`` by ``BLOCK``: first only pairs that span a block's components, closest ones first, are
   verified, then all that remain between components. No link between components is lost, and no key meets in one task.

Cases: null and empty texts have the empty set and link with nothing (component_id is their own doc_id); a doc_id on
several rows keeps its rows, and those with words share a component; rows with null doc_id are left out of links and are
returned with null component_id; empty tables give empty results; extra columns are dropped.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, staged, tidied

FREQUENT, MOST_FREQUENT, BLOCK = 12, 1 << 18, 1024
#: Bytes of text that are hashed at once.
PIECE = 1 << 18
_HALF = 1 << 62
U = np.uint64
ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


#: A 64-bit number for every byte, the same for a letter in either case; and the bytes that part words.
_BYTE = _mix(np.arange(1, 257, dtype=U) * U(ODD))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up, down = np.full(size, ODD, U), np.full(size, pow(ODD, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a string column (null: none), and where each text's begin, with the end.

    A word's hash is a polynomial of its bytes, read off running sums over a piece of text; pieces end between words.
    """
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(off) else np.zeros(0, np.uint8)
    off = off - off[0] if len(off) else np.zeros(1, np.int64)
    ink = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = cut[-1] = True
    begins = ink & cut[:-1]
    begins[1:] |= ink[1:] & ~ink[:-1]
    ends = ink & cut[1:]
    ends[:-1] |= ink[:-1] & ~ink[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out, k = np.empty(len(first), U), 0
    while k < len(first):
        stop = max(k + 1, int(np.searchsorted(last, first[k] + PIECE, "right")))
        a, b = first[k], last[stop - 1]
        up, down = _powers(1 << max(16, int(b - a).bit_length()))
        run = np.zeros(b - a + 1, U)
        np.cumsum(_BYTE[buf[a:b]] * up[: b - a], out=run[1:])
        x, y = first[k:stop] - a, last[k:stop] - a
        out[k:stop] = _mix((run[y] - run[x]) * down[x] + (y - x).astype(U))
        k = stop
    return out, np.searchsorted(first, off)


def shingle_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 62-bit hashes of each text's n-word shingles, one text after the other, and where each begins, with the end."""
    w, at = word_hashes(col)
    size = np.diff(at)
    many = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    bound = np.concatenate([[0], np.cumsum(many)])
    s = np.empty(bound[-1], np.int64)
    acc = np.full(max(0, len(w) - n + 1), n, U)
    for j in range(n):
        acc = acc * U(ODD) + w[j : len(w) - n + 1 + j]
    acc = (_mix(acc) >> U(2)).astype(np.int64)
    for i in np.flatnonzero(many):
        if size[i] >= n:
            s[bound[i] : bound[i + 1]] = np.sort(acc[at[i] : at[i] + many[i]])
        else:
            one = np.array([size[i]], U)
            for y in w[at[i] : at[i + 1]]:
                one = one * U(ODD) + y
            s[bound[i]] = (_mix(one) >> U(2)).astype(np.int64)[0]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[bound[:-1][many > 0]] = True
    return s[new], np.concatenate([[0], np.cumsum(new)])[bound]


def least(n: int, pct: int) -> int:
    """Tokens that a set of n must share with any set it links with."""
    return -(-n * pct // 100)


def prefix(n: int, pct: int) -> int:
    return n - least(n, pct) + 1


def subclasses(band: int, pct: int) -> int:
    return max(1, prefix(1 << max(band - 1, 0), pct) // 4)


@lru_cache(maxsize=1 << 16)
def bands(n: int, pct: int) -> tuple[tuple[int, int], ...]:
    """(band, sub-classes): the size's own band, and the one below if a partner may lie there."""
    own = n.bit_length()
    return tuple((b, subclasses(b, pct)) for b in (own, own - 1) if b == own or least(n, pct) < 1 << (own - 1))


@lru_cache(maxsize=1 << 16)
def lead(n: int, pct: int) -> int:
    """Leading tokens that are kept; none where no larger set can link, so that only equal sets do."""
    return min(n, prefix(n, pct) + max(j for _, j in bands(n, pct))) if n * (100 - pct) >= pct else 0


def combinations(pre: np.ndarray, n: int, pct: int) -> np.ndarray:
    """Index keys of one set: single rare tokens, or these and pairs of frequent tokens of a sub-class."""
    rare = pre[pre < _HALF]
    if len(rare) >= prefix(n, pct):
        return rare
    out, freq = [rare], pre[len(rare) :].astype(U)
    for band, subs in bands(n, pct):
        cls = (_mix(freq) % U(subs)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        for g in np.split(freq[order], np.flatnonzero(np.diff(cls[order])) + 1):
            i, j = np.triu_indices(len(g), 1)
            out.append((_mix(g[i] * U(ODD) + g[j] * U(0xC2B2AE3D27D4EB4F) + U(band)) >> U(1)).astype(np.int64))
    return np.unique(np.concatenate(out))


def must_share(pre: np.ndarray, n: int, pct: int) -> int:
    """Keys that a set shares at least with any partner. If all its leading tokens are rare: one more than the sub-classes
    of the smaller of the two, for so many of the first common tokens stand among the leading ones of both."""
    if not len(pre) or pre[-1] >= _HALF:
        return 1
    return min(len(pre) - prefix(n, pct), *(j for _, j in bands(n, pct))) + 1


def needed(a, b, pct: int):
    """Smallest overlap at which sets of a and b tokens link."""
    return -(-pct * (a + b) // (100 + pct))


def parities(s: np.ndarray) -> bytes:
    """Whether an even or odd number of tokens falls on each of 2 to 4 bits a token (64 at least); halves of it fold by XOR."""
    m = 1 << max(6, int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & (m - 1), minlength=m).astype(np.uint8) & 1).tobytes()


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps brought to width bytes."""
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits by which rows of x and of y, of one width, differ; y may be one row more dimension."""
    return np.bitwise_count(np.ascontiguousarray(x).view(U) ^ np.ascontiguousarray(y).view(U)).sum(-1, dtype=np.int64)


def may_link(nx, ny, d, pct: int):
    """Whether sets of nx and ny tokens may link that differ in d or more."""
    return (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * pct) & ((nx + ny - d) // 2 >= needed(nx, ny, pct))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _bitmap_rows(col: pa.Array):
    """(width, places, matrix) for each width of bitmaps that occurs."""
    raw = col.to_pylist()
    width = np.fromiter(map(len, raw), np.int64, len(raw))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        yield int(w), at, np.frombuffer(b"".join([raw[i] for i in at]), np.uint8).reshape(len(at), w)


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")


def _leading_counts(docs: DataFrame, n: int, pct: int) -> DataFrame:
    """(t, c): in how many sets' leading tokens, in hash order, each token stands."""

    def run(batches):
        for b in batches:
            s, at = shingle_sets(_column(b, "text"), n)
            t = np.concatenate([s[:0], *(s[a : a + lead(int(m), pct)] for a, m in zip(at, np.diff(at)))])
            t, c = np.unique(t, return_counts=True)
            yield pa.record_batch({"t": t, "c": c})

    return docs.select("text").mapInArrow(tidied(run), "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))


def _sets(docs: DataFrame, n: int, pct: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, th, n, f1, f2, pre, bits) of every row: set size, fingerprint, leading tokens and bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often = sent.value
        for b in batches:
            s, at = shingle_sets(_column(b, "text"), n)
            size = np.diff(at)
            ranked = s + _HALF * (often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s) if len(often) else s
            m = _mix(s.astype(U) + U(1))
            full, f1, f2 = np.flatnonzero(size), np.zeros(len(size), U), np.zeros(len(size), U)
            f1[full], f2[full] = np.add.reduceat(m, at[full]) if len(full) else 0, np.bitwise_xor.reduceat(_mix(m), at[full]) if len(full) else 0
            pre, bits = [], []
            for a, k in zip(at, size.tolist()):
                keep = lead(k, pct) if k else 0
                pre.append(np.sort(ranked[a : a + k])[:keep] if keep else s[:0])
                bits.append(parities(s[a : a + k]) if keep else b"")
            yield pa.record_batch({
                "doc_id": _column(b, "doc_id"), "th": _column(b, "th"), "n": size, "f1": f1.astype(np.int64), "f2": f2.astype(np.int64),
                "pre": pa.array(pre, pa.list_(pa.int64())), "bits": pa.array(bits, pa.binary()),
            })

    return docs.select("doc_id", text_hash(), "text").mapInArrow(tidied(run), "doc_id long, th long, n long, f1 long, f2 long, pre array<long>, bits binary")


def _index(heads: DataFrame, pct: int) -> DataFrame:
    """(key, rid, n, need) of every set that can link with a larger or smaller one."""

    def run(batches):
        for b in batches:
            size = _column(b, "n").to_numpy()
            pre = [np.asarray(p.values) for p in _column(b, "pre")]
            keys = [combinations(p, int(m), pct) for p, m in zip(pre, size)]
            many = [len(k) for k in keys]
            need = np.array([must_share(p, int(m), pct) for p, m in zip(pre, size)], np.int32)
            yield pa.record_batch({
                "key": np.concatenate([np.zeros(0, np.int64), *keys]), "rid": np.repeat(_column(b, "rid").to_numpy(), many),
                "n": np.repeat(size.astype(np.int32), many), "need": np.repeat(need, many),
            })

    return heads.where("size(pre) > 0").select("rid", "n", "pre").mapInArrow(tidied(run), "key long, rid long, n int, need int")


def _shared(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("rid", "n")).alias("hub"), F.bit_xor(F.xxhash64("rid")).alias("sig")).where("c > 1")


def _like(a: str, b: str, pct: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * pct


def _small_pairs(rows: DataFrame, pct: int) -> DataFrame:
    """(a, b) of sets that share as many keys as they must, from keys of FREQUENT sets at most."""
    together = rows.groupBy("key").agg(F.first("times").alias("times"), F.sort_array(F.collect_list(F.struct("rid", "n", "need"))).alias("g"))
    pairs = F.expr(f"""flatten(transform(g, x -> transform(filter(g, y -> y.rid > x.rid AND least(x.n, y.n) * 100L >= greatest(x.n, y.n) * {pct}L),
        y -> struct(x.rid AS a, y.rid AS b, greatest(x.need, y.need) AS need))))""")
    got = together.select("times", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("times").alias("c"), F.max("p.need").alias("need"))
    return got.where("c >= need").select("a", "b")


def _bounded(pairs: DataFrame, heads: DataFrame, pct: int) -> DataFrame:
    """(a, b, d): the pairs that their bitmaps do not rule out, d the bits that differ."""
    x = heads.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = heads.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def run(batches):
        for t in batches:
            na, nb = _column(t, "na").to_numpy(), _column(t, "nb").to_numpy()
            d, left, right = np.full(len(na), 1 << 40), list(_bitmap_rows(_column(t, "xa"))), list(_bitmap_rows(_column(t, "xb")))
            for w, i, p in left:
                for v, j, q in right:
                    both, pi, qj = np.intersect1d(i, j, assume_unique=True, return_indices=True)
                    if len(both):
                        d[both] = apart(folded(p[pi], min(w, v)), folded(q[qj], min(w, v)))
            ok = may_link(na, nb, d, pct)
            yield pa.record_batch({"a": _column(t, "a").to_numpy()[ok], "b": _column(t, "b").to_numpy()[ok], "d": d[ok]})

    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(tidied(run), "a long, b long, d long")


def _verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, n: int, pct: int) -> DataFrame:
    """Staged (a, b): the pairs whose whole sets reach the threshold. Only the texts asked for are moved."""
    asked = staged(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "asked")
    who = staged(heads.select("rid", "doc_id", "th").join(asked, "rid"), "asked")
    text = docs.where("doc_id is not null").select("doc_id", text_hash(), "text").join(who, ["doc_id", "th"]).select("rid", "text")
    text = staged(text.dropDuplicates(["rid"]), "texts")
    both = pairs.join(text.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for t in batches:
            a, b = _column(t, "ta").dictionary_encode(), _column(t, "tb").dictionary_encode()
            (x, p), (y, q), ok = shingle_sets(a.dictionary, n), shingle_sets(b.dictionary, n), []
            for i, j in zip(a.indices.to_pylist(), b.indices.to_pylist(), strict=True):
                u, v = x[p[i] : p[i + 1]], y[q[j] : q[j + 1]]
                same = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * same >= pct * (len(u) + len(v) - same))
            ok = np.array(ok, bool)
            yield pa.record_batch({"a": _column(t, "a").to_numpy()[ok], "b": _column(t, "b").to_numpy()[ok]})

    return staged(both.select("a", "b", "ta", "tb").mapInArrow(tidied(run), "a long, b long"), "links")


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(end), F.col("component").alias(f"{end}c")), end, "left")
    return pairs.where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b")


def _mixed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Staged (key, rid, comp, main) of the keys whose sets lie in several components; main: in the key's largest one."""
    own = rows.join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("comp"))
    sizes = own.groupBy("key", "comp").agg(F.count("*").alias("m"))
    top = sizes.groupBy("key").agg(F.max(F.struct("m", "comp"))["comp"].alias("top"), F.sum("m").alias("c"), F.max("m").alias("m")).where("m < c")
    return staged(own.join(top, "key").select("key", "rid", "comp", (F.col("comp") == F.col("top")).alias("main"), "c", (F.col("c") - F.col("m")).alias("p")), "mixed")


def spanning(got: np.ndarray) -> np.ndarray:
    """Of rows (a, b, d, component of a, of b) those that connect the same components, the smallest d first: at most one less than there are."""
    got, kept = got[np.lexsort((got[:, 1], got[:, 0], got[:, 2]))], []
    name, label = np.unique(got[:, 3:], return_inverse=True)
    label, root = label.reshape(-1, 2), np.arange(len(name))
    while len(got):
        x = root[label]
        open_ = x[:, 0] != x[:, 1]
        got, label, x = got[open_], label[open_], x[open_]
        # each component's first row, then components that these rows connect
        _, first = np.unique(x.T.ravel(), return_index=True)
        for k in np.unique(first % max(1, len(got))):
            a, b = label[k]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append(got[k])
        while not np.array_equal(root, root[root]):
            root = root[root]
    return np.array(kept).reshape(-1, 5)


def _probed(mixed: DataFrame, heads: DataFrame, pct: int, closest: bool) -> DataFrame:
    """(a, b, d) of different components under one key that bitmaps do not rule out; closest: those that span a block."""
    rows = mixed.join(heads.select("rid", "n", "bits"), "rid")
    block = lambda m: F.ceil(F.col(m) / BLOCK) - 1
    every = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), block("p"))).alias("i"), F.pmod(F.xxhash64("rid"), block("c") + 1).alias("j"), F.lit(False).alias("probe"))
    probes = rows.where("not main").select("*", F.pmod(F.xxhash64("rid"), block("p") + 1).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), block("c"))).alias("j"), F.lit(True).alias("probe"))

    def compare(g: pa.Table) -> pa.Table:
        rid, comp, n, main = (g.column(c).to_numpy() for c in ("rid", "comp", "n", "main"))
        probe, out = g.column("probe").to_numpy(), [np.zeros((0, 5), np.int64)]
        kinds = list(_bitmap_rows(g.column("bits").combine_chunks()))
        for w, i, p in kinds:
            p, i = p[probe[i]], i[probe[i]]
            for v, j, q in kinds:
                q, j = q[~probe[j]], j[~probe[j]]
                if not len(i) or not len(j) or n[i].max() * 100 < n[j].min() * pct or n[j].max() * 100 < n[i].min() * pct:
                    continue
                left, right = folded(p, min(w, v)), folded(q, min(w, v))
                step = max(1, (1 << 22) // left.nbytes)
                for k in range(0, len(j), step):
                    at = j[k : k + step]
                    d = apart(left[:, None, :], right[None, k : k + step, :])
                    # of two probes the pair is told once
                    ok = may_link(n[i][:, None], n[at][None, :], d, pct) & (comp[i][:, None] != comp[at][None, :]) & (main[at][None, :] | (rid[i][:, None] < rid[at][None, :]))
                    x, y = np.nonzero(ok)
                    out.append(np.stack([rid[i[x]], rid[at[y]], d[x, y], comp[i[x]], comp[at[y]]], 1))
        got = np.concatenate(out)
        got = spanning(got) if closest else got
        return pa.table({"a": got[:, :2].min(1), "b": got[:, :2].max(1), "d": got[:, 2]}) if len(got) else pa.table({k: pa.array([], pa.int64()) for k in "abd"})

    both = every.unionByName(probes).select("key", "i", "j", "rid", "comp", "n", "main", "probe", "bits")
    return both.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, d long").groupBy("a", "b").agg(F.min("d").alias("d"))


def _settled(cand: DataFrame, links: DataFrame | None, verify) -> tuple[DataFrame, DataFrame]:
    """(links, components) after staged candidates (a, b, d): each set's closest first, then those still between components."""
    best = cand.groupBy("b").agg(F.min(F.struct("d", "a"))["a"].alias("a")).select("a", "b")
    found = verify(staged(best, "pairs"))
    links = found if links is None else links.unionByName(found)
    comp = components(links)
    rest = staged(_between(cand, comp), "pairs")
    if rest.isEmpty():
        return links, comp
    links = links.unionByName(verify(rest))
    return links, components(links)


def _set_components(docs: DataFrame, n: int, pct: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, heads, links): rows (doc_id, th, n, rid) of all documents with an id, rid the number of their set (null: empty
    set); heads, one row per set; links (a, b) between sets that connect all that any link connects."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often = staged(_leading_counts(docs, n, pct).where(F.col("c") >= FREQUENT), "counts")
    often = often.orderBy(F.desc("c"), "t").limit(MOST_FREQUENT).select("t").toPandas()["t"].to_numpy(np.int64)
    sets, ids = staged(_sets(docs, n, pct, np.sort(often)), "sets"), ["n", "f1", "f2"]
    heads = sets.where("n > 0").groupBy(*ids).agg(F.min_by(F.struct("doc_id", "th", "pre", "bits"), F.struct("doc_id", "th")).alias("h"))
    heads = staged(heads.select(F.monotonically_increasing_id().alias("rid"), *ids, "h.*"), "heads")
    rows = staged(sets.select("doc_id", "th", *ids).join(heads.select("rid", *ids), ids, "left").select("doc_id", "th", "n", "rid"), "rows")

    discard(sets)
    every = staged(_index(heads, pct), "index")
    shared = staged(every.join(_shared(every).select("key"), "key"), "keys")
    discard(every)
    able = shared.groupBy("rid").agg(F.count("*").alias("k"), F.max("need").alias("need")).where("k >= need").select("rid")
    index = staged(shared.join(able, "rid"), "keys")
    discard(shared)
    once = _shared(index).groupBy("c", "hub", "sig").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    keys = staged(index.join(once.drop("sig"), "key"), "keys")
    discard(index)
    large = keys.where(F.col("c") > FREQUENT)
    # a set under a large key may share less under small ones
    free = large.select("rid").distinct().withColumn("free", F.lit(True))
    small = keys.where(F.col("c") <= FREQUENT).join(free, "rid", "left").withColumn("need", F.when(F.col("free"), 1).otherwise(F.col("need")))
    star = large.where((F.col("rid") != F.col("hub.rid")) & _like("n", "hub.n", pct)).select(F.col("hub.rid").alias("a"), F.col("rid").alias("b"))
    pairs = staged(_small_pairs(small, pct).unionByName(star).distinct(), "pairs")

    def verify(found: DataFrame) -> DataFrame:
        return _verified(found, docs, heads, n, pct)

    links, comp = _settled(staged(_bounded(pairs, heads, pct), "close"), None, verify)
    for closest in (True, False):
        mixed = _mixed(large, comp)
        if mixed.isEmpty():
            break
        cand = staged(_probed(mixed, heads, pct, closest), "close")
        if cand.isEmpty():
            break
        links, comp = _settled(cand, links, verify)
    return rows, heads, links


def _row_components(docs: DataFrame, n: int, pct: int) -> DataFrame:
    """Staged (doc_id, th, n, comp) of all documents with an id: comp is a number of their component (null: empty set)."""
    rows, _, links = _set_components(docs, n, pct)
    # rows of one doc_id hang together
    several = rows.where("rid is not null").groupBy("doc_id").agg(F.min("rid").alias("a"), F.max("rid").alias("z")).where("a < z").select("doc_id", "a")
    ties = rows.join(several, "doc_id").where("rid is not null").select("a", F.col("rid").alias("b"))
    comp = components(links.unionByName(ties))
    return staged(rows.join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("doc_id", "th", "n", F.coalesce("component", "rid").alias("comp")), "components")


def near_copies(docs: DataFrame, n: int = 5, pct: int = 80) -> DataFrame:
    """Staged (doc_id, th) of every text but one of each component: the one of the smallest doc_id (then th) is not among
    them. A doc_id on different texts counts as that many documents; rows with null doc_id are left out."""
    rows, _, links = _set_components(docs, n, pct)
    rows = rows.where("rid is not null").select("doc_id", "th", "rid")
    rows = rows.join(components(links).withColumnRenamed("node", "rid"), "rid", "left").select("doc_id", "th", F.coalesce("component", "rid").alias("comp"))
    first = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("m")).where("m > 1")
    return staged(rows.join(first, "comp").where(F.struct("doc_id", "th") != F.col("first")).select("doc_id", "th").distinct(), "copies")


def jaccard_components(docs: DataFrame, n: int = 5, pct: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    rows = _row_components(docs, n, pct)
    least_id = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least_id"))
    known = rows.join(least_id, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least_id", "doc_id").alias("component_id"))

    def count(batches):
        for b in batches:
            size = np.diff(shingle_sets(_column(b, "text"), n)[1])
            yield pa.record_batch({"doc_id": pa.nulls(len(size), pa.int64()), "n_shingles": size, "component_id": pa.nulls(len(size), pa.int64())})

    lost = docs.where("doc_id is null").select("text").mapInArrow(count, "doc_id long, n_shingles long, component_id long")
    return known.unionByName(lost)


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, pct=90)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
