"""Embedding near-duplicates by a forest of random-projection trees.

Trees (``TREES``, more where they are deep) split vectors again and again by random directions at the median; the middle
``2 * SPILL`` of each node's vectors goes to both sides. Trees are fitted on at most ``SAMPLE`` vectors (smallest hashes) down to
nodes of ``SAMPLE_LEAF``; every vector is routed through all. Leaves with more than ``LEAF`` vectors are split on, by directions drawn
from the leaf's own number and quantiles that Spark computes, each for as long as it shrinks; a leaf that does not, or is left after
``ROUNDS``, is compared in blocks, so no leaf is one large group. Inside a leaf all cosines are computed, in single precision first and
those near the limit in double precision. Leaves are large, for a comparison there costs less than a vector's way to one leaf more.
Equal vectors are collapsed first. Vectors of other lengths than most have trees of their own, each of which begins with all of one length.

Splits would cut groups of near copies larger than a leaf, so these are taken out first, from the table and from each leaf before it is
split: a hashed probe gives pivots that link with at least a ``DENSE``-th of it (``CUT``: no fitted node with such a pivot is split). Rows
that link with a pivot are the core of a canopy, and rows within twice that angle its rim: whatever links with a core row is in the
canopy. A canopy is compared core with core and core with rim, and only rows that are in no core go on. No link is lost there.

A pair is counted in the first leaf that holds both (vectors carry their leaves), so no pair is ever emitted; a leaf sends
one row per vector: its counted links and the smallest vector it is connected with there. These give components. Vectors travel as
the bytes of their components, of four each where that loses nothing.

Recall against brute force is measured in the tests; every reported link is exact. Cases: vectors that are null, zero or
hold null or non-finite components link with nothing, vectors of different lengths not with each other; repeated rows of a vec_id count as vectors of their own;
null vec_ids link with nothing and have a null component; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged

TREES, SPILL, SAMPLE, SAMPLE_LEAF, LEAF, ROUNDS = 14, 0.06, 8192, 24, 6144, 48
#: Rows of a probe of the table and of a leaf; the share of a probe that a pivot links with, there and in a leaf or node.
PROBE, LEAF_PROBE, DENSE, CUT = 8192, 256, 256, 8
#: Cosines that a task holds at once.
TILE = 1 << 21


def depth_for(n: float) -> float:
    """Levels after which one of n vectors is left in a leaf."""
    return np.log(max(1.0, n)) / np.log(1 / (0.5 + SPILL))


def trees_for(n: int) -> int:
    """Trees for n vectors: a pair of cosine 0.9 shares a tree's leaf of depth d with probability exp(-0.0535 d) or so, as measured
    at depths 9 to 14; so many trees miss one pair of a thousand."""
    return max(TREES, int(np.ceil(np.log(1e-3) / np.log1p(-np.exp(-0.0535 * max(1.0, depth_for(2 * n / LEAF)))))))


@lru_cache(maxsize=32)
def directions(seed: int, depth: int, width: int) -> np.ndarray:
    """Of the nodes of a tree, in heap order."""
    return np.random.default_rng(seed).standard_normal((1 << depth, width), np.float32)


def pivots(x: np.ndarray, least: float, share: int) -> np.ndarray:
    """Rows of a probe that link with a ``share``-th of it or more, each counted without what links with those before it."""
    s, linked, out = x.astype(np.float32), np.empty((len(x), len(x)), bool), []
    for k in range(0, len(x), 512):
        np.greater_equal(s[k : k + 512] @ s.T, least, out=linked[k : k + 512])
    many = linked.sum(1)
    while len(x) and many.max() >= max(4, len(x) / share):
        out.append(int(many.argmax()))
        gone = linked[out[-1]].copy()
        many -= linked[:, gone].sum(1)
        many[gone] = 0
        linked[gone] = False
        linked[:, gone] = False
    return x[out]


def canopies(x: np.ndarray, p: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, core) of all canopies, and which rows are in no core; a row is in the core of one canopy at most."""
    cos = x @ p.T
    near = cos >= least
    first = np.where(near.any(1), near.argmax(1), -1)
    row, k = np.nonzero(near | (cos >= (2 * least * least - 1 - 1e-9 if least > 0 else -2)))
    used = np.isin(k, first)
    row, k = row[used], k[used]
    return row, k, first[row] == k, first < 0


def fit_tree(x: np.ndarray, depth: int, seed: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The two thresholds of each node in heap order, between which vectors go both ways; nan: leaf."""
    d, held = directions(seed, depth, x.shape[1]), {1: np.arange(len(x))}
    lo, hi = np.full((2, 1 << depth), np.nan, np.float32)
    for i in range(1, 1 << depth):
        at = held.pop(i, None)
        if at is None or len(at) < 2 * SAMPLE_LEAF or len(pivots(x[at[:LEAF_PROBE]], least, CUT)):
            continue
        v = x[at] @ d[i]
        lo[i], hi[i] = np.quantile(v, [0.5 - SPILL, 0.5 + SPILL])
        held[2 * i], held[2 * i + 1] = at[v <= hi[i]], at[v >= lo[i]]
    return lo, hi


def route(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for all leaves of one tree that rows come to, a level of the tree at a time."""
    row, at, done = np.arange(len(x)), np.ones(len(x), np.int64), []
    while len(row):
        inner = at < len(lo)
        inner[inner] = ~np.isnan(lo[at[inner]])
        done.append((row[~inner], at[~inner]))
        row, at = row[inner], at[inner]
        v = np.einsum("ij,ij->i", x[row], d[at])
        left, right = v <= hi[at], v >= lo[at]
        row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])
    return np.concatenate([r for r, _ in done] or [row]), np.concatenate([a for _, a in done] or [at])


def _unit(raw, w: int) -> np.ndarray:
    """Unit vectors of w components from a column of bytes."""
    wide, x = np.array([len(v) for v in raw], np.int64), np.empty((len(raw), w))
    for kind in (np.float32, np.float64):
        at = wide == w * np.dtype(kind).itemsize
        if at.any():
            x[at] = np.frombuffer(b"".join(v for v, k in zip(raw, at, strict=True) if k), kind).reshape(-1, w)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])  # exact, and no square is too large or small
    return x / np.sqrt((x * x).sum(1))[:, None]


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, w, raw) for each row of (vec_id, embedding): length and bytes of the vector, null where it links with nothing."""

    def run(batches):
        for b in batches:
            e = b.column("embedding")
            wide = pc.fill_null(pc.list_value_length(e), 0).to_numpy(zero_copy_only=False)
            v = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no null, and one zero
            with np.errstate(over="ignore"):
                single = v.astype(np.float32)
            at = np.repeat(np.arange(len(wide)), wide)
            some = lambda values: np.bincount(at[values], minlength=len(wide)) > 0  # noqa: E731, B023
            sound = some(v != 0) & ~some(~np.isfinite(v)) & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            short, ends = ~some(single != v), np.cumsum(wide)
            raw = [(single if h else v)[f - n : f].tobytes() if s else None for s, h, f, n in zip(sound, short, ends, wide, strict=True)]
            yield pa.record_batch({"vec_id": b.column("vec_id"), "w": pa.array(wide, pa.int32()), "raw": pa.array(raw, pa.binary())})

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, w int, raw binary")


def _split(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(vec_id, leaf, up) one level further down for rows (vec_id, leaf, count, w, raw), up the count of the leaf above, and the
    canopies (vec_id, leaf, core) taken out."""

    def probe(t: pa.Table) -> pa.Table:
        w = t.column("w")[0].as_py()
        found = pivots(_unit(t.column("raw").to_pylist(), w), least, CUT)
        return pa.table({"leaf": t.column("leaf").slice(0, min(1, len(found))), "p": pa.array([found.tobytes()] if len(found) else [], pa.binary())})

    def project(batches):
        for b in batches:
            ids, leaf, up, wide = (b.column(c).to_numpy() for c in ("vec_id", "leaf", "count", "w"))
            raw, order, made = b.column("raw").to_pylist(), np.argsort(leaf, kind="stable"), []
            for at in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(order) else []:
                one, w = int(leaf[at[0]]), int(wide[at[0]])
                x, rest, some = _unit([raw[i] for i in at], w), np.ones(len(at), bool), b.column("p")[int(at[0])].as_py()
                if some is not None:
                    row, k, core, rest = canopies(x, np.frombuffer(some).reshape(-1, w), least)
                    made.append((at[row], k, core, np.zeros(len(row))))
                v = x @ np.random.default_rng(one & ((1 << 63) - 1)).standard_normal(w)
                made.append((at[rest], np.full(rest.sum(), -1), np.ones(rest.sum(), bool), v[rest]))
            if made:
                at, k, core, v = (np.concatenate(c) for c in zip(*made, strict=True))
                yield pa.record_batch({"vec_id": ids[at], "leaf": leaf[at], "up": up[at], "k": k.astype(np.int32), "core": core, "v": v})

    seen = rows.where(F.pmod(F.xxhash64("vec_id", "leaf"), F.col("count")) < LEAF_PROBE).select("leaf", "w", "raw")
    found = staged(seen.groupBy("leaf").applyInArrow(probe, "leaf long, p binary"), "pivots")
    flat = rows.join(found, "leaf", "left").select("vec_id", "leaf", "count", "w", "raw", "p").sortWithinPartitions("leaf")
    flat = staged(flat.mapInArrow(project, "vec_id long, leaf long, up long, k int, core boolean, v double"), "projected")
    out = flat.where("k >= 0").select("vec_id", F.xxhash64("leaf", F.lit(-1) - F.col("k")).alias("leaf"), "core")
    flat = flat.where("k < 0")
    cut = flat.groupBy("leaf").agg(F.percentile_approx("v", F.array(F.lit(0.5 - SPILL), F.lit(0.5 + SPILL)), F.lit(2000)).alias("q"))
    both = flat.join(cut, "leaf").select("vec_id", "leaf", "up", F.explode(F.filter(F.array(F.when(F.col("v") <= F.col("q")[1], 0), F.when(F.col("v") >= F.col("q")[0], 1)), lambda s: s.isNotNull())).alias("s"))
    return both.select("vec_id", F.xxhash64("leaf", "s").alias("leaf"), "up"), out


def _shared(lists, before: int, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For pairs (r, q) of rows: how many numbers under ``before`` both rows' lists hold. By comparing the two lists, or by products
    of incidence columns where many pairs share few numbers."""
    m, value = len(lists), lists.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(m), lists.value_lengths().to_numpy(zero_copy_only=False))
    at, value = at[value < before], value[value < before]
    _, code, times = np.unique(value, return_inverse=True, return_counts=True)
    at, code = at[times[code] > 1], code[times[code] > 1]
    n, code = len(np.unique(code)), np.unique(code, return_inverse=True)[1]
    if not n:
        return np.zeros(len(r), np.int64)
    each = np.bincount(at, minlength=m)
    k, own = int(each.max()), np.flatnonzero(np.bincount(r, minlength=m))
    if 16 * len(r) * k * k > len(own) * m * n:
        total = np.zeros((len(own), m), np.float32)
        for c in range(0, n, 512):
            x, some = np.zeros((m, 512), np.float32), (code >= c) & (code < c + 512)
            x[at[some], code[some] - c] = 1
            total += x[own] @ x.T
        return total[np.searchsorted(own, r), q].astype(np.int64)
    held, out = np.full((m, k), -1, np.int32), np.empty(len(r), np.int64)
    held[at, np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)] = code
    other = np.where(held < 0, -2, held)
    for c in range(0, len(r), step := max(1, TILE // (k * k))):
        out[c : c + step] = (held[r[c : c + step], :, None] == other[q[c : c + step], None, :]).sum((1, 2))
    return out


def _joined(label: np.ndarray, r: np.ndarray, q: np.ndarray) -> None:
    """Bring label, the smallest row that each row is connected with, up to date with pairs (r, q)."""
    while len(r):
        a, b = label[r], label[q]
        apart = a != b
        r, q, a, b = r[apart], q[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _sample(vectors: DataFrame, most: int, width: int) -> np.ndarray:
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("raw").toPandas()
    return _unit(list(few["raw"]), width)


def _own_trees(others: DataFrame, trees: int) -> DataFrame:
    """(vec_id, leaf) of vectors of other lengths: one leaf for all of a length, or as many as there are trees if it must be split."""
    many = others.groupBy("w").count().select("w", F.when(F.col("count") > LEAF, trees).otherwise(1).alias("t"))
    each = others.join(many, "w").select("vec_id", F.explode(F.sequence(F.lit(1), "t")).alias("t"), "w")
    return each.select("vec_id", F.xxhash64("w", "t", F.lit(-2)).alias("leaf"))


def leaves_of(every: DataFrame, width: int, least: float) -> DataFrame:
    """(vec_id, leaf, core) from staged tables; a leaf number tells tree and node, or the canopy. width: the length of most vectors."""
    spark, kind = every.sparkSession, "vec_id long, leaf long, core boolean"
    vectors, others = every.where(F.col("w") == width), every.where(F.col("w") != width)
    x, parts = _sample(vectors, SAMPLE, width), []
    dense = pivots(x[:PROBE], least, DENSE)
    if len(dense):
        told = spark.sparkContext.broadcast(dense)

        def take(batches):
            for b in batches:
                ids = b.column("vec_id").to_numpy()
                row, k, core, rest = canopies(_unit(b.column("raw").to_pylist(), width), told.value, least)
                leaf = np.concatenate([k - (1 << 40), np.zeros(rest.sum(), np.int64)])
                yield pa.record_batch({"vec_id": np.concatenate([ids[row], ids[rest]]), "leaf": leaf, "core": np.concatenate([core, np.ones(rest.sum(), bool)])})

        taken = staged(vectors.select("vec_id", "raw").mapInArrow(take, kind), "canopies")
        parts.append(taken.where("leaf < 0"))
        vectors = staged(vectors.join(taken.where("leaf = 0").select("vec_id"), "vec_id", "left_semi"), "vectors")
        x = _sample(vectors, SAMPLE, width)
    n = vectors.count()
    trees = trees_for(n)
    deep = max(1, int(np.ceil(min(depth_for(len(x) / SAMPLE_LEAF), depth_for(n / (0.75 * LEAF))))))
    x = x.astype(np.float32)
    sent = spark.sparkContext.broadcast([fit_tree(x, deep, t, least) for t in range(trees)] if len(x) else [])

    def run(batches):
        for b in batches:
            x, ids = _unit(b.column("raw").to_pylist(), width).astype(np.float32), b.column("vec_id").to_numpy()
            for t, (lo, hi) in enumerate(sent.value):
                row, leaf = route(x, lo, hi, directions(t, deep, width))
                yield pa.record_batch({"vec_id": ids[row], "leaf": leaf + (t << 40)})

    held = vectors.select("vec_id", "raw").mapInArrow(run, "vec_id long, leaf long").unionByName(_own_trees(others, trees))
    held = staged(held.withColumn("up", F.lit(None).cast("long")), "leaves")
    whole = F.lit(True).alias("core")
    for _ in range(ROUNDS):
        sizes = held.groupBy("leaf").agg(F.count("*").alias("count"), F.max("up").alias("up"))
        big = staged(sizes.where((F.col("count") > LEAF) & (F.col("up").isNull() | (F.col("count") <= 0.95 * F.col("up")))).select("leaf", "count"), "bigleaves")
        if big.isEmpty():
            break
        parts.append(held.join(big, "leaf", "left_anti").select("vec_id", "leaf", whole))
        down, taken = _split(held.select("vec_id", "leaf").join(big, "leaf").join(every.select("vec_id", "w", "raw"), "vec_id"), least)
        parts.append(taken)
        held = staged(down, "leaves")
    done = held.select("vec_id", "leaf", whole)
    for part in parts:
        done = done.unionByName(part)
    return done


def forest_links(vectors: DataFrame, width: int, least: float) -> DataFrame:
    """(vec_id, links, root) rows from leaves: links counted there, and the smallest connected vec_id there. vectors: distinct
    vectors (vec_id, w, raw, copies)."""
    leaves = leaves_of(vectors, width, least)
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("count"), F.count_if("core").alias("cores")).where(F.col("count") > 2 * LEAF)
    sizes = sizes.select("leaf", F.ceil(F.col("cores") / (2 * LEAF)).alias("nc"), F.ceil((F.col("count") - F.col("cores")) / (2 * LEAF)).alias("nr"))
    # a few per tree; two rows of a rim only are not compared in that leaf
    # a vector goes out as often as it has leaves, so these rows are dealt by what they become
    parts = max(1, leaves.count() * (4 * width + 400) >> 27)
    mine = leaves.repartition(parts, "vec_id").groupBy("vec_id").agg(F.collect_list("leaf").alias("leaves"), F.collect_list(F.when(~F.col("core"), F.col("leaf"))).alias("rims"))
    full = vectors.select("vec_id", "w", "raw", "copies").join(mine, "vec_id")
    rows = full.select("*", F.explode("leaves").alias("leaf")).withColumn("core", ~F.array_contains("rims", F.col("leaf")))
    rows = rows.join(F.broadcast(sizes), "leaf", "left")
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.greatest(n, F.lit(1).cast("long")))
    rows = rows.withColumn("mine", F.when(F.col("nc").isNull(), F.lit(0).cast("long")).when(F.col("core"), block(F.col("nc"))).otherwise(F.col("nc") + block(F.col("nr"))))
    others = F.when(F.col("nc").isNull(), F.lit(1).cast("long")).when(F.col("core"), F.col("nc") + F.col("nr")).otherwise(F.col("nc"))
    rows = rows.withColumn("others", others).where("others > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("other"))
    rows = rows.select("leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "core", "vec_id", "w", "raw", "copies", "leaves", "rims")

    def compare(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(t.column("vec_id").to_numpy())).combine_chunks()
        leaf, i, j, w = (t.column(c)[0].as_py() for c in ("leaf", "i", "j", "w"))
        ids, copies, side, rim = (t.column(c).to_numpy() for c in ("vec_id", "copies", "mine", "core"))
        lists, rims = (t.column(c).chunk(0) for c in ("leaves", "rims"))
        x, rim, n = _unit(t.column("raw").to_pylist(), w), ~rim, len(t)
        s, unsure, label, links = x.astype(np.float32), 1e-6 + 1e-7 * w, np.arange(n), np.zeros(n)
        for k in range(0, n, step := min(256, max(1, TILE // n))):
            cos = s[k : k + step] @ s[k:].T
            r, q = np.divmod(np.flatnonzero((cos >= least - unsure).ravel()), n - k)
            ahead = q > r
            r, q = r[ahead], q[ahead]
            doubt = np.flatnonzero(cos[r, q] < least + unsure)
            r, q, sure = r + k, q + k, np.ones(len(r), bool)
            for c in range(0, len(doubt), 1 << 12):
                d = doubt[c : c + (1 << 12)]
                sure[d] = np.einsum("ij,ij->i", x[r[d]], x[q[d]]) >= least
            if rim.any():
                sure &= ~(rim[r] & rim[q])
            if i != j:
                sure &= side[r] != side[q]
            r, q = r[sure], q[sure]
            if not len(r):
                continue
            met = np.zeros(n, bool)
            met[r] = met[q] = True
            some, at = pa.array(np.flatnonzero(met)), np.cumsum(met) - 1
            first = _shared(lists.take(some), leaf, at[r], at[q]) == _shared(rims.take(some), leaf, at[r], at[q])
            r, q = r[first], q[first]
            links += np.bincount(r, copies[q], n) + np.bincount(q, copies[r], n)
            _joined(label, r, q)
        some = np.flatnonzero(links)
        return pa.table({"vec_id": ids[some], "links": links[some].astype(np.int64), "root": ids[label[some]]})

    return rows.groupBy("leaf", "i", "j").applyInArrow(compare, "vec_id long, links long, root long")


def embedding_components(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    every = staged(packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))), "packed")
    good = every.where("raw is not null")
    # one vec_id may stand for several vectors when ids repeat: a number of its own tells them apart
    base = good.groupBy("w", "raw").agg(F.min("vec_id").alias("vid"), F.count("*").alias("copies"))
    base = staged(base.select(F.monotonically_increasing_id().alias("vec_id"), "vid", "w", "raw", "copies"), "vectors")
    most = base.groupBy("w").count().orderBy(F.desc("count"), "w").first()
    if most is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = staged(forest_links(base, most.w, least), "links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    number = base.select("vec_id", "vid")
    edges = found.where("vec_id <> root").select("vec_id", "root").distinct().join(number, "vec_id").join(number.select(F.col("vec_id").alias("root"), F.col("vid").alias("rid")), "root")
    # rows of one vector hang together through its smallest vec_id
    named = good.join(base.select("w", "raw", F.col("vec_id").alias("num"), "vid", "copies"), ["w", "raw"])
    rows = staged(named.select("vec_id", "num", "vid", "copies"), "rows")
    pairs = edges.select(F.col("vid").alias("a"), F.col("rid").alias("b")).unionByName(rows.where("vec_id <> vid").select(F.col("vec_id").alias("a"), F.col("vid").alias("b")))
    comp = components(pairs)
    out = (
        rows.join(links.withColumnRenamed("vec_id", "num"), "num", "left").join(comp, F.col("vec_id") == F.col("node"), "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    bad = every.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id)::BIGINT AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM reach GROUP BY vec_id
"""
