"""The points table and its searches: exact top-k, keywords, hybrid, upsert, delete."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpipe.functions.text import keywords as extract_keywords

BLOCK = 2048  # queries compared at once; up to so many are broadcast, more are dealt into blocks of about so many
POINTS = 16_384  # points that a task compares with a block of queries at once
SCORES, TILE = 1 << 21, 2048  # scores that a task holds at once, and the sides of a square tile of them
TEXTS = 256  # texts whose keywords are held at once
KEYWORDS = 200_000  # keywords of one automaton; more come in blocks, each a pass over the texts
_MACHINES: dict[str, object] = {}


def _first(q: np.ndarray, x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the k best rows of x for each of q, of equal scores those that stand first in x. A matrix
    product tells what can't be among them, the rest is scored pair by pair."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    s = q @ x.T
    if metric == "cosine":
        s /= np.sqrt(qq)[:, None]
        s /= np.sqrt(xx)[None, :]
        slack = np.full(len(q), 1e-12)
    elif metric == "dot":
        slack = 1e-12 * np.sqrt(qq * xx.max())
    else:  # the squares stand for the distances
        s *= 2
        s -= xx[None, :]
        slack = 1e-12 * (qq + xx.max())
    keep = s.shape[1] - min(k, s.shape[1])
    last = np.partition(s, keep, axis=1)[:, keep]
    r, c = np.nonzero(s >= (last - np.where(np.isfinite(slack), slack, 0))[:, None])
    score = _pairs_scored(q, x, r, c, metric)
    order = np.lexsort((c, score if metric == "euclid" else -score, r))
    r = r[order]
    kept = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[kept], c[order][kept], score[order][kept]


def _matrices(vectors: pa.Array, metric: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length: (rows, their vectors) of those that can be scored. For cosines, a vector is scaled by a power of two, so that no square
    is too large or small."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        x = pc.list_flatten(vectors.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)  # nulls become NaN
        ok = np.isfinite(x).all(1)
        if metric == "cosine":
            ok &= (x != 0).any(1)
            x = np.ldexp(x[ok], -np.frexp(np.abs(x[ok]).max(1, initial=0))[1][:, None])
        else:
            x = x[ok]
        if len(x):
            out[n] = rows[ok], x
    return out


def _best(queries: pa.RecordBatch, held: dict, points, k: int, metric: str):
    """Record batches (query_id, id, score): the k best of each ``POINTS`` points for each query, ties by id."""
    for at in range(0, points.num_rows, POINTS):
        p = points.slice(at, POINTS)
        p = p.take(pc.sort_indices(p.column("id"), null_placement="at_start"))
        column = p.column("embedding")
        for n, (rows, x) in _matrices(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, metric).items():
            if n not in held:
                continue
            ids, q = held[n]
            step = max(1, SCORES // len(x))
            for lo in range(0, len(q), step):
                r, c, score = _first(q[lo : lo + step], x, k, metric)
                cols = queries.column("query_id").take(pa.array(ids[r + lo])), p.column("id").take(pa.array(rows[c])), pa.array(score)
                yield pa.record_batch([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in cols], names=["query_id", "id", "score"])


def ranked(scores: DataFrame, k: int, best_first: bool = True) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if best_first else F.asc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """Exact search. points (id, embedding), queries (query_id, embedding); the filter goes to the scan.

    Each task keeps its own k best per query and ``POINTS`` points, so the shuffle carries k rows of these, and holds ``SCORES`` scores at a time. Up to ``BLOCK`` queries
    are broadcast. More are dealt, as points are, and each block of queries meets each block of points in a task; a point then
    travels once for a block of queries, far less than comparing them costs, and points are scanned once. Vectors that are null or
    empty or hold null or non-finite components match nothing, vectors of different lengths not each other, and a zero vector has
    no cosine. Rows that share an id are told apart by nothing but their scores.
    """
    points = (points if where is None else points.where(where)).select("id", "embedding")
    queries = queries.select("query_id", "embedding")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double"
    some = queries.limit(BLOCK + 1).toArrow()
    if some.num_rows <= BLOCK:
        some = some.combine_chunks()
        held = _matrices(some.column("embedding").combine_chunks(), metric)
        sent = points.sparkSession.sparkContext.broadcast((some.select(["query_id"]), held))

        def score(batches):
            names, held = sent.value
            for b in batches:
                yield from _best(names, held, b, k, metric)

        found = points.mapInArrow(score, schema)
    else:
        n_q, n_p = (max(1, -(-df.count() // most)) for df, most in ((queries, 4 * BLOCK), (points, POINTS)))
        dealt = lambda df, n, m, mine, other: df.withColumn(mine, F.monotonically_increasing_id() % n).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

        def meet(q: pa.Table, p: pa.Table) -> pa.Table:
            out = list(_best(q, _matrices(q.column("embedding").combine_chunks(), metric), p, k, metric)) if q.num_rows and p.num_rows else []
            none = pa.table({"query_id": q.column("query_id").slice(0, 0), "id": p.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
            return pa.Table.from_batches(out) if out else none

        left = dealt(queries, n_q, n_p, "bq", "bp").withColumn("bp", F.col("bp").cast("long")).groupBy("bq", "bp")
        right = dealt(points, n_p, n_q, "bp", "bq").withColumn("bq", F.col("bq").cast("long")).groupBy("bq", "bp")
        found = left.cogroup(right).applyInArrow(meet, schema)
    return ranked(found, k, metric != "euclid")


def keyword_rows(queries: DataFrame, text: str = "text") -> DataFrame:
    return queries.select("query_id", F.explode(extract_keywords(F.col(text))).alias("kw"))


def keyword_hits(points: DataFrame, words: DataFrame) -> DataFrame:
    """(id, kw): which of the distinct words (kw) each point's text holds as a substring. One automaton of all words of a block
    reads every text once, however many words there are."""
    id_type, n = points.schema["id"].dataType.simpleString(), words.count()
    blocks, out = max(1, -(-n // KEYWORDS)), None
    for b in range(blocks):
        some = words if blocks == 1 else words.where(F.pmod(F.xxhash64("kw"), F.lit(blocks)) == b)
        sent = points.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r.kw for r in some.select("kw").collect()]))  # about KEYWORDS at most

        def find(batches, sent=sent):
            import ahocorasick

            key, kws = sent.value
            if key not in _MACHINES:  # made once a worker
                _MACHINES.clear()
                _MACHINES[key] = machine = ahocorasick.Automaton()
                for w in kws:
                    machine.add_word(w, w)
                machine.make_automaton()
            machine = _MACHINES[key]
            for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
                got = [{w for _, w in machine.iter(t)} if len(machine) and t else set() for t in b.column(1).to_pylist()]
                at = np.repeat(np.arange(len(got)), [len(g) for g in got])
                yield pa.record_batch({"id": b.column(0).take(pa.array(at)), "kw": pa.array([w for g in got for w in g], pa.string())})

        part = points.select("id", "text").mapInArrow(find, f"id {id_type}, kw string")
        out = part if out is None else out.unionByName(part)
    return out


def keyword_search(points: DataFrame, queries: DataFrame, k: int, where: Column | None = None, any_of: bool = False) -> DataFrame:
    """Points whose text holds a keyword of the query; the score is the share of its keywords. where is AND (any_of: OR)."""
    kws = keyword_rows(queries)
    total = kws.groupBy("query_id").agg(F.count("*").alias("n"))
    base = points.select("id", "text", (F.lit(True) if where is None else where).alias("ok"))
    base = base if any_of else base.where("ok")
    hit = keyword_hits(base, kws.select("kw").distinct()).join(kws, "kw").groupBy("query_id", "id").agg(F.count("*").alias("m"))
    return ranked(hit.join(total, "query_id").select("query_id", "id", (F.col("m") / F.col("n")).alias("score")), k)


def combine(semantic: DataFrame, keyword: DataFrame, w_semantic: float, w_keyword: float, k: int) -> DataFrame:
    s = semantic.select("query_id", "id", F.col("score").alias("a"))
    t = keyword.select("query_id", "id", F.col("score").alias("b"))
    both = s.join(t, ["query_id", "id"], "full")
    return ranked(both.select("query_id", "id", (F.coalesce("a", F.lit(0.0)) * w_semantic + F.coalesce("b", F.lit(0.0)) * w_keyword).alias("score")), k)


def hybrid(points: DataFrame, queries: DataFrame, k: int, w_semantic: float = 0.7, w_keyword: float = 0.3, where: Column | None = None) -> DataFrame:
    return combine(knn(points, queries, 2 * k, where=where), keyword_search(points, queries, 2 * k, where), w_semantic, w_keyword, k)


def document_chunks(points: DataFrame, uris: DataFrame, limit: int = 1000) -> DataFrame:
    """All chunks of the asked documents in order, at most limit of each."""
    w = Window.partitionBy("document_uri").orderBy("chunk_index", "id")
    return points.join(uris, "document_uri", "left_semi").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


def point_id(uri: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", uri.cast("string"), index.cast("string")), 256)


def to_points(chunks: DataFrame, text_col: str = "embedding_text") -> DataFrame:
    return chunks.withColumn("id", point_id(F.col("document_uri"), F.col("chunk_index"))).withColumn(text_col, F.coalesce(text_col, F.lit("")))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new, and the rows of old whose key it lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_documents(points: DataFrame, uris: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points without the documents, deleted rows per document)."""
    gone = points.join(uris, "document_uri", "left_semi").groupBy("document_uri").agg(F.count("*").alias("deleted"))
    return points.join(uris, "document_uri", "left_anti"), gone


RINGS = 16  # at most, of the distances 0 to 2 from a pivot
MEET, MEET_BYTES, SPREAD = 32, 1 << 25, 8  # sides and bytes that a block of cells holds at most when blocks meet, and how many blocks there are at least
SLACK = 1e-6  # what rounding may take from a distance


def _told_apart(points: DataFrame, top: int) -> DataFrame:
    """Distinct rows, and of equal vectors those of the top + 1 smallest ids: others only make pairs that come behind the first top."""
    first = Window.partitionBy("embedding").orderBy("id")
    return points.select("id", "embedding").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1).drop("n")


def _cells(rows: DataFrame, pivots: int, side: int) -> tuple[DataFrame, pd.DataFrame, dict[int, np.ndarray]]:
    """(rows with cell and distance to the pivot, a row for each cell, pivots by length). A cell is what lies nearest to one pivot, at
    a distance of one ring; vectors of a length that no pivot has are one cell."""
    blocks = -(-rows.count() // side)  # fewer cells than that would be larger than a block, more would be many small tasks
    pivots, rings = max(1, min(pivots, blocks)), max(1, min(RINGS, blocks // max(1, pivots)))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow().column("embedding").combine_chunks()
    unit = {n: x / np.sqrt((x * x).sum(1))[:, None] for n, (_, x) in _matrices(some, "cosine").items()}
    sent = rows.sparkSession.sparkContext.broadcast(unit)

    def assign(batches):
        for b in batches:
            for n, (at, x) in _matrices(b.column("embedding"), "cosine").items():
                near, dist = np.full(len(at), -1), np.zeros(len(at))
                if n in sent.value:
                    d = np.sqrt(np.maximum(0, 2 - 2 * (x / np.sqrt((x * x).sum(1))[:, None]) @ sent.value[n].T))
                    near = d.argmin(1)
                    dist = d[np.arange(len(at)), near]
                kept = b.take(pa.array(at))
                yield pa.record_batch([*kept.columns, pa.array(np.full(len(at), n)), pa.array(near.astype(np.int64)), pa.array((dist * rings / 2).astype(np.int64) if rings > 1 else np.zeros(len(at), np.int64)), pa.array(dist)], names=["id", "embedding", "width", "pivot", "ring", "dist"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("id", "embedding")}
    placed = rows.mapInArrow(assign, f"id {kind['id']}, embedding {kind['embedding']}, width long, pivot long, ring long, dist double")
    cells = placed.groupBy("width", "pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    return placed, cells.toPandas().sort_values(["width", "pivot", "ring"], ignore_index=True), unit  # pivots times rings, and one a length


def _near_cells(cells: pd.DataFrame, unit: dict[int, np.ndarray], farthest: float) -> pd.DataFrame:
    """(a, b) of cells, a <= b, that may hold a pair no farther apart than that."""
    out = []
    for n, c in cells.groupby("width"):
        lo, hi, pivot = c["lo"].to_numpy(), c["hi"].to_numpy(), c["pivot"].to_numpy()
        if n in unit:
            u = unit[n][pivot]
            between = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T))
            least = between - hi[:, None] - hi[None, :]
            same = pivot[:, None] == pivot[None, :]
            least = np.maximum(least, np.where(same, np.maximum(lo[:, None] - hi[None, :], lo[None, :] - hi[:, None]), 0))
        else:
            least = np.zeros((len(c), len(c)))
        a, b = np.nonzero(np.triu(least <= farthest + SLACK))
        out.append(pd.DataFrame({"a": c.index.to_numpy()[a], "b": c.index.to_numpy()[b]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def _pairs_scored(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows r of q with rows c of x, each pair summed by itself: equal vectors score the same wherever they stand."""
    out, step = np.empty(len(r)), max(1, SCORES // q.shape[1])
    for at in range(0, len(r), step):
        a, b = q[r[at : at + step]], x[c[at : at + step]]
        out[at : at + step] = np.sqrt(np.square(a - b).sum(1)) if metric == "euclid" else (a * b).sum(1)
    return out / np.sqrt((q * q).sum(1))[r] / np.sqrt((x * x).sum(1))[c] if metric == "cosine" else out


def _top_pairs(ids: tuple[pa.Array, pa.Array], x: tuple[np.ndarray, np.ndarray], top: int, within: bool, least: float = -2.0) -> pa.Table:
    """The first pairs by score, then ids, of two sides, or (within) of one with itself; none below least is wanted. Tiles of scores
    in single precision tell what is too low by more than their rounding, the rest is scored anew."""
    best = pa.table({"i": ids[0].slice(0, 0), "j": ids[0].slice(0, 0), "score": pa.array([], pa.float64())})
    u = [(v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32) for v in x]
    code = pc.dictionary_encode(pa.concat_arrays([*ids])).indices.to_numpy(zero_copy_only=False)
    code = code[: len(ids[0])], code[len(ids[0]) :]
    repeats = any(len(np.unique(k)) < len(k) for k in code) or not within and bool(np.isin(*code).any())
    rounding = 1.2e-7 * (u[0].shape[1] + 4)
    for lo in range(0, len(u[0]), TILE):
        for at in range(lo if within else 0, len(u[1]), TILE):
            s = u[0][lo : lo + TILE] @ u[1][at : at + TILE].T
            if within and lo == at:
                s[np.tri(len(s), dtype=bool)] = -3
            if repeats:
                s[code[0][lo : lo + TILE, None] == code[1][None, at : at + TILE]] = -3
            if s.max() < least - rounding:
                continue
            r, c = np.nonzero(s >= max(least, np.partition(s, s.size - top, None)[s.size - top] - rounding if s.size > top else -2.0) - rounding)
            r, c = r + lo, c + at
            score = np.round(_pairs_scored(*x, r, c, "cosine"), 12)
            a, b = ids[0].take(pa.array(r)), ids[1].take(pa.array(c))
            new = pa.table({"i": pc.if_else(pc.less(a, b), a, b), "j": pc.if_else(pc.less(a, b), b, a), "score": score})
            best = pa.concat_tables([best, new]).sort_by([("score", "descending"), ("i", "ascending"), ("j", "ascending")]).slice(0, top).combine_chunks()
            if best.num_rows == top:
                least = max(least, best["score"][top - 1].as_py())
    return best


def _paired(points: DataFrame, top: int, side: int, pivots: int):
    spark = points.sparkSession
    apart = _told_apart(points, top)
    placed, cells, unit = _cells(apart, pivots, side)
    cells["cell"], cells["parts"] = cells.index.astype("int64"), -(-cells["n"] // side)
    known = F.broadcast(spark.createDataFrame(cells[["width", "pivot", "ring", "cell", "parts"]], "width long, pivot long, ring long, cell long, parts long"))
    rows = placed.join(known, ["width", "pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id", "embedding"), F.col("parts")))
    rows = rows.select("id", "embedding", "cell", "part", "parts")
    id_type = points.schema["id"].dataType.simpleString()

    def within(t: pa.Table) -> pa.Table:
        ((at, x),) = _matrices(t.column("embedding").combine_chunks(), "cosine").values()  # a cell has one length, sound vectors only
        ids = t.column("id").combine_chunks().take(pa.array(at))
        return _top_pairs((ids, ids), (x, x), top, True)

    first = rows.groupBy("cell", "part").applyInArrow(within, f"i {id_type}, j {id_type}, score double")
    first = first.orderBy(F.desc("score"), "i", "j").limit(top).toArrow()  # top rows
    scores = first.column("score").to_pylist()
    farthest = float(np.sqrt(max(0.0, 2 - 2 * scores[-1]))) if len(scores) == top else 2.0
    near = _near_cells(cells, unit, farthest).merge(cells[["parts"]], left_on="a", right_index=True).merge(cells[["parts"]], left_on="b", right_index=True, suffixes=("_a", "_b"))
    near = near[(near["a"] != near["b"]) | (near["parts_a"] > 1)]
    return rows, cells, near, first, id_type, _grid(apart, cells, unit, farthest + SLACK, side)


def _met_blocks(rows: DataFrame, cells: pd.DataFrame, near: pd.DataFrame, side: int) -> tuple[DataFrame, np.ndarray]:
    """(id, embedding, cell, block, a, b) for each pair of blocks that meet, and which cells do. A block is many cells, or a part of
    one, so a vector travels once for each other block of at most ``MEET`` sides and not for each cell that may be near."""
    n = cells["n"].to_numpy()
    most = max(side, min(MEET * side, MEET_BYTES // (8 * int(cells["width"].max() if len(cells) else 1)), -(-int(n.sum()) // SPREAD)))
    parts = -(-n // most)
    small = np.where(parts == 1, n, 0)
    first = (np.cumsum(small) - small) // most
    behind = np.where(parts > 1, parts, 0)
    first = np.where(parts > 1, (first[parts == 1].max(initial=-1) + 1) + np.cumsum(behind) - behind, first)
    meets = np.zeros((len(n), len(n)), bool)
    meets[near["a"].to_numpy(int), near["b"].to_numpy(int)] = meets[near["b"].to_numpy(int), near["a"].to_numpy(int)] = True
    of = np.repeat(np.arange(len(n)), parts)
    block = np.repeat(first, parts) + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    found = np.zeros((int(block.max(initial=-1)) + 1,) * 2, bool)
    for k in range(len(of)):
        found[block[k], block[meets[of[k]][of]]] = True
    a, b = np.nonzero(np.triu(found))
    spark, long = rows.sparkSession, lambda *x: pd.DataFrame(dict(zip(("k", "a", "b"), map(np.asarray, x)))).astype("int64")
    dealt = F.broadcast(spark.createDataFrame(long(np.arange(len(n)), first, parts), "k long, a long, b long").select(F.col("k").alias("cell"), F.col("a").alias("first"), F.col("b").alias("n")))
    apart = a != b
    pairs = spark.createDataFrame(long(np.r_[a, b[apart]], np.r_[a, a[apart]], np.r_[b, b[apart]]), "k long, a long, b long").withColumnRenamed("k", "block")
    placed = rows.join(dealt, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("embedding", "id"), F.col("n")))
    return placed.select("id", "embedding", "cell", "block").join(F.broadcast(pairs), "block"), meets


def _grid(rows: DataFrame, cells: pd.DataFrame, unit: dict[int, np.ndarray], reach: float, side: int) -> DataFrame | None:
    """(id, embedding, grid): vectors by their distances to a few pivots in steps of at least four times reach, and once more in the
    step below if they lie within reach of it, so two vectors no farther apart than reach share a grid cell. None: the steps would
    be too wide to part anything."""
    used: dict[int, tuple[np.ndarray, float]] = {}
    for n, count in cells.groupby("width")["n"].sum().items():
        if count <= side:
            continue
        u = unit.get(n)
        if u is None or len(u) < 3:
            return None
        d = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T))[np.triu_indices(len(u), 1)]
        spread = float(np.subtract(*np.percentile(d, [95, 5])))
        step = max(4 * reach, spread / 8)
        if spread < 2 * step:
            return None
        used[n] = u[: max(1, min(8, len(u), round(np.log(count / side) / np.log(spread / step)) + 1))], step
    sent = rows.sparkSession.sparkContext.broadcast(used)

    def deal(batches):
        for b in batches:
            for n, (at, x) in _matrices(b.column("embedding"), "cosine").items():
                who, key = np.arange(len(at)), np.full(len(at), n, np.uint64)
                if n in sent.value:
                    u, step = sent.value[n]
                    d = np.sqrt(np.maximum(0, 2 - 2 * (x / np.sqrt((x * x).sum(1))[:, None]) @ u.T))
                    home = np.floor(d / step).astype(np.int64)
                    low = d - home * step < reach
                    for i in range(len(u)):
                        also = low[who, i]
                        key = key * np.uint64(1_000_003)  # cells that clash are one cell
                        key = np.concatenate([key + (home[who, i] + 1).astype(np.uint64), key[also] + home[who[also], i].astype(np.uint64)])
                        who = np.concatenate([who, who[also]])
                kept = b.take(pa.array(at[who]))
                yield pa.record_batch([*kept.columns, pa.array(key.view(np.int64))], names=["id", "embedding", "grid"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("id", "embedding")}
    return rows.mapInArrow(deal, f"id {kind['id']}, embedding {kind['embedding']}, grid long")


def _in_grid(grid: DataFrame, top: int, side: int, id_type: str) -> DataFrame:
    """The top pairs of each grid cell; a large cell is dealt into parts that meet in pairs."""
    sizes = grid.groupBy("grid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("grid").alias("_g"), F.ceil(F.col("n") / (MEET * side)).alias("parts"))
    rows = grid.join(sizes, F.col("grid") == F.col("_g")).withColumn("part", F.pmod(F.xxhash64("id", "embedding"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.select("id", "embedding", "grid", "part", other.alias("other")).select("id", "embedding", "grid", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part")

    def meet(t: pa.Table) -> pa.Table:
        (a,), (b,) = pc.unique(t["a"]).to_pylist(), pc.unique(t["b"]).to_pylist()
        sides = [t] if a == b else [t.filter(pc.equal(t["part"], k)) for k in (a, b)]
        held = [_matrices(x["embedding"].combine_chunks(), "cosine") for x in sides]
        out = [pa.table({"i": t["id"].slice(0, 0), "j": t["id"].slice(0, 0), "score": pa.array([], pa.float64())})]
        for n in set(held[0]) & set(held[-1]):
            ids = [s["id"].combine_chunks().take(pa.array(h[n][0])) for s, h in zip(sides, held, strict=True)]
            out.append(_top_pairs((ids[0], ids[-1]), (held[0][n][1], held[-1][n][1]), top, a == b))
        return pa.concat_tables(out)

    return rows.groupBy("grid", "a", "b").applyInArrow(meet, f"i {id_type}, j {id_type}, score double")


def similar_pairs(points: DataFrame, top: int = 5, side: int = 512, pivots: int = 256) -> DataFrame:
    """(i, j, score): the top pairs by cosine, i < j, ties by ids. Exact, without comparing all pairs where vectors lie in clusters.

    Each vector goes to the cell of its nearest of ``pivots`` sampled vectors and its distance ring. A cell's parts of about ``side``
    rows are compared with themselves first, which bounds the distance of the last pair wanted. Two vectors so near have distances to
    any pivot that differ no more than that (the triangle inequality): where the bound is small, vectors meet in a grid of such
    distances; where it is not, those cells meet that may hold a pair so near, in blocks of many cells. Rows equal in id and vector count once,
    rows of one id make no pair. Vectors that are null, zero, empty or hold null or non-finite components are in no pair, nor are
    vectors of different lengths."""
    spark = points.sparkSession
    rows, cells, near, first, id_type, grid = _paired(points, top, side, pivots)
    if grid is not None:
        more = _in_grid(grid, top, side, id_type)
        found = spark.createDataFrame(first, more.schema).unionByName(more) if first.num_rows else more
        return found.distinct().orderBy(F.desc("score"), "i", "j").limit(top)
    met, meets = _met_blocks(rows, cells, near, side)
    scores = first.column("score").to_pylist()
    sent = spark.sparkContext.broadcast((meets, scores[-1] if len(scores) == top else -2.0))  # cells squared

    def by_cell(t: pa.Table) -> list[tuple]:
        t = t.sort_by("cell").combine_chunks()
        cell = t["cell"].to_numpy()
        ends = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True]) + 1
        out = []
        for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            ((at, x),) = _matrices(t["embedding"].slice(lo, hi - lo).combine_chunks(), "cosine").values()  # a cell has one length, sound vectors only
            out.append((int(cell[lo]), t["id"].slice(lo, hi - lo).combine_chunks().take(pa.array(at)), x))
        return out

    def meet(t: pa.Table) -> pa.Table:
        meets, least = sent.value
        (a,), (b,) = pc.unique(t["a"]).to_pylist(), pc.unique(t["b"]).to_pylist()
        left = by_cell(t if a == b else t.filter(pc.equal(t["block"], a)))
        right = left if a == b else by_cell(t.filter(pc.equal(t["block"], b)))
        best = pa.table({"i": t["id"].slice(0, 0), "j": t["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        for k, (c, i, x) in enumerate(left):
            for d, j, y in right[k if a == b else 0 :]:
                if meets[c, d] and (new := _top_pairs((i, j), (x, y), top, a == b and c == d, least)).num_rows:
                    best = pa.concat_tables([best, new]).sort_by([("score", "descending"), ("i", "ascending"), ("j", "ascending")]).slice(0, top).combine_chunks()
                    least = max(least, best["score"][top - 1].as_py()) if best.num_rows == top else least
        return best

    more = met.groupBy("a", "b").applyInArrow(meet, f"i {id_type}, j {id_type}, score double")
    found = spark.createDataFrame(first, more.schema).unionByName(more) if first.num_rows else more
    return found.distinct().orderBy(F.desc("score"), "i", "j").limit(top)


def compared_pairs(points: DataFrame, top: int = 5, side: int = 512, pivots: int = 256) -> tuple[int, int]:
    """How many pairs similar_pairs compares, and how many there are of equal length."""
    _, cells, near, _, _, grid = _paired(points, top, side, pivots)
    n = cells["n"].to_numpy()
    own = int((n * n / cells["parts"].to_numpy()).sum() / 2)
    every = sum(int(w) * (int(w) - 1) // 2 for w in cells.groupby("width")["n"].sum())
    if grid is not None:
        return own + (grid.groupBy("grid").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0), every
    met = sum(int(n[a] * n[b]) if a != b else int(n[a] ** 2 / 2) for a, b in zip(near["a"], near["b"], strict=True))
    return own + met, every
