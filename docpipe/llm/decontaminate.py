"""Benchmark decontamination by a distributed positional inverted index.

Words are ASCII-lower-cased runs of digits, letters and non-ASCII characters. A window is ``WINDOW`` consecutive
words of an item; a shorter item that has words is one window. The work, for blocks of at most ``BLOCK`` windows so
that what is broadcast is bounded however many items there are:

1. count each benchmark term over all documents; every window picks its ``ANCHORS`` rarest terms;
2. postings (term, position) of these terms are stored as a table with one row per document, its two lists side by side;
   ``inverted`` reads it as one row per posting;
3. offset-adjusted lists are intersected: a posting at p of a term at item offset o votes for diagonal p - o; a
   (document, item, diagonal) goes on when all anchors of some window voted;
4. survivors are compared word by word along the diagonal, which gives exact hits.

Windows of an item share anchors, so votes are counted per item and not per window. Results do not depend on the
counts; they only decide how short the lists are. ``proximity`` answers near-phrase searches from the same postings.

Cases: null or empty texts have no words; items with null item_id or no words are left out; an item_id on several rows
counts once; repeated documents each get the result; null doc_ids are kept; empty tables give n_hit 0 or no rows; extra
columns are dropped.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tidied
from .toxicity import TABLE

WINDOW, ANCHORS, BLOCK = 10, 3, 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def blocks_of(benchmark: DataFrame, size: int = WINDOW, most: int = BLOCK):
    """Lists of (item_id, words) with at most ``most`` windows each (one item at least); the iterator holds one at a time."""
    block, held = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        w = words_of(r.text)
        if not w:
            continue
        if block and held + len(w) > most:
            yield block
            block, held = [], 0
        block.append((r.item_id, w))
        held += max(1, len(w) - size + 1)
    if block:
        yield block


def spans(n: int, size: int = WINDOW) -> list[tuple[int, int]]:
    return [(s, s + size) for s in range(n - size + 1)] if n >= size else [(0, n)]


def term_counts(docs: DataFrame, ids: dict[bytes, int]) -> np.ndarray:
    """Occurrences of each term in all documents, summed in each task before the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def count(batches):
        get, total = sent.value.get, np.zeros(len(sent.value) + 1, np.int64)
        for b in batches:
            for t in b["text"]:
                w = words_of(t)
                total += np.bincount(np.fromiter((get(x, -1) for x in w), np.int64, len(w)) + 1, minlength=len(total))
        at = np.flatnonzero(total[1:])
        yield pd.DataFrame({"term": at, "n": total[1:][at]})

    out = np.zeros(len(ids), np.int64)
    for r in staged(docs.select("text").mapInPandas(tidied(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "counts").collect():
        out[r.term] = r.n  # one row per benchmark term of the block
    return out


def anchors_of(block, ids, counts, size: int = WINDOW, anchors: int = ANCHORS):
    """Per item: {offset: term} of anchors and, per window, the offsets that must vote."""
    need = []
    for _, w in block:
        t = np.array([ids[x] for x in w])
        each = [sorted(range(a, b), key=lambda o: (counts[t[o]], t[o], o))[:anchors] for a, b in spans(len(w), size)]
        need.append(each)
    return need


def postings(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """One row per document (doc_id, th, n_words, terms, positions): the postings of the given terms, by document."""
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def index(batches):
        get = sent.value.get
        for b in batches:
            n, terms, places = [], [], []
            for t in b["text"]:
                w = words_of(t)
                x = np.fromiter((get(v, -1) for v in w), np.int32, len(w))
                at = np.flatnonzero(x >= 0).astype(np.int32)
                n.append(len(w)), terms.append(x[at]), places.append(at)
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "n_words": n, "terms": terms, "places": places})

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text").mapInPandas(
        tidied(index), "doc_id long, th long, n_words long, terms array<int>, places array<int>"
    )


def inverted(index: DataFrame) -> DataFrame:
    """(term, doc_id, th, pos) rows of a postings table."""
    return index.where("size(terms) > 0").select("doc_id", "th", F.explode(F.arrays_zip("terms", "places")).alias("x")).select(
        F.col("x.terms").alias("term"), "doc_id", "th", F.col("x.places").alias("pos")
    )


def _hits(docs: DataFrame, index: DataFrame, block, need, ids, size: int) -> DataFrame:
    """(doc_id, th, hits array<int>, items array<long>) of documents with an occurrence of the block's windows."""
    spark = docs.sparkSession
    wanted = sorted({(ids[w[o]], k, o) for k, ((_, w), each) in enumerate(zip(block, need, strict=True)) for a in each for o in a})
    terms = spark.createDataFrame(pd.DataFrame(wanted, columns=["term", "item", "off"]), "term int, item int, off int")
    votes = (
        inverted(index).join(F.broadcast(terms), "term")  # BLOCK * ANCHORS rows at most
        .select("doc_id", "th", "item", (F.col("pos") - F.col("off")).alias("diag"), "off").distinct()
        .groupBy("doc_id", "th", "item", "diag").agg(F.collect_set("off").alias("offs"))
    )
    sent = spark.sparkContext.broadcast((block, [list(map(frozenset, each)) for each in need]))

    def agree(batches):
        _, need = sent.value
        for b in batches:
            yield b[[any(a <= set(o) for a in need[k]) for k, o in zip(b["item"], b["offs"], strict=True)]][["doc_id", "th", "item", "diag"]]

    kept = votes.where(F.size("offs") >= min(min(map(len, e)) for e in need)).mapInPandas(tidied(agree), "doc_id long, th long, item int, diag int")
    per_doc = kept.groupBy("doc_id", "th").agg(F.collect_list(F.struct("item", "diag")).alias("cand"))
    per_doc = per_doc.select(F.col("doc_id").alias("cd"), F.col("th").alias("ct"), "cand")
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")

    def compare(batches):
        block, _ = sent.value
        for b in batches:
            out = []
            for doc_id, th, text, cand in zip(b["doc_id"], b["th"], b["text"], b["cand"], strict=True):
                w, hit, items = words_of(text), set(), set()
                for c in cand:
                    item_id, own = block[c["item"]]
                    for s, e in spans(len(own), size):
                        a = s + c["diag"]
                        if a >= 0 and w[a : a + e - s] == own[s:e]:
                            hit.update(range(a, a + e - s))
                            items.add(item_id)
                if hit:
                    out.append((doc_id, th, sorted(hit), sorted(items)))
            yield pd.DataFrame(out, columns=["doc_id", "th", "hits", "items"])

    joined = texts.join(per_doc, F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("th") == F.col("ct")))
    found = joined.select("doc_id", "th", "text", "cand").mapInPandas(tidied(compare), "doc_id long, th long, hits array<int>, items array<long>")
    return found.dropDuplicates(["doc_id", "th"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, th, n_words, n_hit, hits, items) for every row of docs: a hash of its text, positions of hit words and items that occur."""
    docs = docs.select("doc_id", "text")
    base, found = None, None
    for block in blocks_of(benchmark, size):
        ids: dict[bytes, int] = {}
        for _, w in block:
            for x in w:
                ids.setdefault(x, len(ids))
        need = anchors_of(block, ids, term_counts(docs, ids), size)
        used = {w[o]: ids[w[o]] for (_, w), each in zip(block, need, strict=True) for a in each for o in a}
        index = staged(postings(docs, used), "postings")
        base = index.select("doc_id", "th", "n_words") if base is None else base
        hits = _hits(docs, index, block, need, ids, size)
        found = hits if found is None else staged(
            found.unionByName(hits).groupBy("doc_id", "th")
            .agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")),
            "hits",
        )
    if found is None:
        base = postings(docs, {}).select("doc_id", "th", "n_words")
        return base.select("doc_id", "th", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<long>").alias("items"))
    found = found.select(F.col("doc_id").alias("fd"), F.col("th").alias("ft"), "hits", "items")
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft")), "left")
    return out.select(
        "doc_id", "th", "n_words", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<long>")).alias("items"),
    )


def proximity(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(doc_id, th, phrase, pos): where a posting of the phrase's rarest term stands so that every other term has a posting within
    ``slop`` words of its place relative to that one. ``index`` is a postings table, ``phrases`` has rows (phrase, off, term).

    Lists are intersected from the rarest term: its postings become places of the phrase, and those of the other terms are joined
    to places in the same or a neighbouring cell of ``slop + 1`` words, so a frequent term meets only what is near."""
    post = inverted(index).join(phrases, "term").select("phrase", "off", "term", "doc_id", "th", "pos", (F.col("pos") - F.col("off")).alias("diag"))
    rarest = post.groupBy("phrase", "off", "term").agg(F.count("*").alias("c")).groupBy("phrase").agg(F.min(F.struct("c", "term", "off"))["off"].alias("off"))
    cell = F.floor(F.col("diag") / (slop + 1))
    start = post.join(rarest, ["phrase", "off"]).select("phrase", "doc_id", "th", F.col("pos").alias("at"), F.col("diag").alias("place"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = post.select("phrase", "off", F.col("doc_id").alias("nd"), F.col("th").alias("nt"), "diag", cell.alias("cell"))
    same = (start["phrase"] == near["phrase"]) & (start["cell"] == near["cell"]) & F.col("doc_id").eqNullSafe(F.col("nd")) & (F.col("th") == F.col("nt"))
    both = start.join(near, same).drop(near["phrase"], near["cell"]).where(F.abs(F.col("diag") - F.col("place")) <= slop)
    met = both.groupBy("phrase", "doc_id", "th", "at").agg(F.count_distinct("off").alias("met"))
    long = phrases.groupBy("phrase").agg(F.count_distinct("off").alias("long"))
    return met.join(long, "phrase").where("met = long").select("doc_id", "th", "phrase", F.col("at").alias("pos"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
dg AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dg.n, item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
