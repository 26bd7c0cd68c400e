"""Outlines as interval rows: node(doc, idx, st, en, lvl, caption). Parents and overlaps are sorted sweeps within a document and level."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_LEVELS = 10  # fixed value
PAIR = ("a_idx", "a_st", "a_en", "b_idx", "b_st", "b_en")


def toc_intervals(contents: DataFrame) -> DataFrame:
    """Contents rows (doc, pos, np, npe, caption, unit, lvl) to intervals by start, the later of equal starts; bad marks documents with an unreadable row."""
    from .records import paragraph_number

    rows = contents.withColumns({"st": paragraph_number(F.col("np")), "en": paragraph_number(F.col("npe"))})
    per_doc = Window.partitionBy("doc")
    rows = rows.withColumn("bad", F.bool_or(F.col("st").isNull() | F.col("en").isNull()).over(per_doc))
    last = rows.where("st is not null").groupBy("doc", "st").agg(F.max_by(F.struct("en", "caption", "unit", "lvl", "bad"), "pos").alias("r"))
    return last.select("doc", "st", "r.*")


def failed_documents(contents: DataFrame) -> DataFrame:
    """(doc, reason, detail): documents whose contents have a row without a readable start or end, with the first such row."""
    from .records import paragraph_number

    bad = contents.where(paragraph_number(F.col("np")).isNull() | paragraph_number(F.col("npe")).isNull())
    first = bad.groupBy("doc").agg(F.min_by(F.concat(F.coalesce("np", F.lit("")), F.lit(":"), F.coalesce("npe", F.lit(""))), "pos").alias("detail"))
    return first.select("doc", F.lit("unreadable contents row").alias("reason"), "detail")


def too_deep(nodes: DataFrame, most: int = MAX_LEVELS) -> DataFrame:
    """(doc, reason, detail): a row for each node that cap_levels leaves out."""
    return nodes.where(F.col("lvl") >= most).select("doc", F.lit("level too deep").alias("reason"), F.concat_ws(":", F.col("st").cast("string"), F.col("en").cast("string"), F.col("lvl").cast("string")).alias("detail"))


def attach_outline(blocks: DataFrame, toc: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Paragraphs (doc, seq, pid, text) with interval and level: of the contents row that starts there, else [pid, pid] one level below the last match.
    also: further columns of the paragraphs that stay."""
    t = toc.select("doc", F.col("st").alias("pid"), "en", "caption", "unit", "lvl")
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.join(t, ["doc", "pid"], "left")
    under = F.coalesce(F.last("lvl", True).over(w), F.lit(0)) + 1
    return out.withColumn("lvl", F.coalesce("lvl", under)).select(
        "doc", "seq", F.col("pid").alias("st"), F.coalesce("en", "pid").alias("en"), "lvl", "caption", F.coalesce("unit", F.lit("paragraph")).alias("unit"), "text", *(also or [])
    )


def cap_levels(nodes: DataFrame, most: int = MAX_LEVELS) -> DataFrame:
    return nodes.where(F.col("lvl") < most)


def parents_of(ranges: DataFrame, nodes: DataFrame, key: list[str], inserted_before: bool = False) -> DataFrame:
    """Each range's parent: of the nodes one level up that contain it, that with the smallest start, then the last inserted. parent null: none.

    Of the nodes by start (of equal starts, the last inserted first) only those count that end behind all before them, so
    their ends rise with their starts, and the first that ends no earlier than a range is its parent if it starts in time.
    Where all nodes count, that is one running maximum and one carry along the ends, both windows of Spark. Where only nodes
    inserted earlier do, rows are swept in order of insertion, and a task holds the nodes that still count of one document and
    level. No pair of nodes is formed either way. Ranges or nodes without a start, end or level have no parent
    and are none; rows without a doc are one document.
    """
    up = nodes.where("st is not null and en is not null and lvl is not null").select("doc", (F.col("lvl") + 1).alias("lvl"), "st", "en", "idx")
    row = F.struct(*[F.col(c) for c in ranges.columns if c != "parent"]).alias("r")  # a parent that is there is replaced
    if inserted_before:
        return _inserted_parents(ranges.select("doc", "lvl", "st", "en", F.col("idx"), row), up, ranges)
    before = Window.partitionBy("doc", "lvl").orderBy("st", F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    stairs = up.withColumn("hi", F.max("en").over(before)).where("hi is null or en > hi").select("doc", "lvl", "en", F.lit(0).alias("side"), F.struct("st", "idx").alias("stair"))
    asks = ranges.select("doc", "lvl", "en", F.lit(1).alias("side"), row)
    along = Window.partitionBy("doc", "lvl").orderBy(F.desc("en"), "side").rowsBetween(Window.unboundedPreceding, 0)
    met = stairs.unionByName(asks, True).withColumn("stair", F.last("stair", True).over(along)).where("side = 1")
    return met.select("r.*", F.when((F.col("stair.st") <= F.col("r.st")) & F.col("r.en").isNotNull(), F.col("stair.idx")).alias("parent"))


def _inserted_parents(asks: DataFrame, up: DataFrame, ranges: DataFrame) -> DataFrame:
    def sweep(batches):
        now, keys, ends = None, [], []  # (start, -idx) and end of the nodes that count, both rising
        for b in batches:
            at, parent = [], []
            cols = [b.column(c).to_pylist() for c in ("doc", "lvl", "st", "en", "idx", "side")]
            for i, (doc, lvl, st, en, idx, side) in enumerate(zip(*cols, strict=True)):
                if (doc, lvl) != now:
                    now, keys, ends = (doc, lvl), [], []
                if not side:
                    k = len(ends) if st is None or en is None else bisect_left(ends, en)
                    at.append(i)
                    parent.append(-keys[k][1] if k < len(ends) and keys[k][0] <= st else None)
                    continue
                k = bisect_left(keys, (st, -idx))
                if k and ends[k - 1] >= en:
                    continue
                to = bisect_right(ends, en, k)
                keys[k:to], ends[k:to] = [(st, -idx)], [en]
            yield pa.record_batch([b.column("r").take(pa.array(at, pa.int64())), pa.array(parent, b.schema.field("idx").type)], names=["r", "parent"])

    kind = ranges.schema["idx"].dataType.simpleString()
    both = asks.withColumn("side", F.lit(0)).unionByName(up.withColumn("side", F.lit(1)), True)
    both = both.withColumn("idx", F.col("idx").cast(kind)).repartition("doc", "lvl").sortWithinPartitions("doc", "lvl", "idx", "side")
    return both.mapInArrow(sweep, f"r {asks.schema['r'].dataType.simpleString()}, parent {kind}").select("r.*", "parent")


def parents(nodes: DataFrame) -> DataFrame:
    return parents_of(nodes, nodes, ["doc", "idx"])


def with_chains(nodes: DataFrame) -> DataFrame:
    """nodes plus parent, ancestors (idx from the root down) and path: captions from the root to the node, ``->`` between, ``$`` removed.

    One sweep by level and start: a task holds, of one document, what counts of the level above (rising starts and ends, so a
    parent is a binary search) and of the level it is in. Levels need not begin at 0; where one is missing, chains begin anew.
    """
    made = ("parent", "ancestors", "path")
    kept = [c for c in nodes.columns if c not in made]
    cap = F.replace(F.coalesce(F.col("caption").cast("string"), F.lit("")), F.lit("$"), F.lit(""))
    rows = nodes.select("doc", "lvl", "st", "en", "idx", cap.alias("cap"), F.struct(*[F.col(c) for c in kept]).alias("r"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def sweep(batches):
        now = level = None
        above, own = ([], [], []), ([], [], [])  # ends, starts, (ancestors and self, path)
        for b in batches:
            out = []
            for doc, lvl, st, en, idx, cap in zip(*(b.column(c).to_pylist() for c in ("doc", "lvl", "st", "en", "idx", "cap")), strict=True):
                if doc != now or lvl != level:
                    next_level = doc == now and None not in (lvl, level) and lvl == level + 1
                    above, own, now, level = own if next_level else ([], [], []), ([], [], []), doc, lvl
                chain, path = (), cap
                if st is not None and en is not None:
                    k = bisect_left(above[0], en)
                    if k < len(above[0]) and above[1][k] <= st:
                        chain, path = above[2][k][0], f"{above[2][k][1]}->{cap}"
                    if not own[0] or en > own[0][-1]:
                        for held, x in zip(own, (en, st, ((*chain, idx), path)), strict=True):
                            held.append(x)
                out.append((chain, path))
            i = b.schema.field("idx").type
            yield pa.record_batch([b.column("r"), pa.array([c[-1] if c else None for c, _ in out], i), pa.array([c for c, _ in out], pa.list_(i)), pa.array([p for _, p in out], pa.string())], names=["r", *made])

    dealt = rows.repartition("doc").sortWithinPartitions("doc", "lvl", "st", F.desc("idx"))
    return dealt.mapInArrow(sweep, f"r {kind['r']}, parent {kind['idx']}, ancestors array<{kind['idx']}>, path string").select("r.*", *made)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc, idx, anc_idx, anc_lvl): all ancestors, each a level above the next."""
    up = with_chains(nodes).select("doc", "idx", "lvl", F.size("ancestors").alias("n"), F.posexplode("ancestors").alias("pos", "anc_idx"))
    return up.select("doc", "idx", "anc_idx", (F.col("lvl") - F.col("n") + F.col("pos")).alias("anc_lvl"))


def paths(nodes: DataFrame) -> DataFrame:
    """(doc, idx, path) of every node."""
    return with_chains(nodes).select("doc", "idx", "path")


def child_links(nodes: DataFrame) -> DataFrame:
    return parents_of(nodes, nodes, ["doc", "idx"], inserted_before=True).where("parent is not null")


def children(nodes: DataFrame) -> DataFrame:
    """(doc, idx, children): in order of insertion; only parents that were inserted earlier."""
    return child_links(nodes).groupBy("doc", F.col("parent").alias("idx2")).agg(F.array_sort(F.collect_list("idx")).alias("children")).withColumnRenamed("idx2", "idx")


def overlaps(nodes: DataFrame, symmetric: bool = True) -> DataFrame:
    """(doc, lvl, a_idx, b_idx): pairs of one level that overlap, a inserted before b. Swept by start: a task holds the nodes of one
    document and level that are still open, and does no work but for pairs that it gives."""

    def sweep(batches):
        now, open_ = None, []
        for b in batches:
            out = []
            for doc, lvl, lo, hi, idx, st, en in zip(*(b.column(c).to_pylist() for c in ("doc", "lvl", "lo", "hi", "idx", "st", "en")), strict=True):
                if (doc, lvl) != now:
                    now, open_ = (doc, lvl), []
                open_ = [o for o in open_ if o[0] >= lo]
                out += [{"doc": doc, "lvl": lvl} | dict(zip(PAIR, (*o[1:], idx, st, en) if o[1] < idx else (idx, st, en, *o[1:]), strict=True)) for o in open_]
                open_.append((hi, idx, st, en))
            yield pa.RecordBatch.from_pylist(out, pa.schema([b.schema.field("doc"), b.schema.field("lvl"), *(pa.field(c, b.schema.field(c[2:]).type) for c in PAIR)]))

    rows = nodes.where("st is not null and en is not null").select("doc", "lvl", F.least("st", "en").alias("lo"), F.greatest("st", "en").alias("hi"), "idx", "st", "en")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = rows.repartition("doc", "lvl").sortWithinPartitions("doc", "lvl", "lo", "idx")
    pairs = dealt.mapInArrow(sweep, f"doc {kind['doc']}, lvl {kind['lvl']}, " + ", ".join(f"{c} {kind[c[2:]]}" for c in PAIR))
    if symmetric:
        pairs = pairs.where("a_st <= b_en and b_st <= a_en")
    else:  # an end of a lies in b; a strict container is not seen
        pairs = pairs.where("a_st between b_st and b_en or a_en between b_st and b_en")
    return pairs.where("a_idx <> b_idx").select("doc", "lvl", "a_idx", "b_idx")


def sibling_conflicts(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates (doc, parent, st, en, ...) that overlap a child of their parent: of the children that start by the candidate's end,
    the last end lies no earlier than its start."""
    kids = child_links(nodes).select("doc", "parent", F.col("st").alias("at"), F.lit(0).alias("side"), F.col("en").alias("until"))
    asks = candidates.select("doc", "parent", F.col("en").alias("at"), F.lit(1).alias("side"), F.struct(*[F.col(c) for c in candidates.columns]).alias("r"))
    along = Window.partitionBy("doc", "parent").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = kids.where("at is not null").unionByName(asks.where("at is not null and parent is not null"), True).withColumn("until", F.max("until").over(along))
    return met.where("side = 1 and until >= r.st").select("r.*")


def stats(nodes: DataFrame) -> DataFrame:
    """(doc, total_nodes, by_level, nodes_with_children, total_children, max_children)."""
    kids = child_links(nodes).groupBy("doc", "parent").agg(F.count("*").alias("k")).groupBy("doc").agg(F.count("*").alias("p"), F.sum("k").alias("s"), F.max("k").alias("m"))
    base = nodes.groupBy("doc").agg(F.count("*").alias("total_nodes"), F.array(*[F.count(F.when(F.col("lvl") == i, 1)) for i in range(MAX_LEVELS)]).alias("by_level"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return base.join(kids, "doc", "left").select("doc", "total_nodes", "by_level", zero(F.col("p")).alias("nodes_with_children"), zero(F.col("s")).alias("total_children"), zero(F.col("m")).alias("max_children"))


def issues(nodes: DataFrame) -> DataFrame:
    """(doc, severity, kind, a_idx, b_idx): child outside its parent, level gap, same-level overlap."""
    link = child_links(nodes).select("doc", F.col("parent").alias("a_idx"), F.col("idx").alias("b_idx"), "st", "en", "lvl")
    both = link.join(nodes.select("doc", F.col("idx").alias("a_idx"), F.col("st").alias("pst"), F.col("en").alias("pen"), F.col("lvl").alias("plvl")), ["doc", "a_idx"])
    tag = lambda d, s, k: d.select("doc", F.lit(s).alias("severity"), F.lit(k).alias("kind"), "a_idx", "b_idx")
    return (
        tag(both.where("st < pst or en > pen"), "error", "outside_parent")
        .unionByName(tag(both.where("lvl - plvl <> 1"), "error", "level_gap"))
        .unionByName(tag(overlaps(nodes, symmetric=False), "warning", "overlap"))
    )


def validate(nodes: DataFrame) -> DataFrame:
    """(doc, is_valid, n_errors, n_warnings) of every document."""
    found = issues(nodes).groupBy("doc").agg(F.count(F.when(F.col("severity") == "error", 1)).alias("e"), F.count(F.when(F.col("severity") == "warning", 1)).alias("w"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("doc").distinct().join(found, "doc", "left").select("doc", (n(F.col("e")) == 0).alias("is_valid"), n(F.col("e")).alias("n_errors"), n(F.col("w")).alias("n_warnings"))


def listing(nodes: DataFrame) -> DataFrame:
    """(doc, ord, line): depth first, children in order of insertion, two blanks a level."""
    keyed = with_chains(nodes).withColumn("k", F.array_append("ancestors", F.col("idx")))
    w = Window.partitionBy("doc").orderBy("k")
    return keyed.select("doc", (F.row_number().over(w) - 1).alias("ord"), F.concat(F.expr("repeat('  ', size(ancestors))"), F.coalesce("caption", F.lit(""))).alias("line"))


def with_header(rows: DataFrame, headers: DataFrame, key: str = "doc") -> DataFrame:
    """Document columns on every row; Spark broadcasts headers when they are small."""
    return rows.join(headers, key)
