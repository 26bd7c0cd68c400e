"""Sweeps of outlines and outlines from heading levels against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docpipe.operators import headings as hd
from docpipe.operators import outline as ol

NODE = "doc int, idx int, st int, en int, lvl int, caption string"


def nodes_of(rng, docs, n):
    rows = []
    for d in range(docs):
        order = list(range(n))
        rng.shuffle(order)
        for i in order:
            st = rng.randrange(0, 30)
            en = st + rng.choice([0, 1, 5, 12, 30, -3])
            rows.append((d if d else None, i, st if rng.random() > 0.03 else None, en if rng.random() > 0.03 else None, rng.randrange(0, 4), f"n{i}"))
    return rows


def within(c, p):
    return None not in (c[2], c[3], p[2], p[3]) and p[2] <= c[2] and p[3] >= c[3]


@pytest.mark.parametrize("before", [False, True])
def test_parents(spark, before):
    rows = nodes_of(random.Random(3), 12, 40)
    df = spark.createDataFrame(rows, NODE)
    out = ol.parents_of(df, df, ["doc", "idx"], inserted_before=before)
    assert out.columns == [*df.columns, "parent"]
    want = set()
    for c in rows:
        fit = [p for p in rows if p[0] == c[0] and p[4] == c[4] - 1 and within(c, p) and (p[1] < c[1] or not before)]
        best = min(fit, key=lambda p: (p[2], -p[1]), default=None)
        want.add((c[0], c[1], best[1] if best else None))
    got = [(r.doc, r.idx, r.parent) for r in out.collect()]
    assert len(got) == len(rows) and set(got) == want
    assert ol.parents_of(df.limit(0), df, ["doc", "idx"], inserted_before=before).count() == 0


@pytest.mark.parametrize("symmetric", [True, False])
def test_overlaps(spark, symmetric):
    rows = nodes_of(random.Random(4), 8, 40)
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[4] == b[4] and a[1] < b[1] and None not in (*a[2:4], *b[2:4]):
                if (a[2] <= b[3] and b[2] <= a[3]) if symmetric else (b[2] <= a[2] <= b[3] or b[2] <= a[3] <= b[3]):
                    want.add((a[0], a[4], a[1], b[1]))
    got = [tuple(r) for r in ol.overlaps(spark.createDataFrame(rows, NODE), symmetric).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sibling_conflicts(spark):
    rng = random.Random(5)
    rows = [(1, i, st, st + rng.randrange(0, 4), lvl, "") for i, (lvl, st) in enumerate([(0, 0)] + [(1, rng.randrange(0, 40)) for _ in range(20)])]
    rows[0] = (1, 0, 0, 100, 0, "")
    df = spark.createDataFrame(rows, NODE)
    asks = [(1, 0, st, st + w, f"x{st}-{w}") for st in range(0, 45) for w in (0, 2)] + [(1, None, 1, 2, "none"), (1, 0, 1, None, "open")]
    got = {r.name for r in ol.sibling_conflicts(spark.createDataFrame(asks, "doc int, parent int, st int, en int, name string"), df).collect()}
    assert got == {a[4] for a in asks if None not in a and any(r[4] == 1 and a[2] <= r[3] and r[2] <= a[3] for r in rows)}


def test_large_document(spark):
    """A document of 100,000 nodes on two levels under one root ends in seconds; pairs would be ten thousand million."""
    n = spark.range(100_000).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("idx"), (F.col("id") % 50_000).cast("int").alias("st"))
    n = n.withColumns({"en": F.col("st"), "lvl": F.when(F.col("idx") == 0, 0).when(F.col("idx") < 50_000, 1).otherwise(2), "caption": F.lit("")})
    n = n.withColumn("en", F.when(F.col("idx") == 0, 1 << 30).otherwise(F.col("en")))
    began = time.time()
    assert ol.parents(n).where("parent is not null").count() == 99_999 - 1  # the one node at place 0 of level 2 has no parent
    assert ol.child_links(n).count() == 99_999 - 1
    assert ol.overlaps(n).count() == 0
    assert time.time() - began < 60


def stack_outline(rows):
    out, stack = {}, []
    for idx, lvl, cap in rows:
        while stack and stack[-1][1] >= lvl:
            stack.pop()
        out[idx] = ([i for i, _, _ in stack], "->".join(x.replace("$", "") for x in [*(c for _, _, c in stack), cap]))
        stack.append((idx, lvl, cap))
    last = rows[-1][0]
    ends = {i: next((j - 1 for j, m, _ in rows if j > i and m <= lvl), last) for i, lvl, _ in rows}
    return {i: (*v, ends[i]) for i, v in out.items()}


@pytest.mark.parametrize("block", [3, hd.BLOCK])
def test_heading_outline(spark, block):
    rng = random.Random(6)
    rows = [(d or None, i, rng.choice([0, 1, 1, 2, 3, 6, 9]), f"$h{i}") for d in range(9) for i in range(rng.choice([1, 8, 30]))]
    odd = [(1, 100, None, "x"), (1, 101, 10, "y"), (1, 102, -1, "z")]
    df = spark.createDataFrame(rows + odd, "doc int, idx int, lvl int, caption string")
    out = hd.heading_outline(df, block).collect()
    assert len(out) == len(rows)
    for d in {r[0] for r in rows}:
        want = stack_outline([r[1:] for r in rows if r[0] == d])
        got = {r.idx: (r.ancestors, r.path, r.en) for r in out if r.doc == d}
        assert got == want
        assert all(r.st == r.idx and r.lvl == len(r.ancestors) and r.parent == (r.ancestors[-1] if r.ancestors else None) for r in out if r.doc == d)
    n = spark.createDataFrame(out).where("doc is not null")
    up = {(r.doc, r.idx): [] for r in out if r.doc}
    for r in ol.ancestors(n).collect():
        up[r.doc, r.idx].append(r.anc_idx)
    assert {k: sorted(v) for k, v in up.items()} == {(r.doc, r.idx): r.ancestors for r in out if r.doc}
    assert {(r.doc, r.idx): r.path for r in ol.paths(n).collect()} == {(r.doc, r.idx): r.path for r in out if r.doc}
    assert hd.heading_outline(df.limit(0)).count() == 0


def test_chains(spark):
    """Parents of the sweep are those of parents_of; ancestors and paths are what following them gives."""
    rows = nodes_of(random.Random(9), 10, 40) + [(3, 900, 1, 2, None, "odd"), (3, 901, 0, 99, 7, "$alone")]
    df = spark.createDataFrame(rows, NODE)
    up = {(r.doc, r.idx): r.parent for r in ol.parents(df).collect()}
    name = {(r[0], r[1]): r[5].replace("$", "") for r in rows}

    def chain(doc, idx):
        p = up[doc, idx]
        return [] if p is None else [*chain(doc, p), p]

    got = ol.with_chains(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = chain(r.doc, r.idx)
        assert (r.parent, r.ancestors) == (up[r.doc, r.idx], want)
        assert r.path == "->".join(name[r.doc, i] for i in [*want, r.idx])
    level = {(r[0], r[1]): r[4] for r in rows}
    every = ol.ancestors(df).collect()
    assert len(every) == sum(len(r.ancestors) for r in got) and all(level[r.doc, r.anc_idx] == r.anc_lvl for r in every)
    assert ol.with_chains(df.limit(0)).count() == 0
