"""Outlines from heading levels: rows (doc, idx, lvl, caption) in reading order, levels 0 to 9, deeper ones below shallower ones.

A row's ancestors are what a stack would hold: of each smaller level the last row, if no later row has a smaller level still. One
window carries the last row of each level, so there is no self-join. A document is dealt into blocks of ``BLOCK`` places, each
block looks at its own rows, and what earlier blocks end with is carried by a row a block: no document is one task.

Cases: rows without a level or with one outside 0 to 9 are not part of the outline and do not come back; a null caption is empty;
idx is unique in a document; rows without a doc are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .outline import MAX_LEVELS

BLOCK = 10_000


def _of_levels(nodes: DataFrame, value: Column, later: bool, block: int) -> DataFrame:
    """nodes plus state: for each level the value of the last row before this one (later: the first one behind it)."""
    best = F.min if later else F.max
    every = [best(F.when(F.col("lvl") == i, value)) for i in range(MAX_LEVELS)]
    order, frame = (F.desc, (Window.unboundedPreceding, -1)) if later else (F.asc, (Window.unboundedPreceding, -1))
    rows = nodes.withColumn("_b", F.floor(F.col("idx") / block))
    inner = Window.partitionBy("doc", "_b").orderBy(order("idx")).rowsBetween(*frame)
    rows = rows.withColumn("_own", F.array(*[e.over(inner) for e in every]))
    sums = nodes.withColumn("_b", F.floor(F.col("idx") / block)).groupBy("doc", "_b").agg(*[e.alias(f"l{i}") for i, e in enumerate(every)])
    across = Window.partitionBy("doc").orderBy(order("_b")).rowsBetween(*frame)
    sums = sums.select(F.col("doc").alias("_d"), F.col("_b").alias("_c"), F.array(*[best(f"l{i}").over(across) for i in range(MAX_LEVELS)]).alias("_far"))
    met = rows.join(sums, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("_b") == F.col("_c")), "left")
    return met.withColumn("state", F.zip_with("_own", "_far", lambda own, far: F.coalesce(own, far))).drop("_b", "_own", "_d", "_c", "_far")


def heading_outline(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc, idx, st, en, lvl, level, caption, parent, ancestors, path): a node spans the rows [st, en] up to the next one of its level or
    a smaller one, lvl is its depth, level the one given; nodes fit every operator of outline."""
    nodes = rows.where(F.col("lvl").between(0, MAX_LEVELS - 1)).select("doc", F.col("idx").cast("int").alias("idx"), F.col("lvl").cast("int").alias("lvl"), F.coalesce("caption", F.lit("")).alias("caption"))
    up = _of_levels(nodes, F.struct("idx", "caption"), False, block)
    none = F.array().cast("array<struct<idx:int,caption:string>>")
    push = lambda held, x: F.when(x.isNull() | (F.coalesce(F.element_at(held, -1)["idx"], F.lit(-1)) > x["idx"]), held).otherwise(F.array_append(held, x))
    up = up.withColumn("stack", F.when(F.col("lvl") > 0, F.aggregate(F.slice("state", F.lit(1), F.greatest(F.col("lvl"), F.lit(1))), none, lambda held, x: F.when(F.size(held) == 0, F.when(x.isNull(), held).otherwise(F.array(x))).otherwise(push(held, x)))).otherwise(none))
    up = up.select("doc", "idx", "lvl", "caption", "stack")
    down = _of_levels(up, F.col("idx"), True, block)
    last = down.withColumn("next", F.array_min(F.slice("state", F.lit(1), F.col("lvl") + 1)))
    # behind a node that no later row ends, the document's last place
    whole = nodes.groupBy("doc").agg(F.max("idx").alias("_end")).withColumnRenamed("doc", "_d")
    out = last.join(whole, F.col("doc").eqNullSafe(F.col("_d")))
    bare = lambda c: F.replace(c, F.lit("$"), F.lit(""))
    return out.select(
        "doc", "idx", F.col("idx").alias("st"), F.coalesce(F.col("next") - 1, F.col("_end")).alias("en"), F.size("stack").alias("lvl"), F.col("lvl").alias("level"), "caption",
        F.try_element_at("stack", F.lit(-1))["idx"].alias("parent"), F.col("stack.idx").alias("ancestors"),
        F.array_join(F.array_append(F.transform("stack", lambda x: bare(x["caption"])), bare(F.col("caption"))), "->").alias("path"),
    )
