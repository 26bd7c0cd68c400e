"""Conversation structure repair: the cheapest edits that give a conversation the shape (system? (user assistant)+)? or nothing.

Each row is a symbol: the role's initial and its first fault (blank, duplicate of an earlier role and text, truncated). Equal
neighbours are runs. The states of the shape (start, behind the system row, behind a user row, behind an assistant row) make the
edits of one symbol a 4 x 4 min-plus matrix, insertions before the row included; a run is advanced by cached binary powers of its
symbol's matrix, from the end of the conversation to its start, which gives the costs. Then choices are unrolled forwards: in each
state the least initial whose cost is the state's, which is the ASCII-least of all cheapest audits, for every initial leads from a
state to one other only.

Conversations of up to ``LONG_ROWS`` rows and ``LONG_BYTES`` bytes are repaired a row a conversation. Longer ones, up to a third of
all rows, are no single group: their rows are sorted by range, a partition's share is a block, and blocks compose. Matrices of
blocks are multiplied from the end, each block unrolls its choices for all four states it may start in, and the states are then
followed from the start; both scans see a few numbers a block. Duplicates come from the least place of each (role, text digest).
Only the digest of the repaired text, which no one can take in parts, reads a long conversation's rows in one task, as a stream.

Cases: a null role or text is one blank, a null conv_id or turn is one in the key of the damage; rows without a conv_id are one
conversation; turns that are null come first, equal turns go by role and text digest; a role without an s, u or a at its start must be
changed or go; repeated rows are duplicates; a conversation that lost all rows has zeros, an empty audit and the digest of an empty
text; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tidied
from .resample import CRC_SQL

LONG_ROWS, LONG_BYTES, BLOCK_ROWS = 4096, 1 << 24, 1 << 16
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
# states: 0 start, 1 behind s, 2 behind u, 3 behind a; a state's only insertion, where kept letters lead, what is missing at the end
INSERT, LETTER = (2, 2, 3, 2), "uuau"
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
END = np.array([0, 4, 2, 0], np.int64)
NEVER = 1 << 40
DELETE, REROLE, ADD, TRUNCATED = 3, 2, 2, 1
NAMES = {"u": "user", "a": "assistant"}
_POWERS: dict[int, list[np.ndarray]] = {}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix and a matrix or vector."""
    return (a[:, :, None] + b[None]).min(1) if b.ndim == 2 else (a + b[None]).min(1)


def symbol(role: str, fault: str) -> int:
    """0: must go; else by the role's initial, even where it is truncated as well."""
    return 0 if fault in ("blank", "duplicate") else 1 + 2 * "sua".find(role[:1] or " ") + 2 + (fault == "truncated")


def told(sym: int) -> tuple[str, int, bool]:
    """(initial, cost of being truncated, whether it must go)."""
    return ("", 0, True) if not sym else (" sua"[(sym - 1) // 2], (sym - 1) % 2 * TRUNCATED, False)


def moves(sym: int, q: int):
    """(initial, state, cost) of the edits of a row in state q, initials in ASCII order but for insertions."""
    letter, more, must = told(sym)
    yield "D", q, DELETE
    if not must:
        if letter in KEEP[q]:
            yield "K", KEEP[q][letter], more
        yield "R", INSERT[q], REROLE + more


def _closure() -> np.ndarray:
    one = np.full((4, 4), NEVER, np.int64)
    one[range(4), range(4)] = 0
    one[range(4), INSERT] = ADD
    return reduce(times, [one] * 3)


CLOSURE = _closure()


def power(sym: int, bit: int) -> np.ndarray:
    """The transition of 2**bit rows of one symbol."""
    every = _POWERS.setdefault(sym, [])
    if not every:
        row = np.full((4, 4), NEVER, np.int64)
        for q in range(4):
            for _, to, cost in moves(sym, q):
                row[q, to] = min(row[q, to], cost)
        every.append(times(CLOSURE, row))
    while len(every) <= bit:
        every.append(times(every[-1], every[-1]))
    return every[bit]


def runs_of(symbols: list[int]) -> list[tuple[int, int]]:
    return [(s, len(list(g))) for s, g in groupby(symbols)]


def advanced(run: tuple[int, int], after: np.ndarray) -> np.ndarray:
    """What lies before a run, from what lies after it: costs of the four states, or a matrix."""
    sym, n = run
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            after = times(power(sym, bit), after)
    return after


def costs(runs: list[tuple[int, int]], end: np.ndarray) -> list[np.ndarray]:
    """What lies before each run and, last, after all of them."""
    out = [end]
    for run in reversed(runs):
        out.append(advanced(run, out[-1]))
    return out[::-1]


def unrolled(runs: list[tuple[int, int]], at: list[np.ndarray], q: int, last: bool) -> tuple[int, list[tuple[str, str]]]:
    """The state behind all rows and, for each row, its edits (insertions before it come first) and the roles' letters they give
    (``-``: none). last: the conversation ends here, and a further entry holds what is inserted behind it."""
    out = []
    for k, (sym, n) in enumerate(runs):
        inner = [at[k + 1]]
        for _ in range(n):
            inner.append(times(power(sym, 0), inner[-1]))
        for j in range(n, 0, -1):
            before, after, edits, letters = inner[j], inner[j - 1], "", ""
            while True:
                fit = [("I", INSERT[q], ADD)] if before[INSERT[q]] + ADD == before[q] else []
                fit += [(e, to, c) for e, to, c in moves(sym, q) if after[to] + c == before[q]]
                edit, to, _ = min(fit)
                edits += edit
                letters += LETTER[q] if edit in "IR" else "-" if edit == "D" else told(sym)[0]
                q = to
                if edit != "I":
                    break
            out.append((edits, letters))
    if last:
        edits, letters = "", ""
        while END[q]:
            edits, letters, q = edits + "I", letters + LETTER[q], INSERT[q]
        out.append((edits, letters))
    return q, out


def lines(edits: str, letters: str, role: str, text: str) -> list[str]:
    """The repaired rows that a row's edits give."""
    of = {"I": lambda x: f"{NAMES[x]}:", "R": lambda x: f"{NAMES[x]}:{text}", "K": lambda x: f"{role}:{text}"}
    return [of[e](x) for e, x in zip(edits, letters, strict=True) if e != "D"]


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def repaired(rows: list[tuple]) -> dict:
    """What a conversation's rows (turn, role, text, copy) come to."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest(), r[3]))
    seen, faults = set(), []
    for _, role, text, _ in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ENDS else "")
        seen.add((role, text))
    runs = runs_of([symbol(r[1], f) for r, f in zip(rows, faults, strict=True)])
    at = costs(runs, END)
    _, every = unrolled(runs, at, 0, True)
    text = [x for (e, to), (_, role, t, _) in zip(every, [*rows, (0, "", "", 0)], strict=True) for x in lines(e, to, role, t)]
    turns = {t for t, *_ in rows if t is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": _illegal([r[1] for r in rows]), "cost": int(at[0][0]), "audit": "".join(e for e, _ in every),
        "repaired_sha256": hashlib.sha256("\n".join(text).encode()).hexdigest(),
    }


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ", ".join([*(f"{c} long" for c in NUMBERS), "audit string, repaired_sha256 string"])
SCHEMA = pa.schema([*((c, pa.int64()) for c in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) with the faults that their keys' hashes deal out."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(one("text"), ENDS, "")).otherwise(one("text"))
    out = rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), hit.alias("hit"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.where("hit <> 0").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.explode(copies).alias("copy"))


def _short(rows: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                p = b.slice(at, 256)
                got = pa.RecordBatch.from_pylist([repaired([(r["turn"], r["role"], r["text"], r["copy"]) for r in x]) for x in p.column("r").to_pylist()], SCHEMA)
                yield pa.record_batch([p.column("conv_id"), *got.columns], names=["conv_id", *SCHEMA.names])

    held = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text", "copy")).alias("r"))  # LONG_ROWS and LONG_BYTES at most
    return held.mapInArrow(tidied(run), f"conv_id {kind}, {RESULT}")


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; columns of a, then the others of b."""
    b = b.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in b.columns if c not in keys])
    out = a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]), how)
    return out if how.startswith("left_") else out.drop(*[f"{k}_" for k in keys])


def _long(rows: DataFrame, kind: str, n_rows: int, block_rows: int) -> DataFrame:
    """Results of conversations of any length."""
    key = ["conv_id", F.col("turn").isNotNull(), "turn", "role", "th", "copy", "any"]
    rows = rows.withColumn("th", F.sha2("text", 256)).withColumn("any", F.monotonically_increasing_id())
    # places follow the order; a partition is a block
    placed = rows.repartitionByRange(max(1, -(-n_rows // block_rows)), *key).sortWithinPartitions(*key)
    placed = staged(placed.withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", 33)).drop("any", "copy"), "placed")
    first = placed.groupBy("conv_id", "role", "th").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = _met(placed, first, ["conv_id", "role", "th"], "left")
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = F.when(bare == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.substring(bare, -1, 1).isin(*ENDS), "truncated").otherwise("")
    small = joined.select("conv_id", "block", "pos", "turn", F.substring("role", 1, 1).alias("role"), fault.alias("fault"))
    blocks = staged(small.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "fault"))).alias("r")), "blocks")

    def product(batches):
        for b in batches:
            out = []
            for x in b.column("r").to_pylist():
                runs, faults = runs_of([symbol(r["role"], r["fault"]) for r in x]), [r["fault"] for r in x]
                m = reduce(lambda after, run: advanced(run, after), reversed(runs), np.where(np.eye(4) > 0, 0, NEVER))
                out.append({"m": m.ravel().tolist(), "illegal": _illegal([r["role"] for r in x]), "a": x[0]["role"], "z": x[-1]["role"]} | {f: faults.count(f) for f in ("blank", "duplicate", "truncated")})
            got = pa.RecordBatch.from_pylist(out, pa.schema([("m", pa.list_(pa.int64())), *((c, pa.int64()) for c in NUMBERS[1:5]), ("a", pa.string()), ("z", pa.string())]))
            yield pa.record_batch([b.column("conv_id"), b.column("block"), *got.columns], names=["conv_id", "block", *got.schema.names])

    counted = ", ".join(f"{c} long" for c in NUMBERS[1:5])
    products = staged(blocks.mapInArrow(product, f"conv_id {kind}, block long, m array<long>, {counted}, a string, z string"), "products")

    def backwards(t: pa.Table) -> pa.Table:
        """The costs behind each block of a conversation, its least cost, and how many role changes between blocks are illegal."""
        x = sorted(t.to_pylist(), key=lambda r: r["block"])
        v, after = END, []
        for r in reversed(x):
            after.append(v.tolist())
            v = times(np.array(r["m"], np.int64).reshape(4, 4), v)
        n = sum(_illegal([p["z"], q["a"]]) for p, q in zip(x, x[1:]))
        return pa.table({"conv_id": t.column("conv_id"), "block": [r["block"] for r in x], "after": after[::-1], "last": [i == len(x) - 1 for i in range(len(x))], "cost": [int(v[0])] * len(x), "between": [n] * len(x)})

    scanned = products.select("conv_id", "block", "m", "a", "z").groupBy("conv_id").applyInArrow(backwards, f"conv_id {kind}, block long, after array<long>, last boolean, cost long, between long")
    scanned = staged(scanned, "scanned")
    both = _met(blocks, scanned, ["conv_id", "block"]).select("conv_id", "block", "r", "after", "last")

    edits_type = pa.list_(pa.struct([("pos", pa.int64()), ("e", pa.string()), ("to", pa.string())]))

    def choices(batches):
        for b in batches:
            for i in range(len(b)):
                x = b.column("r")[i].as_py()
                runs = runs_of([symbol(r["role"], r["fault"]) for r in x])
                at = costs(runs, np.array(b.column("after")[i].as_py(), np.int64))
                for q in range(4):
                    if at[0][q] >= NEVER:
                        continue
                    to, every = unrolled(runs, at, q, b.column("last")[i].as_py())
                    made = pa.array([[(r["pos"], e, t) for r, (e, t) in zip([*x, {"pos": None}], every)]], edits_type)
                    yield pa.record_batch([b.column("conv_id").slice(i, 1), b.column("block").slice(i, 1), pa.array([q]), pa.array([to]), made], names=["conv_id", "block", "q", "t", "edits"])

    chosen = staged(both.mapInArrow(tidied(choices), f"conv_id {kind}, block long, q long, t long, edits array<struct<pos: long, e: string, to: string>>"), "choices")

    def forwards(t: pa.Table) -> pa.Table:
        """Which of a block's four starts is the one that is reached."""
        step = {(r["block"], r["q"]): r["t"] for r in t.select(["block", "q", "t"]).to_pylist()}
        q, out = 0, []
        for block in sorted({k for k, _ in step}):
            out.append((block, q))
            q = step[block, q]
        return pa.table({"conv_id": t.column("conv_id").slice(0, 1).take(pa.array([0] * len(out))), "block": [k for k, _ in out], "q": [q for _, q in out]})

    path = staged(chosen.select("conv_id", "block", "q", "t").groupBy("conv_id").applyInArrow(forwards, f"conv_id {kind}, block long, q long"), "path")
    edits = _met(chosen, path, ["conv_id", "block", "q"], "left_semi").select("conv_id", F.explode("edits").alias("x")).select("conv_id", "x.*")
    edits = staged(edits, "edits")
    rows_of = placed.join(edits.where("pos is not null").select("pos", "e", "to"), "pos").select("conv_id", "pos", "e", "to", "role", "text")
    behind = edits.where("pos is null and e <> ''").select("conv_id", F.lit((1 << 63) - 1).alias("pos"), "e", "to", F.lit("").alias("role"), F.lit("").alias("text"))

    def digests(batches):
        """Sorted rows as a stream: a digest and the edits of each conversation."""
        now, h, audit, some, kept = None, None, [], False, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("e", "to", "role", "text")]
            for i, (name, e, to, role, text) in enumerate(zip(b.column("conv_id").to_pylist(), *cols, strict=True)):
                if h is None or name != now:
                    if h is not None:
                        yield pa.record_batch([kept, pa.array(["".join(audit)]), pa.array([h.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])
                    now, h, audit, some, kept = name, hashlib.sha256(), [], False, b.column("conv_id").slice(i, 1)
                audit.append(e)
                for line in lines(e, to, role, text):
                    h.update(("\n" * some + line).encode())
                    some = True
        if h is not None:
            yield pa.record_batch([kept, pa.array(["".join(audit)]), pa.array([h.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

    stream = rows_of.unionByName(behind).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    digest = stream.mapInArrow(tidied(digests), f"conv_id {kind}, audit string, repaired_sha256 string")
    turns = placed.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("g")).select("conv_id", F.coalesce("g", F.lit(0)).alias("gaps"))
    sums = products.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in NUMBERS[1:5]])
    cost = scanned.groupBy("conv_id").agg(F.first("cost").alias("cost"), F.first("between").alias("between"))
    out = reduce(lambda a, b: _met(a, b, ["conv_id"]), (turns, cost, digest), sums)
    return out.withColumn("illegal", F.col("illegal") + F.col("between")).select("conv_id", *NUMBERS, "audit", "repaired_sha256")


def repair(rows: DataFrame, conversations: DataFrame | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text, copy), and for those of ``conversations`` that have none."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b"))
    long = staged(sizes.where((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select("conv_id", "n"), "long")
    n = long.agg(F.sum("n")).first()[0] or 0
    if n:  # Spark broadcasts the few long ones where they are few, and splits a join's large partitions where not
        out = _short(_met(rows, long, ["conv_id"], "left_anti"), kind).unionByName(_long(_met(rows, long, ["conv_id"], "left_semi"), kind, n, block_rows))
    else:
        out = _short(rows, kind)
    if conversations is not None:
        ids = conversations.select("conv_id").distinct()
        out = _met(ids, out, ["conv_id"], "left").select(
            "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    return out


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), rows)


_KEY = "coalesce(conv_id::VARCHAR, ' ')"
_NAME = "CASE WHEN (p - m % 2) % 2 = 1 THEN 'user:' ELSE 'assistant:' END"
OP13_SQL = rf"""WITH RECURSIVE o AS (SELECT conv_id, {_KEY} AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KEY} || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, {CRC_SQL.format("key")} % 20 AS hit FROM o),
d AS (SELECT k, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE hit <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) AS c FROM d),
r AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS s, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN c > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][ 	-
]*$') THEN '' ELSE 't' END AS f FROM n),
ins(q0, n, q) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
act(q, e, s, t, c) AS (VALUES (0, 'D', '', 0, 3), (1, 'D', '', 1, 3), (2, 'D', '', 2, 3), (3, 'D', '', 3, 3), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
  (3, 'K', 'u', 2, 0), (0, 'R', '', 2, 2), (1, 'R', '', 2, 2), (2, 'R', '', 3, 2), (3, 'R', '', 2, 2)),
v AS (SELECT k, count(*) + 1 AS i, e.q, {{'c': e.c, 'a': e.a}} AS b FROM r, (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) e(q, c, a) GROUP BY ALL
  UNION ALL SELECT v.k, v.i - 1, ins.q0, min({{'c': v.b.c + act.c + 2 * ins.n + CASE WHEN r.f = 't' AND act.e <> 'D' THEN 1 ELSE 0 END, 'a': repeat('I', ins.n) || act.e || v.b.a}})
  FROM v JOIN r ON r.k = v.k AND r.i = v.i - 1 JOIN act ON act.t = v.q JOIN ins ON ins.q = act.q WHERE act.e = 'D' OR r.f NOT IN ('b', 'd') AND (act.e = 'R' OR act.s = r.s) GROUP BY v.k, v.i, ins.q0),
best AS (SELECT k, b.c AS cost, b.a AS audit FROM v WHERE i = 1 AND q = 0),
e AS (SELECT k, j, substr(audit, j, 1) AS e FROM (SELECT k, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
g AS (SELECT *, count(*) FILTER (e <> 'D') OVER (PARTITION BY k ORDER BY j) AS p, count(*) FILTER (e <> 'I') OVER (PARTITION BY k ORDER BY j) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY k) AS m FROM e),
t AS (SELECT g.k, string_agg(CASE e WHEN 'K' THEN role || ':' || text WHEN 'R' THEN {_NAME} || text ELSE {_NAME} END, chr(10) ORDER BY j) AS t FROM g LEFT JOIN r ON r.k = g.k AND r.i = g.i WHERE e <> 'D' GROUP BY g.k),
l AS (SELECT k, turn, f, s, lag(s) OVER (PARTITION BY k ORDER BY i) AS s0 FROM r),
a AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
  count(*) FILTER (s0 IS NOT NULL AND s0 || s NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY k)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM o) c LEFT JOIN a USING (k) LEFT JOIN best USING (k) LEFT JOIN t USING (k)"""
