"""Cutting texts: word windows, token windows, paragraph packing, character windows, sections, semantic chunks.

Word windows and numbering are closed forms in DataFrame functions. The others depend on where the last chunk ended, so
they fold over one text (or the sections of one document) inside Arrow batches; nothing shuffles but section folds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpipe.functions.text import words

# Boundary patterns with priorities, abbreviations that end no sentence, marks and endings of plain windows.
BOUNDARIES = (
    (("\n\n", "\r\n\r\n"), 4),
    ((".\n\n", "!\n\n", "?\n\n"), 4),
    ((".\n", "!\n", "?\n"), 3),
    ((". ", "! ", "? "), 3),
    ((".\"", "!\"", "?\""), 3),
    ((".)", "!]", "?}"), 3),
    ((",\n", ";\n", ":\n"), 2),
    ((", ", "; ", ": "), 2),
    (("\n", "\r\n"), 1),
    ((" ", "\t"), 0),
)
ABBREVIATIONS = (
    "т.д.", "т.п.", "т.е.", "т.к.", "т.н.", "т.о.", "др.", "проф.", "акад.", "стр.", "рис.", "гл.", "e.g.", "i.e.", "etc.", "vs.",
    "Mr.", "Mrs.", "Dr.", "Prof.", "Inc.", "Ltd.", "Corp.", "Co.", "табл.", "разд.", "п.", "с.",
)
BY_END = {c: [(held, n) for marks, n in BOUNDARIES if (held := tuple(m for m in marks if m[-1] == c))] for c in {m[-1] for marks, _ in BOUNDARIES for m in marks}}  # last character: marks
PLAIN_MARKS, PLAIN_ABBREVIATIONS = ".;:!?)]}", ("т.д.", "т.п.")

HELD = 1 << 20  # characters that are held at once of what goes on as an Arrow batch
ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

TOKEN = re.compile(r"\s+|\w+|[^\w\s]+?")


def regex_tokens(text: str) -> list[str]:
    """Lossless tokens: joined they are the text."""
    return TOKEN.findall(text)


def word_windows(df: DataFrame, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """df plus chunk_index and content: windows of size words, the next one starting overlap words before the last one's end."""
    step = size - overlap
    w = df.withColumn("_w", words(F.col(text))).where(F.size("_w") > 0)
    last = F.when(F.size("_w") <= size, 0).otherwise(F.ceil((F.size("_w") - size) / F.lit(step)).cast("int"))
    at = F.explode(F.sequence(F.lit(0), last))
    return w.select(*df.columns, "_w", at.alias("chunk_index")).withColumn("content", F.array_join(F.slice("_w", F.col("chunk_index") * step + 1, size), " ")).drop("_w")


def numbered(chunks: DataFrame, doc: str, *order: str) -> DataFrame:
    """chunk_index from 0 across the sections of a document, and total_chunks."""
    w = Window.partitionBy(doc)
    return chunks.withColumn("chunk_index", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total_chunks", F.count("*").over(w))


def _ends_sentence(context: str, mark: str) -> bool:
    bare = context.rstrip()
    return not any(bare.endswith(a) or (a + mark) in context[-len(a) - len(mark) - 1 :] for a in ABBREVIATIONS)


def token_cut(tokens: list[str], start: int, end: int, most: int) -> int:
    """Where a window [start, end) that could go on is better cut; end if nowhere."""
    if end - start < 10:
        return end
    best, found = -1, 0
    text = "".join(tokens[start:end])
    place = len(text) - len(tokens[end - 1])
    for i in range(end - 1, start + most * 4 // 5 - 1, -1):
        for marks, priority in BY_END.get(text[place - 1 : place], ()):
            if not text.endswith(marks, 0, place):
                continue
            if priority >= 3:
                if _ends_sentence(text[max(0, place - 40) : place], next(m for m in marks if text.endswith(m, 0, place))):
                    return i
            elif priority > best:
                best, found = priority, i
        place -= len(tokens[i - 1])
    if best >= 0 and found >= start + most // 3:
        return found
    blank = next((i for i in range(end, start + most * 3 // 4, -1) if tokens[i - 1].isspace()), 0)
    return blank if blank > start + most // 2 else end


def token_windows_of(text: str, tokenizer: Callable = regex_tokens, most: int = 8192, overlap: int | None = None) -> list[tuple]:
    """(chunk_index, content, token_count, start_token, end_token, total_chunks) with priority boundaries; total_chunks is the
    quotient of tokens and window size, rounded up, as it was planned and not as it came out."""
    overlap = min(most // 10, 256) if overlap is None else overlap
    if overlap * 3 >= most:
        raise ValueError("overlap must be less than a third of the window")
    tokens, out, start = tokenizer(text or ""), [], 0
    while start < len(tokens):
        end = min(start + most, len(tokens))
        if end < len(tokens):
            end = token_cut(tokens, start, end, most)
        out.append((len(out), "".join(tokens[start:end]), end - start, start, end, -(-len(tokens) // most)))
        if end >= len(tokens):
            break
        start = end - overlap if end > overlap and end - overlap > start else end
    return out


def plain_windows_of(text: str, tokenizer: Callable = regex_tokens, most: int = 512, overlap: int = 50) -> list[tuple]:
    """As token_windows_of; backs up, not past half, to a token that ends a clause and cuts before it."""
    tokens, out, start = tokenizer(text or ""), [], 0
    while start < len(tokens):
        end = min(start + most, len(tokens))
        if end < len(tokens):
            for i in range(end - 1, start + most // 2, -1):
                if (tokens[i] or tokens[i - 1])[-1] in PLAIN_MARKS and not "".join(tokens[max(0, i - 3) : i + 1]).endswith(PLAIN_ABBREVIATIONS):
                    end = i
                    break
        out.append((len(out), "".join(tokens[start:end]), end - start, start, end))
        if end >= len(tokens):
            break
        start = end - overlap if end - overlap > start else end
    return out


WINDOW = "chunk_index int, content string, token_count int, start_token int, end_token int"


def exploded(df: DataFrame, text: str, cut: Callable[[str], list[tuple]], schema: str, keep: list[str] | None = None) -> DataFrame:
    """df, one row per piece that cut gives for its text (null: empty); columns that bear a piece's name are replaced. keep: the
    columns of df that stand beside the pieces, all if not given; a text that is kept goes on once a piece."""
    made = {x.split()[0]: ARROW[x.split()[1]] for x in schema.split(", ")}
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    wide = [c for c in kept if df.schema[c].dataType.simpleString() in ("string", "binary")]

    def run(batches):
        for b in batches:
            texts, own, at, rows, held = b.column(text), [b.column(c) for c in kept], [], [], 0
            beside = sum((pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(int) for c in wide), np.zeros(b.num_rows, int)).tolist()

            def batch():
                cols = zip(*rows, strict=True) if rows else [[]] * len(made)
                i = pa.array(at, pa.int64())
                return pa.record_batch([*(c.take(i) for c in own), *(pa.array(c, t) for c, t in zip(cols, made.values(), strict=True))], names=[*kept, *made])

            for i in range(b.num_rows):
                for piece in cut(texts[i].as_py() or ""):
                    at.append(i)
                    rows.append(piece)
                    held += beside[i] + sum(len(x) for x in piece if isinstance(x, str)) + 64
                    if held >= HELD:
                        yield batch()
                        at, rows, held = [], [], 0
            yield batch()

    columns = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    given = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    return given.mapInArrow(run, f"{columns}, {schema}" if kept else schema)


def folded(fold: Callable[[list[tuple]], list[tuple]], made: dict[str, pa.DataType]) -> Callable:
    """A sweep over rows (doc, ...) sorted by doc: what fold makes of the rows (without doc) of each. A task holds one document."""

    def run(batches):
        docs, out, kind, held, now, rows = [], [], None, 0, None, []

        def end():
            nonlocal held
            got = fold(rows)
            docs.extend([now] * len(got))
            out.extend(got)
            held += sum(len(x) for r in got for x in r if isinstance(x, str)) + 64 * len(got)

        def batch():
            cols = zip(*out, strict=True) if out else [[]] * len(made)
            return pa.record_batch([pa.array(docs, kind), *(pa.array(c, t) for c, t in zip(cols, made.values(), strict=True))], names=["doc", *made])

        for whole in batches:
            kind = whole.schema.field("doc").type
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                for doc, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if rows and doc != now:
                        end()
                        rows = []
                        if held >= HELD:
                            yield batch()
                            docs, out, held = [], [], 0
                    now = doc
                    rows.append(tuple(row))
        if rows:
            end()
        if kind is not None:
            yield batch()

    return run


def token_windows(df: DataFrame, text: str, tokenizer: Callable = regex_tokens, most: int = 8192, overlap: int | None = None, keep: list[str] | None = None) -> DataFrame:
    return exploded(df, text, lambda t: token_windows_of(t, tokenizer, most, overlap), WINDOW + ", total_chunks int", keep)


def plain_windows(df: DataFrame, text: str, tokenizer: Callable = regex_tokens, most: int = 512, overlap: int = 50, keep: list[str] | None = None) -> DataFrame:
    return exploded(df, text, lambda t: plain_windows_of(t, tokenizer, most, overlap), WINDOW, keep)


def char_windows_of(text: str, size: int = 512, overlap: int = 50, emit_tail: bool = True, blank_line: bool = True) -> list[tuple]:
    """(content, is_overlap): windows of size characters, extended to the next sentence end, else to the next blank line."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            stop = min((p for p in (text.find(m, end) for m in ".!?") if p >= 0), default=-1)
            if stop < 0 and blank_line:
                stop = text.find("\n\n", end) - 1 if text.find("\n\n", end) >= 0 else -1
            end = stop + 1 if stop >= 0 else end
        if piece := text[start:end].strip():
            out.append((piece, start > 0))
        if end >= len(text) and (not emit_tail or start and end - start <= overlap):
            break
        start = end - overlap if end - start > overlap else end
    return out


def pack_paragraphs_of(text: str, size: int = 512, overlap: int = 0, separator: str = "\n\n") -> list[tuple]:
    """(content, is_overlap): paragraphs packed up to size characters; with overlap, trailing paragraphs seed the next chunk."""
    out: list[tuple] = []
    held: list[str] = []
    length = 0  # of held, joined
    for p in filter(None, (x.strip() for x in text.split(separator))):
        if held and length + len(separator) + len(p) > size:
            out.append((separator.join(held), False))
            seed: list[str] = []
            taken = 0
            while overlap > 0 and held and (not seed or taken < overlap):
                seed.append(held.pop())
                taken += len(seed[-1])
            held = seed[::-1]
            length = taken + len(separator) * max(0, len(held) - 1)
            if held:
                out.append((separator.join(held), True))
        if len(p) > size:
            if held:
                out.append((separator.join(held) + separator, False))
            out += char_windows_of(p, size, overlap, blank_line=False)
            held, length = [], 0
        else:
            length += len(p) + len(separator) * bool(held)
            held.append(p)
    if held:
        out.append((separator.join(held), False))
    return out


def chunk_sections(sections: DataFrame, by_paragraphs: bool = True, size: int = 512, overlap: int = 50, separator: str = "\n\n") -> DataFrame:
    """sections (uri, section_index, content, ...) to chunks with running chunk_index, total_chunks and char_count."""

    def cut(t: str):
        got = pack_paragraphs_of(t, size, overlap, separator) if by_paragraphs else char_windows_of(t, size, overlap)
        return [(i, c, o) for i, (c, o) in enumerate(got)]

    pieces = exploded(sections, "content", cut, "local int, content string, is_overlap boolean")
    return numbered(pieces, "uri", "section_index", "local").drop("local").withColumn("char_count", F.length("content"))


def semantic_chunks(sections: DataFrame, tokenizer: Callable = regex_tokens, most: int = 512, overlap: int = 50) -> DataFrame:
    """Sections (doc, section_index, heading, content, section_type) of each document joined until the budget is passed or a
    heading or paragraph section begins; every closed chunk but the first is led by the last tokens of the one before."""
    def fold(rows):
        chunks: list[list] = []
        held, kinds = "", []

        def close(final: bool):
            nonlocal held, kinds
            if held.strip():
                lead = tokenizer(chunks[-1][0])[-overlap:] if chunks and not final and overlap else []
                chunks.append(["".join(lead) + held, ["legal_document", *dict.fromkeys(kinds)]])
            held, kinds = "", []

        for _, heading, content, kind in rows:
            body = "\n".join(x for x in (heading, content) if x)
            if held and (kind in ("Header", "Paragraph") or len(tokenizer(held)) + len(tokenizer(body)) > most):
                close(False)
            held, kinds = f"{held}\n\n{body}" if held else body, [*kinds, kind]
        close(True)
        return [(i, c, len(tokenizer(c)), t, len(chunks)) for i, (c, t) in enumerate(chunks)]

    schema = "chunk_index int, content string, token_count int, tags array<string>, total_chunks int"
    dealt = sections.select(F.col("doc").cast("string").alias("doc"), "section_index", "heading", "content", "section_type").repartition("doc").sortWithinPartitions("doc", "section_index")
    return dealt.mapInArrow(folded(fold, {x.split()[0]: ARROW[x.split()[1]] for x in schema.split(", ")}), f"doc string, {schema}")
