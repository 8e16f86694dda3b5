"""Problem 2: cutting oversized texts at natural boundaries, by structure-tree packing."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_LINE = re.compile(r"[^\n\f]*[\n\f]?")
_HEADING = re.compile(r"(#{1,6}) ")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})([^\n\f]*)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？])")
_WORD = re.compile(r"\s+")


def _lines(text: str) -> list[tuple[int, int]]:
    """Lines end with a line feed or a form feed, which is part of the line it ends."""
    return [(m.start(), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]


def _listings(text: str, lines: list[tuple[int, int]]) -> list[bool]:
    """Per line, whether it follows an opening fence and belongs to that listing up to the closing fence."""
    fences = [m and (m[1], m[2].strip()) for m in (_FENCE.match(text, a, b) for a, b in lines)]
    bare: dict[str, list[int]] = {}
    for k, f in enumerate(fences):
        if f and not f[1]:
            bare.setdefault(f[0], []).append(k)
    inside = [False] * len(lines)
    k = 0
    while k < len(lines):
        f = fences[k]
        if f and not (f[0][0] == "`" and "`" in f[1]):
            later = bare.get(f[0], [])
            at = bisect_right(later, k)
            if at < len(later):
                inside[k + 1 : later[at] + 1] = [True] * (later[at] - k)
                k = later[at]
        k += 1
    return inside


def block_starts(text: str) -> list[tuple[int, int]]:
    """(offset, heading level or 0) of every block, in order.

    Blocks are parted by lines without visible characters and by form feeds; a line of one to six #
    and a space is a block by itself; inside a listing between equal fences nothing parts.
    """
    lines = _lines(text)
    inside = _listings(text, lines)
    out: list[tuple[int, int]] = []
    fresh = True
    for k, ((a, b), listed) in enumerate(zip(lines, inside)):
        body = text[a:b]
        if listed:  # a form feed parts again once it stands behind the closing fence
            fresh = body.endswith("\f") and (k + 1 == len(lines) or not inside[k + 1])
            continue
        if not body.strip():
            fresh = True
            continue
        head = _HEADING.match(body)
        if head or fresh:
            out.append((a, len(head[1]) if head else 0))
        fresh = bool(head) or body.endswith("\f")
    return out


def _cut(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """Cut one oversized block at line starts, else sentence ends, else blanks, else anywhere."""
    for marks in ([b for _, b in _lines(text[start:end])], [m.end() for m in _SENTENCE.finditer(text[start:end])], [m.end() for m in _WORD.finditer(text[start:end])]):
        bounds = [start, *[start + m for m in marks if 0 < m < end - start], end]
        if len(bounds) > 2:
            parts = []
            for a, b in zip(bounds, bounds[1:]):
                parts += [(a, b)] if b - a <= limit else _cut(text, a, b, limit) if (a, b) != (start, end) else []
            return _merge(parts, limit)
    return [(a, min(a + limit, end)) for a in range(start, end, limit)]


def _merge(parts: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if out and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def tree_of(text: str) -> dict:
    """The structure tree: a section holds its heading, its blocks and the deeper sections; leaves are blocks, which tile the text.

    ``at`` is a block's first character; blank lines before the first block belong to that block's range.
    """
    starts = block_starts(text)
    root: dict = {"level": 0, "start": 0, "end": len(text), "children": []}
    stack = [root]
    for k, (at, level) in enumerate(starts):
        a, b = at if k else 0, starts[k + 1][0] if k + 1 < len(starts) else len(text)
        leaf = {"start": a, "end": b, "at": at}
        if level:
            while stack[-1]["level"] >= level:
                stack.pop()["end"] = a
            section = {"level": level, "start": a, "end": len(text), "children": [leaf]}
            stack[-1]["children"].append(section)
            stack.append(section)
        else:
            stack[-1]["children"].append(leaf)
    return root


def leaves(node: dict) -> list[dict]:
    """The blocks of a tree, in order."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if "children" in n:
            todo += reversed(n["children"])
        else:
            out.append(n)
    return out


def pack(text: str, limit: int) -> list[tuple[int, int]]:
    """Ranges of at most ``limit`` characters that tile ``text`` and start at block starts where possible.

    A node of the structure tree that fits is one piece; only an oversized node is entered, and its
    children's pieces are merged with their siblings up to the limit.
    """
    root = tree_of(text)
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    if not root["children"]:
        return _cut(text, 0, len(text), limit)

    def walk(node: dict) -> list[tuple[int, int]]:
        if node["end"] - node["start"] <= limit:
            return [(node["start"], node["end"])]
        if "children" not in node:
            return _cut(text, node["start"], node["end"], limit)
        return _merge([p for c in node["children"] for p in walk(c)], limit)

    return walk(root)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, repeated): pieces of at most ``limit``; each but the first repeats ``overlap`` characters of the one before."""
    return [(max(0, a - overlap), b, a - max(0, a - overlap)) for a, b in pack(text, limit - overlap)]


def _oversized(df: DataFrame, id_col: str, text_col: str, limit: int, keep: list[str]) -> DataFrame:
    rows = df.where(F.col(id_col).isNotNull() & (F.length(text_col) > limit))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct(F.col(text_col).alias("text"), *keep)).alias("r")).select("id", "r.*")


def split_blocks(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", limit: int = 1500) -> DataFrame:
    """(id, cut_char): the first character of every leaf of the structure trees of the texts longer than ``limit``.

    Null ids and null or shorter texts give no row; a repeated id counts once; offsets count code points.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [[leaf["at"] for leaf in leaves(tree_of(t))] for t in batch.column(1).to_pylist()]
            spread = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(spread), pa.array([a for f in found for a in f], pa.int64())], names=["id", "cut_char"])

    return _oversized(df, id_col, text_col, limit, []).mapInArrow(run, f"id {kind}, cut_char bigint")


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", position_col: str | None = "position", limit: int = 1500, overlap: int = 150) -> DataFrame:
    """(id, piece_no, text, offset_start, offset_end, repeated, start_char, end_char) of every text over ``limit``.

    Pieces are at most ``limit`` long, repeat ``overlap`` characters of the piece before (``repeated``),
    and start, apart from these, at block starts where possible; without the repeats they tile the
    text exactly. ``offset_*`` count code points within the text; ``start_char`` and ``end_char`` add
    the chunk's own ``position.start_char`` and are null where that is null (the chunk's end_char is
    not used: it may disagree with the text). Null ids, null texts and texts within the limit give no
    row; a repeated id counts once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    kind = df.schema[id_col].dataType.simpleString()
    base = [F.col(f"{position_col}.start_char").cast("bigint").alias("base")] if position_col else [F.lit(None).cast("bigint").alias("base")]

    def run(batches):
        for batch in batches:
            rows = []
            for k, (text, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for n, (a, b, repeated) in enumerate(pieces(text, limit, overlap)):
                    rows.append((k, n, text[a:b], a, b, repeated, None if at is None else at + a, None if at is None else at + b))
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), *[pa.array(c, pa.int64()) for c in cols[3:]]],
                names=["id", "piece_no", "text", "offset_start", "offset_end", "repeated", "start_char", "end_char"],
            )

    return _oversized(df, id_col, text_col, limit, base).mapInArrow(run, f"id {kind}, piece_no int, text string, offset_start bigint, offset_end bigint, repeated bigint, start_char bigint, end_char bigint")
