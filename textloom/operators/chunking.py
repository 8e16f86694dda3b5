"""Chunking strategies: one document to many chunks.

Strategies whose windows follow from lengths alone are expressions; those that fold over parts are
Arrow UDFs over whole batches. Lengths count code points.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.functions.text import chunk_id, document_id, normalize_text, project_chunk_id, short_hash, token_estimate
from textloom.operators.ranking import ranked_by_ranges
from textloom.schema import ChunkConfig

_HEADING = re.compile(r"(?m)^(#{1,6})\s+(.*)$")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` every size - overlap characters, a trailing window of overlap only included; none for an empty text."""
    if overlap >= size:
        raise ValueError("overlap must be less than the size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def covering_windows(text: Column, size: int, overlap: int) -> Column:
    """(start, text) windows that stop once one reaches the end, so none repeats the overlap only."""
    if overlap >= size:
        raise ValueError("overlap must be less than the size")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int") * step
    windows = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("text")))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def pages(text: Column) -> Column:
    """Parts between form feeds or runs of at least four line feeds; parts without visible characters are dropped."""
    return F.filter(F.split(text, "\\f|\\n{4,}", -1), lambda p: F.length(F.trim(F.regexp_replace(p, r"\s+", " "))) > 0)


def _pack(parts: list[str], size: int, joint: str) -> list[str]:
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(joint) + len(p) <= size:
            out[-1] += joint + p
        else:
            out.append(p)
    return out


def split_sentences(text: str, cfg: ChunkConfig) -> list[str]:
    """Sentences packed with single blanks up to the size; a longer sentence stays whole."""
    return _pack([s for s in re.split(r"(?<=[.!?])\s+", text) if s], cfg.max_chars, " ")


def split_paragraphs(text: str, cfg: ChunkConfig) -> list[str]:
    """Paragraphs packed with blank lines up to the size; a longer one stays whole."""
    return _pack([p.strip() for p in re.split(r"\n{2,}", text) if p.strip()], cfg.max_chars, "\n\n")


def sections(text: str) -> list[tuple[int, str, str]]:
    """(level, heading line, body) by ATX headings; what comes before the first has level 0 and no heading."""
    marks = list(_HEADING.finditer(text))
    out = []
    if not marks or marks[0].start() > 0:
        out.append((0, "", text[: marks[0].start()] if marks else text))
    for m, after in zip(marks, [*marks[1:], None]):
        out.append((len(m[1]), m[0].rstrip(), text[m.end() : after.start() if after else len(text)]))
    return out


def split_headings(text: str, cfg: ChunkConfig) -> list[str]:
    """Sections by heading, each body packed by paragraphs with its heading repeated; then neighbours merged up to the size."""
    parts = []
    for _, heading, body in sections(text):
        room = max(1, cfg.max_chars - len(heading) - 1)
        packed = _pack([p.strip() for p in re.split(r"\n{2,}", body) if p.strip()], room, "\n\n")
        parts += [f"{heading}\n{p}" if heading else p for p in packed]
    return _pack(parts, cfg.max_chars, "\n\n")


WHOLE = -1


def _atoms(text: str, cfg: ChunkConfig) -> Iterator[tuple[str | None, str, int]]:
    """(piece, separator, group) in order: pieces of at most max_chars, cut at the first separator that splits; larger ones are cut at the later separators, as a group of their own, in the end by windows of group WHOLE. A group begins with None."""
    numbers = itertools.count()
    todo: list[tuple[str, tuple[str, ...], str, int]] = [(text, tuple(cfg.separators), "", WHOLE)]
    while todo:
        t, separators, sep, group = todo.pop()
        if len(t) <= cfg.max_chars:
            yield t, sep, group
            continue
        k = next((k for k, x in enumerate(separators) if x in t), None)
        if k is None:
            for i in range(0, len(t), cfg.max_chars - cfg.overlap_chars):
                yield t[i : i + cfg.max_chars], "", WHOLE
        else:
            own = next(numbers)
            yield None, "", own
            todo += [(p, separators[k + 1 :], separators[k], own) for p in reversed(t.split(separators[k]))]


def split_recursive(text: str, cfg: ChunkConfig) -> list[str]:
    """By the first separator that splits, packed up to the size; an oversized part by the later separators, else by windows.

    A part shorter than min_chars joins the chunk before it, or the one after it at the start; so no
    text is lost. With ``compat`` a short part joins what is before even beyond the size, and is
    dropped where there is nothing before. Chunks from the second on begin with the last
    overlap_chars of the one before.
    """

    out: list[str] = []
    begins: dict[int, int] = {}
    held, of, joint = "", -1, ""

    def settle() -> None:
        if not held:
            return
        before = len(out) > begins[of]
        if len(held) >= cfg.min_chars:
            out.append(held)
        elif before and (cfg.compat or len(out[-1]) + len(joint) + len(held) <= cfg.max_chars):
            out[-1] += joint + held
        elif not cfg.compat:
            out.append(held)

    for piece, sep, group in _atoms(text, cfg):
        if piece is not None and group == of and held and len(held) + len(sep) + len(piece) <= cfg.max_chars:
            held += sep + piece
            continue
        settle()
        held, of, joint = piece or "", group, sep
        if piece is None:
            begins[group] = len(out)
        elif group == WHOLE:  # windows and texts that fit stand as they are
            out.append(held)
            held = ""
    settle()
    chunks = [c for c in out if c]
    if cfg.overlap_chars and len(chunks) > 1:
        chunks = [chunks[0], *(a[-cfg.overlap_chars :] + b for a, b in zip(chunks, chunks[1:]))]
    return chunks


def split_hierarchical(text: str, cfg: ChunkConfig) -> list[tuple[str, int, int, str | None]]:
    """(text, level, index of the parent chunk or -1, parent context): one chunk per heading with a body.

    A chunk is kept if it has min_chars or is the first. The parent is the nearest earlier chunk of a
    shallower level; a heading without a body, or one that is dropped, is no parent, and a chunk of
    some level hides the earlier ones of that and deeper levels.
    """
    out: list[tuple[str, int, int, str | None]] = []
    open_: dict[int, int] = {}
    for level, heading, body in sections(text):
        body = body.strip()
        if not body:
            continue
        chunk = f"{heading}\n{body}" if heading else body
        if len(chunk) < cfg.min_chars and out:
            continue
        up = max((lv for lv in open_ if lv < level), default=None)
        parent = -1 if up is None or not cfg.create_parent_chunks else open_[up]
        out.append((chunk, level, parent, out[parent][0][: cfg.parent_context_chars] if parent >= 0 else None))
        open_ = {lv: k for lv, k in open_.items() if lv < level}
        open_[level] = len(out) - 1
    return out


def split_text(text: str, strategy: str = "recursive", max_chars: int = 1500, overlap_chars: int = 150) -> list[str]:
    """The chunks of one text by a strategy that folds over it (recursive, by_sentence, by_paragraph, by_heading)."""
    if strategy not in _FOLDS:
        raise ValueError(f"strategy must be one of {', '.join(_FOLDS)}")
    return _FOLDS[strategy](text, ChunkConfig(strategy=strategy, max_chars=max_chars, overlap_chars=overlap_chars))


_FOLDS: dict[str, Callable[[str, ChunkConfig], list[str]]] = {"by_sentence": split_sentences, "by_paragraph": split_paragraphs, "by_heading": split_headings, "recursive": split_recursive}
_PIECE = T.StructType([T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("context", T.StringType())])


def pieces(text: Column, cfg: ChunkConfig) -> Column:
    """array<struct<text, level, parent, context>>: the chunks of one text by any strategy."""
    if cfg.strategy in ("fixed_chars", "by_page"):
        parts = fixed_windows(text, cfg.max_chars, cfg.overlap_chars) if cfg.strategy == "fixed_chars" else pages(text)
        return F.transform(parts, lambda t: F.struct(t.alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("string").alias("context")))

    @F.pandas_udf(T.ArrayType(_PIECE))
    def fold(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return []
            if cfg.strategy == "hierarchical":
                return [dict(zip(("text", "level", "parent", "context"), p)) for p in split_hierarchical(t, cfg)]
            return [{"text": c, "level": None, "parent": None, "context": None} for c in _FOLDS[cfg.strategy](t, cfg)]

        return texts.map(one)

    return fold(text)


def chunk_documents(df: DataFrame, cfg: ChunkConfig = ChunkConfig(), text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, text, byte_start, byte_end, char_count, token_estimate, hierarchy_level, parent_id, parent_context, *keep).

    Texts are normalised first; doc_id is the hash of the normalised text, so equal texts are one
    document and give their chunks once per row of ``keep`` values. Byte offsets are the running
    lengths of the chunks emitted. Null and empty texts give no row. Clashing names in ``keep`` raise.
    """
    keep = keep or []
    rows = df.where(F.col(text_col).isNotNull()).select(normalize_text(F.col(text_col)).alias("__t"), *keep)
    parts = rows.select(document_id(F.col("__t")).alias("doc_id"), *keep, pieces(F.col("__t"), cfg).alias("__p"))
    sizes = F.transform("__p", lambda p: F.octet_length(p["text"]).cast("bigint"))
    ends = F.aggregate(sizes, F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    exploded = parts.select("doc_id", *keep, "__p", ends.alias("__e"), F.posexplode("__p").alias("chunk_index", "__c"))
    start, end = F.get("__e", F.col("chunk_index")), F.get("__e", F.col("chunk_index") + 1)
    parent = F.col("__c.parent")
    return exploded.select(
        "doc_id", chunk_id(F.col("doc_id"), start, end).alias("chunk_id"), "chunk_index", F.col("__c.text").alias("text"), start.alias("byte_start"), end.alias("byte_end"),
        F.length("__c.text").alias("char_count"), token_estimate(F.col("__c.text")).alias("token_estimate"), F.col("__c.level").alias("hierarchy_level"),
        F.when(parent >= 0, chunk_id(F.col("doc_id"), F.get("__e", parent), F.get("__e", parent + 1))).alias("parent_id"), F.col("__c.context").alias("parent_context"), *keep,
    )


def chunk_project(df: DataFrame, source_col: str, order_col: str, text_col: str = "text", size: int = 1500, overlap: int = 150, seen: DataFrame | None = None) -> DataFrame:
    """(chunk_id, source_id, chunk_index, text, start_char, end_char, content_hash): chunks of whole sources.

    Windows as in covering_windows. A chunk whose content hash came before, in the order of
    (source, order_col, start), or is in ``seen`` (content_hash), is skipped and not numbered. Null
    sources, orders and texts give no row.
    """
    rows = df.where(F.col(source_col).isNotNull() & F.col(order_col).isNotNull() & F.col(text_col).isNotNull())
    parts = rows.select(F.col(source_col).alias("source_id"), F.col(order_col).alias("__o"), F.explode(covering_windows(F.col(text_col), size, overlap)).alias("w"))
    hashed = parts.select("source_id", "__o", F.col("w.start").alias("start_char"), F.col("w.text").alias("text"), short_hash(F.col("w.text")).alias("content_hash"))
    # of all places of one content the first holds; an aggregate combines before the shuffle, so hot contents are no hot groups
    place = F.struct("source_id", "__o", "start_char")
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(place.alias("p"), F.col("text"))).alias("r")).select("content_hash", "r.p.*", "r.text")
    if seen is not None:
        first = first.join(seen.select("content_hash").distinct(), "content_hash", "left_anti")
    return ranked_by_ranges(first, ["source_id"], ["__o", "start_char"], "chunk_index").select(
        project_chunk_id(F.col("source_id"), F.col("chunk_index")).alias("chunk_id"), "source_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.col("start_char").cast("bigint").alias("start_char"), (F.col("start_char") + F.length("text")).cast("bigint").alias("end_char"), "content_hash"
    )


def chunk_stats(chunks: DataFrame, max_chars: int = 1500, min_chars: int = 100) -> DataFrame:
    """One row: documents, chunks, total and rounded average length, chunks below the minimum and within 10 of the maximum."""
    n = F.col("char_count")
    return chunks.agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_chars"),
        F.coalesce(F.round(F.avg(n)), F.lit(0)).cast("bigint").alias("avg_chars"), F.count_if(n < min_chars).alias("below_min"), F.count_if(n >= max_chars - 10).alias("at_max"),
    )


