"""Problem 9: long exact spans shared between documents, by MinHash over sliding paragraphs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.functions.shingles import mix
from textloom.llm.near_dup import near_duplicates
from textloom.operators.components import connected_components
from textloom.runtime import durable, release, split_join

_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64


class RollingHash:
    """Hashes of any stretch of a text from prefix sums modulo 2^64; the power tables grow as needed."""

    def __init__(self) -> None:
        self.codes = mix(np.arange(65536, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self._powers(len(c) + 1)
        h = self.codes[c & 0xFFFF]
        if len(c) and c.max() > 0xFFFF:
            h = h ^ mix((c >> 16).astype(np.uint64))
        out = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(h * self.up[: len(c)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, from block-wise running minima of both directions."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of(text: str, length: int, gram: int, rolling: RollingHash):
    """(fp, whole, first, last): runs of neighbouring windows of ``length`` characters with one MinHash.

    Every window is a paragraph of its own and ``fp`` its MinHash over the ``gram``-grams; ``whole``
    is the hash of all characters that the run's windows cover.
    """
    prefix = rolling.prefix(text)
    least = sliding_min(rolling.grams(prefix, gram), length - gram + 1)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut - 1, [len(least) - 1]))
    whole = rolling.spans(prefix, first, last + length) ^ (last - first).astype(np.uint64)
    return least[first], whole, first, last


def _runs(length: int, gram: int):
    def run(batches):
        rolling = RollingHash()
        for batch in batches:
            docs, parts = [], []
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, batch.column(1).to_pylist()):
                if len(text) >= length:
                    parts.append(runs_of(text, length, gram, rolling))
                    docs.append((doc, len(parts[-1][0])))
            if not parts:
                continue
            fp, whole, first, last = (np.concatenate(x) for x in zip(*parts))
            doc = pa.array([d for d, _ in docs], batch.schema.field(0).type).take(pa.array(np.repeat(np.arange(len(docs)), [n for _, n in docs])))
            yield pa.RecordBatch.from_arrays([doc, pa.array(fp.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc", "fp", "whole", "first", "last"])

    return run


def _windows(length: int):
    def run(batches):
        rolling = RollingHash()
        for batch in batches:
            out = []
            for doc, text, runs in zip(*(batch.column(k).to_pylist() for k in range(3))):
                prefix = rolling.prefix(text)
                for r in runs:
                    at = np.arange(r["first"], min(r["last"], len(text) - length) + 1)
                    out.append((doc, r["fp"], at, rolling.spans(prefix, at, at + length)))
            if not out:
                continue
            sizes = [len(x[2]) for x in out]
            spread = pa.array(np.repeat(np.arange(len(out)), sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], batch.schema.field(0).type).take(spread), pa.array([x[1] for x in out], pa.int64()).take(spread), pa.array(np.concatenate([x[2] for x in out]).astype(np.int32)), pa.array(np.concatenate([x[3] for x in out]).view(np.int64))],
                names=["doc", "fp", "at", "h"],
            )

    return run


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int | None = None, links: bool = False) -> DataFrame:
    """(doc_id, span_start, span_end): maximal stretches made of spans of at least ``length`` code points that another document holds too.

    Offsets count code points, the end is exclusive; overlapping or touching spans are one. With
    ``links`` the result is (u, v) instead: documents tied to the least document that holds the same
    windows, for components of what would be removed together.

    Method: a span may begin and end inside paragraphs as they are written, so every window of
    ``length`` characters counts as a paragraph. Its MinHash, one band of one row over its
    ``gram``-grams (by default 8/25 of the length), collides for equal windows always (recall 1). Neighbouring windows mostly have one
    MinHash; such runs are posted once, with the hash of all they cover. Runs equal as a whole are
    shared as a whole. Of the other runs with a colliding MinHash every window is compared exactly by
    a second, independent 64-bit hash. Only the least and the greatest document of each posting are
    aggregated, before the shuffle, so a passage in very many documents is no hot group, and no pairs
    are made.

    Null ids or texts and texts shorter than ``length`` give no row; rows with one id count as one
    document, so repeats within it are not shared; other columns are ignored; an empty table gives an
    empty result.
    """
    gram = max(1, length * 8 // 25) if gram is None else gram
    if not 0 < gram < length:
        raise ValueError("gram must be positive and less than length")
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    kind = rows.schema["doc"].dataType.simpleString()
    runs = durable(rows.mapInArrow(_runs(length, gram), f"doc {kind}, fp bigint, whole bigint, first int, last int"), "spans-runs")
    both = [F.min("doc").alias("d0"), F.max("doc").alias("d1")]
    shared = runs.groupBy("fp").agg(*both).where("d0 != d1").select("fp")
    kept = durable(runs.join(shared, "fp"), "spans-kept")
    release(runs)
    entire = kept.groupBy("fp", "whole").agg(*both)
    flagged = durable(kept.join(entire, ["fp", "whole"]), "spans-flagged")
    release(kept)
    done = flagged.where("d0 != d1").select("doc", F.col("first").alias("s"), (F.col("last") + length).alias("e"))
    partial = flagged.where("d0 = d1").select("fp").distinct()
    ends = flagged.where("d0 = d1 or doc = d0 or doc = d1").join(partial, "fp").groupBy("doc", "fp", "whole").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.collect_list(F.struct("first", "last")).alias("all"))
    wanted = ends.select("doc", "fp", F.explode("all").alias("r")).groupBy("doc").agg(F.collect_list(F.struct("fp", "r.first", "r.last")).alias("runs"))
    windows = durable(rows.join(wanted, "doc").select("doc", "text", "runs").mapInArrow(_windows(length), f"doc {kind}, fp bigint, at int, h bigint"), "spans-windows")
    found = windows.groupBy("fp", "h").agg(*both).where("d0 != d1")
    if links:
        tied = flagged.where("doc != d0").select("doc", "d0").union(windows.join(found, ["fp", "h"]).where("doc != d0").select("doc", "d0"))
        return tied.select(F.col("doc").alias("u"), F.col("d0").alias("v")).distinct()
    single = windows.join(found, ["fp", "h"]).select("doc", F.col("at").alias("s"), (F.col("at") + length).alias("e"))
    w = W.partitionBy("doc").orderBy("s", "e")
    return (
        done.union(single)
        .distinct()
        .withColumn("reach", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("island", F.sum(F.when(F.col("s") > F.col("reach"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc", "island")
        .agg(F.min("s").cast("bigint").alias("span_start"), F.max("e").cast("bigint").alias("span_end"))
        .select(F.col("doc").alias("doc_id"), "span_start", "span_end")
    )


def shared_shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int | None = None) -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, shared_share) for every document with a text; 0 where nothing is shared."""
    spans = shared_spans(df, id_col, text_col, length, gram).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    docs = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.length(text_col)).cast("bigint").alias("n_chars"))
    zero = F.lit(0).cast("bigint")
    joined = docs.join(spans, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("shared_chars", zero).alias("shared_chars"))
    return joined.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))


def tuned_bands(similarity: float = 0.8, recall: float = 0.999, matches: int = 2, hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the longest bands by which pairs of that similarity still collide ``matches`` times with at least the probability ``recall``."""
    for rows in range(hashes // matches, 0, -1):
        bands, p = hashes // rows, similarity**rows
        if 1 - sum(math.comb(bands, k) * p**k * (1 - p) ** (bands - k) for k in range(matches)) >= recall:
            return bands, rows
    raise ValueError("no bands of so few hashes reach that recall")


def paragraph_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(u, v): documents tied to the least document that holds a paragraph of the same group.

    Paragraphs are lines of at least ``words`` words. They are banded by MinHash over their runs of
    ``words`` words, with bands tuned for ``recall``; colliding paragraphs are joined and verified by
    exact Jaccard similarity, and components of verified paragraphs are groups (see near_duplicates).
    """
    docs = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), r"[\n\f]+")).alias("n", "text"))
    paragraphs = durable(docs.where(F.length("text") > 2 * words).distinct().withColumn("id", F.monotonically_increasing_id()), "paragraphs")
    bands, rows = tuned_bands(similarity, recall)
    groups = durable(near_duplicates(paragraphs, "id", "text", words, similarity, bands, rows), "paragraph-groups")
    placed = groups.join(paragraphs.select("id", "doc"), "id").select("group_id", "doc")
    least = durable(placed.groupBy("group_id").agg(F.min("doc").alias("u"), F.max("doc").alias("last"), F.count("*").alias("n")).where("u != last").drop("last"), "paragraph-least")
    return split_join(placed, least, "group_id", weight="n").where("doc != u").select("u", F.col("doc").alias("v")).distinct()


def removal_clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int | None = None, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, cluster_id): documents tied by similar paragraphs or by an exact span, directly or through others; the least id names the cluster.

    Paragraphs are compared as in paragraph_links; spans of at least ``length`` characters that lie
    within or across paragraphs that are not similar as wholes come from shared_spans. Documents that
    are tied to none give no row; null ids and texts are left out.
    """
    exact = shared_spans(df, id_col, text_col, length, gram, links=True)
    return connected_components(exact.unionByName(paragraph_links(df, id_col, text_col, words, similarity))).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster_id"))
