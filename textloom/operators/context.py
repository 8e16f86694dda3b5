"""Context around hits: neighbours, parents, and a cap on what is handed on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.operators.ranking import ranked_by_ranges
from textloom.runtime import durable, release
from textloom.schema import ExpandConfig


def latest_chunks(df: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, parent_id, level, text): one row per chunk_id, the one retrieved last."""
    row = F.struct(F.col("source.retrieved_at").alias("at"), "doc_id", "chunk_index", "parent_id", F.col("hierarchy_level").alias("level"), F.col("content.text").alias("text"))
    return df.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(row).alias("r")).select("r.doc_id", "chunk_id", "r.chunk_index", "r.parent_id", "r.level", "r.text")


def neighbours(chunks: DataFrame, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """(hit_id, chunk_id, distance): the chunks of the hit's document up to so many places away.

    Places follow (chunk_index, chunk_id), nulls first. The chunks of the hits' documents are ranked
    by ranges, and the hits meet them on (document, place), which is unique; so neither a document of
    any length nor hits that are all chunks make a hot group or a product. ``hits`` has (id); repeated
    hits count once.
    """
    ids = hits.select(F.col("id").alias("chunk_id")).distinct()
    docs = chunks.join(ids, "chunk_id", "left_semi").select("doc_id").distinct()
    own = chunks.select("doc_id", "chunk_id", "chunk_index").join(docs, "doc_id", "left_semi")
    placed = durable(ranked_by_ranges(own, ["doc_id"], ["chunk_index", "chunk_id"], "place"), "places").select("doc_id", "chunk_id", "place")
    steps = F.array(*[F.lit(d) for d in range(-before, after + 1) if d]) if before + after else F.array().cast("array<int>")
    wanted = placed.join(ids, "chunk_id", "left_semi").select("doc_id", F.col("chunk_id").alias("hit_id"), F.col("place").alias("at"), F.explode(steps).alias("distance"))
    return wanted.select("doc_id", "hit_id", "distance", (F.col("at") + F.col("distance")).alias("place")).join(placed, ["doc_id", "place"]).select("hit_id", "chunk_id", "distance")


def hydrate(chunks: DataFrame, hits: DataFrame, cfg: ExpandConfig = ExpandConfig()) -> DataFrame:
    """(hit_id, chunk_id, role, distance): parent, neighbours before and after of every hit, within cfg.max_total.

    Neighbours that are hits themselves are left out. The parent comes first; of what is left of the
    total half, rounded down, goes to the nearest before and the rest to the nearest after.
    """
    ids = hits.select(F.col("id").alias("chunk_id")).distinct()
    near = neighbours(chunks, hits, cfg.before, cfg.after).join(ids, "chunk_id", "left_anti") if cfg.before + cfg.after else None
    parents = chunks.join(ids, "chunk_id", "left_semi").select(F.col("chunk_id").alias("hit_id"), F.lower(F.trim("parent_id")).alias("p")).join(chunks.select(F.lower(F.trim("chunk_id")).alias("p"), F.col("chunk_id")), "p").select("hit_id", "chunk_id", F.lit(0).alias("distance"))
    has = parents.select("hit_id", F.lit(1).alias("has")) if cfg.parent else None
    out = parents.withColumn("role", F.lit("parent")) if cfg.parent else None
    if near is not None:
        side = near.withColumn("role", F.when(F.col("distance") < 0, "before").otherwise("after"))
        side = side.join(has, "hit_id", "left") if has is not None else side.withColumn("has", F.lit(None).cast("int"))
        room = F.lit(cfg.max_total) - F.coalesce("has", F.lit(0))
        half = F.floor(room / 2).cast("int")
        nth = F.row_number().over(W.partitionBy("hit_id", "role").orderBy(F.abs("distance")))
        kept = side.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("role") == "before", half).otherwise(room - half)).select("hit_id", "chunk_id", "distance", "role")
        out = kept if out is None else out.unionByName(kept)
    if out is None:
        return parents.withColumn("role", F.lit("parent")).limit(0).select("hit_id", "chunk_id", "role", "distance")
    return out.select("hit_id", "chunk_id", "role", "distance")


def parent_chains(chunks: DataFrame, hits: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(hit_id, chunk_id, distance): the ancestors of the hits, nearest first, up to the root and none twice; at most ``max_depth`` of them if given.

    One join per step, written to the shared folder, until no hit has a further ancestor; for whole
    forests of any depth see hierarchy().
    """
    up = durable(chunks.select(F.lower(F.trim("chunk_id")).alias("up_node"), F.col("chunk_id").alias("up_id"), F.lower(F.trim("parent_id")).alias("up_parent")), "chain-links")
    now = hits.select(F.col("id").alias("up_id")).join(up, "up_id").select(F.col("up_id").alias("hit_id"), F.col("up_parent").alias("parent"), F.array("up_node").alias("seen"))
    found: list[DataFrame] = []
    while max_depth is None or len(found) < max_depth:
        step = now.join(up, F.col("parent") == F.col("up_node")).where(~F.array_contains("seen", F.col("up_node")))
        step = durable(step.select("hit_id", "up_id", "up_parent", F.array_append("seen", F.col("up_node")).alias("seen")), "chain-step")
        found.append(step.select("hit_id", F.col("up_id").alias("chunk_id"), F.lit(len(found) + 1).alias("distance")))
        if step.isEmpty():
            break
        now = step.select("hit_id", F.col("up_parent").alias("parent"), "seen")
    release(up)
    return reduce(DataFrame.union, found)
