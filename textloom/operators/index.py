"""Vector collections: what is still to be embedded, upsert, and the collection's description."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def to_embed(chunks: DataFrame, vectors: DataFrame, force: bool = False) -> DataFrame:
    """Chunks without a vector, or all of them with ``force``."""
    return chunks if force else chunks.join(vectors.select("chunk_id").distinct(), "chunk_id", "left_anti")


def collection(chunks: DataFrame, vectors: DataFrame, metadata: list[str] = [], include_text: bool = True) -> DataFrame:  # noqa: B006
    """(id, embedding, <metadata fields>, text): vectors joined with their chunks; dots in field paths become underscores."""
    fields = [F.col(f"c.{m}").alias(m.replace(".", "_")) for m in metadata]
    joined = vectors.alias("v").join(chunks.alias("c"), F.expr("v.chunk_id = c.chunk_id"))
    return joined.select(F.col("v.chunk_id").alias("id"), F.col("v.embedding").alias("embedding"), *fields, *([F.col("c.text").alias("text")] if include_text else []))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", mode: str = "upsert") -> DataFrame:
    """'upsert': incoming rows replace existing ones; 'insert': only new keys come in; 'replace': incoming only. Repeated incoming keys count once, the greatest row."""
    rest = [c for c in incoming.columns if c != key]
    new = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*").select(*incoming.columns)
    if mode == "replace":
        return new
    if mode == "insert":
        return existing.unionByName(new.join(existing.select(key), key, "left_anti"))
    if mode == "upsert":
        return existing.join(new.select(key), key, "left_anti").unionByName(new)
    raise ValueError("mode must be upsert, insert or replace")


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many keys an upsert would insert, update and leave."""
    old, new = existing.select(key).distinct().withColumn("o", F.lit(1)), incoming.where(F.col(key).isNotNull()).select(key).distinct().withColumn("n", F.lit(1))
    j = old.join(new, key, "full_outer")
    return j.agg(F.count_if(F.col("o").isNull()).alias("inserted"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("updated"), F.count_if(F.col("n").isNull()).alias("untouched"))


def manifest(rows: DataFrame, name: str, model: str) -> DataFrame:
    """One row: the collection's name, model, dimensions and number of vectors."""
    return rows.agg(F.count("*").alias("vectors_count"), F.max(F.size("embedding")).alias("dimensions")).select(F.lit(name).alias("collection"), F.lit(model).alias("model_used"), "dimensions", "vectors_count")
