"""Writers. Overwriting goes to the given path only; never overwrite what is being read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def parquet(df: DataFrame, path: str, append: bool = False, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append" if append else "overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def ordered_chunks(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Chunks in the order of (doc_id, chunk_index) across files: a range per task, each sorted."""
    keys = ["doc_id", "chunk_index"]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def new_embeddings(df: DataFrame, existing: DataFrame, path: str) -> None:
    """Append the vectors whose chunk has none yet."""
    df.join(existing.select("chunk_id").distinct(), "chunk_id", "left_anti").write.mode("append").parquet(path)


def event_log(spark, path: str, level: str, phase: str, tool: str, message: str, data: str | None = None) -> None:
    row = spark.createDataFrame([(level, phase, tool, message, data)], "level string, phase string, tool string, message string, data string")
    row.select(F.current_timestamp().alias("timestamp"), "*").write.mode("append").json(path)
