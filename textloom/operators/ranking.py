"""Ranks within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.runtime import durable


def ranked_by_ranges(df: DataFrame, keys: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: each row's place from 0 within its ``keys``, in the order of ``order``.

    Rows are put into ranges of (keys, order), ranked within their range, and the counts of a key's
    earlier ranges are added; so a key that holds a third of all rows is ranked by many tasks. Nulls
    come first; ties within ``order`` are in no certain order.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    placed = durable(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    before = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    local = F.row_number().over(W.partitionBy("__range", *keys).orderBy(*order)) - 1
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return placed.withColumn("__local", local).join(before, same).select(*df.columns, (F.col("__before") + F.col("__local")).cast("bigint").alias(name))
