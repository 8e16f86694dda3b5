"""Retrieval diagnostics: comparison with expectations, score statistics, quality and corpus health."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.schema import Thresholds


def compare(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: n_expected, n_found, missing, precision, recall, unexpected (of the top five), by ids.

    ``hits`` has (id, rank), ``expected`` has (id). Precision is 0 without hits, recall 1 without
    expectations. Hits are k rows; the expectations are aggregated before they meet.
    """
    want = expected.where(F.col("id").isNotNull()).select("id").distinct()
    joined = hits.select("id", "rank").join(want.withColumn("w", F.lit(1)), "id", "full_outer")
    hit, wanted = F.col("rank").isNotNull(), F.col("w").isNotNull()
    n = joined.agg(F.count_if(hit).alias("n_hits"), F.count_if(wanted).alias("n_expected"), F.count_if(hit & wanted).alias("n_found"), F.count_if(hit & ~wanted & (F.col("rank") <= 5)).alias("unexpected"))
    return n.select(
        "n_expected", "n_found", (F.col("n_expected") - F.col("n_found")).alias("missing"), "unexpected",
        F.when(F.col("n_hits") > 0, F.round(F.col("n_found") / F.col("n_hits"), 6)).otherwise(0.0).alias("precision"), F.when(F.col("n_expected") > 0, F.round(F.col("n_found") / F.col("n_expected"), 6)).otherwise(1.0).alias("recall"),
    )


def score_statistics(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: n, min, max, mean, population variance and the upper median (the greater of the two middle values).

    The median is exact and counts equal values together before the shuffle.
    """
    s = F.col(column)
    return scores.where(s.isNotNull()).agg(
        F.count("*").alias("n"), F.round(F.min(s), 6).alias("min"), F.round(F.max(s), 6).alias("max"), F.round(F.avg(s), 6).alias("mean"), F.round(F.var_pop(s), 6).alias("variance"),
        F.round(-F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{column}`)"), 6).alias("upper_median"),
    )


def diagnose(stats: DataFrame) -> DataFrame:
    """The row of score_statistics with ``finding`` and ``advice``; for lists of hits, of at most a few hundred scores."""
    finding = F.when(F.col("n") == 0, "no results").when(F.col("max") < 0.5, "low scores").otherwise("ok")
    advice = F.when(F.col("n") == 0, "check that the collection is filled and the filters match").when(F.col("max") < 0.5, "rephrase the query or use hybrid search").when(F.col("max") - F.col("min") > 0.5, "scores spread widely: consider a smaller top_k").otherwise("")
    return stats.withColumn("finding", finding).withColumn("advice", advice)


def assess(scores: DataFrame, group: list[str], column: str = "score", t: Thresholds = Thresholds()) -> DataFrame:
    """(*group, n, min, max, avg, variance, quality, note): quality is excellent, good, marginal or poor."""
    s = F.col(column)
    g = scores.groupBy(*group).agg(F.count(s).alias("n"), F.round(F.min(s), 6).alias("min"), F.round(F.max(s), 6).alias("max"), F.round(F.avg(s), 6).alias("avg"), F.round(F.var_pop(s), 6).alias("variance"))
    quality = (
        F.when(F.col("n") == 0, "poor").when((F.col("avg") >= 0.8) & (F.col("min") >= 0.6), "excellent").when((F.col("avg") >= t.average) & (F.col("min") >= t.chunk), "good").when(F.col("avg") >= 0.8 * t.average, "marginal").otherwise("poor")
    )
    return g.withColumn("quality", quality).withColumn("note", F.when(F.col("variance") > 0.1, "uneven scores").otherwise(""))


def audit(sources: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: counts of sources by status, chunks and vectors (distinct ids), health and the first recommendation that applies."""
    per = sources.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.max(F.struct(F.coalesce("processed_at", "added_at").alias("at"), F.col("status"))).alias("r")).select("r.status")
    s = per.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending"))
    c, v = chunks.agg(F.countDistinct("chunk_id").alias("chunks")), vectors.agg(F.countDistinct("chunk_id").alias("vectors"))
    row = s.crossJoin(c).crossJoin(v)  # one row each
    stale = F.col("vectors") < F.col("chunks")
    healthy = (F.col("sources") > 0) & (F.col("chunks") > 0) & ~stale & (F.col("failed") == 0)
    advice = (
        F.when(F.col("sources") == 0, "add sources").when(F.col("failed") > 0, "retry failed sources").when(F.col("pending") > 0, "build pending sources").when(F.col("chunks") == 0, "run the build").when(stale, "embed chunks without vectors").otherwise("none")
    )
    return row.withColumn("stale", stale).withColumn("healthy", healthy).withColumn("recommendation", advice)
