"""Streams: incremental ingest without repeats, and windowed metrics. Extensions beyond batch building."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.text import normalize_text, short_hash
from textloom.runtime import durable, release, shared_dir


def file_stream(spark: SparkSession, folder: str, glob: str, schema, per_trigger: int = 1) -> DataFrame:
    """The files of ``folder`` that match ``glob`` as a stream; if ``glob`` is the name of a folder in it, as tables of several files are stored, that folder's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if there and len(there) == 1 and there[0].isDirectory():
        return reader.parquet(f"{folder}/{glob}")
    return reader.option("pathGlobFilter", glob).parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is, into a table of the shared folder, and read that back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/textloom/stream-{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def ingest_new(documents: DataFrame, target: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Append documents whose normalised content the target doesn't hold yet, batch by batch, exactly once per content.

    Each micro-batch drops repeats within itself (the least id stays) and what is stored already. The
    hashes that are stored lie beside the texts, in order, and a batch reads the row groups that hold
    the first two digits of its own, and no texts. If a later batch has a lesser id for a stored
    content, only its hash and id are stored, so ingested() knows the least id over all batches. A
    batch that is run again after a failure overwrites its own part of the target.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(text_col).isNotNull()).withColumn("content_hash", short_hash(normalize_text(F.col(text_col)), 64))
        least = durable(rows.groupBy("content_hash").agg(F.min(id_col).alias("id")), "ingest-least")
        prefix = F.left("content_hash", F.lit(2))
        try:
            wanted = [r[0] for r in least.select(prefix).distinct().collect()]  # at most 256
            old = _hashes(spark, target, least.schema["id"].dataType.simpleString()).where(F.col("prefix").isin(wanted) & (F.col("batch") != number))
            known = old.groupBy("content_hash").agg(F.min("id").alias("known"), F.lit(True).alias("stored"))
            marked = least.join(known, "content_hash", "left")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            marked = least.withColumn("known", F.lit(None).cast(least.schema["id"].dataType)).withColumn("stored", F.lit(None).cast("boolean"))
        marked = durable(marked, "ingest-marked")
        new = marked.where("stored is null").select("content_hash", F.col("id").alias("least_id"))
        texts = rows.join(new, ["content_hash"]).where(F.col(id_col).eqNullSafe(F.col("least_id"))).drop("least_id").dropDuplicates(["content_hash"])
        texts.write.mode("overwrite").parquet(f"{target}/batch={number}")
        fresh = marked.where("stored is null or id < known or (known is null and id is not null)").select("content_hash", "id", prefix.alias("prefix"))
        fresh.sort("content_hash").write.mode("overwrite").parquet(f"{target}-hashes/batch={number}")
        release(least, marked)

    documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _hashes(spark: SparkSession, target: str, kind: str) -> DataFrame:
    return spark.read.schema(f"content_hash string, id {kind}, batch int, prefix string").parquet(f"{target}-hashes")


def ingested(spark: SparkSession, target: str, id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """(id, content_hash) of every content that ingest_new() has stored, with the least id it came with, whatever the order of the batches."""
    return _hashes(spark, target, kind).groupBy("content_hash").agg(F.min("id").alias(id_col)).select(id_col, "content_hash")


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None, time_col: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, key, n, total) per tumbling (or sliding) window; windows close once the watermark has passed."""
    if events.isStreaming:  # watermarks need a time zone's timestamp
        events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    w = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    g = events.withWatermark(time_col, late) if events.isStreaming else events
    return g.groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("window_start"), "key", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", time_col: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): runs of events no more than ``gap`` apart."""
    if events.isStreaming:  # watermarks need a time zone's timestamp
        events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    g = events.withWatermark(time_col, gap) if events.isStreaming else events
    s = g.groupBy(F.session_window(time_col, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return s.select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
