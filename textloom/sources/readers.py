"""Readers: files, JSON lines, site maps, pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.text import safe_url, type_of_extension
from textloom.schema import EVENT, RUN


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line, blank lines dropped; malformed lines fail, or become nulls if not ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def folder(spark: SparkSession, path: str, glob: str = "*", exclude: Iterable[str] = (), max_bytes: int | None = None) -> DataFrame:
    """(uri, sha256, size_bytes, modified_at, content_type, content): files below ``path``; larger ones are skipped before their content is hashed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    for pattern in exclude:
        files = files.where(~F.col("path").rlike(pattern))
    ext = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1)
    return files.select(F.col("path").alias("uri"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), type_of_extension(ext).alias("content_type"), "content")


def existing(spark: SparkSession, paths: Iterable[str]) -> dict[str, str]:
    """The paths that exist, each with its full form."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {}
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            out[path] = fs.getFileStatus(p).getPath().toUri().getPath()
    return out


def below(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, file, size_bytes, content_type, content): all files of several folders (or single files), by one scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    parts = F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ext = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1)
    named = files.select(F.explode(above).alias("root"), F.col("path").alias("file"), F.col("length").alias("size_bytes"), type_of_extension(ext).alias("content_type"), "content")
    return named.where(F.col("root").isin(roots))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(uri, size_bytes) of the files in one folder, in order; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.col("length").alias("size_bytes")).orderBy("uri")


def site_map(spark: SparkSession, path: str, include: Iterable[str] = (), exclude: Iterable[str] = (), max_pages: int = 100) -> DataFrame:
    """(uri): locations of a site map that match any of ``include`` and none of ``exclude``, in order, at most ``max_pages``."""
    urls = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    return select_urls(urls.select(F.trim("loc").alias("uri")), include, exclude, max_pages)


def site_map_index(spark: SparkSession, path: str) -> DataFrame:
    """(uri): the site maps that a site map index names."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select(F.trim("loc").alias("uri")).where("uri != ''")


def select_urls(urls: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), max_pages: int | None = 100) -> DataFrame:
    rows = urls.where(F.col("uri") != "").distinct()
    include = list(include)
    if include:
        hit = F.lit(False)
        for p in include:
            hit = hit | F.col("uri").rlike(p)
        rows = rows.where(hit)
    for p in exclude:
        rows = rows.where(~F.col("uri").rlike(p))
    rows = rows.orderBy("uri")
    return rows if max_pages is None else rows.limit(max_pages)


def _bounded(body, max_bytes: int, ends: float) -> bytes | None:
    """The body, read piece by piece if it comes in pieces; None once it is larger than allowed, an error once its time is over."""
    if isinstance(body, bytes):
        return body if len(body) <= max_bytes else None
    out = bytearray()
    for piece in body:
        out += piece
        if len(out) > max_bytes:
            return None
        if time.monotonic() > ends:
            raise TimeoutError("took too long")
    return bytes(out)


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str, bytes | Iterable[bytes]]], allowed: Iterable[str] = (), max_bytes: int = 50 * 1024 * 1024, per_task: int = 64, seconds: float = 60.0) -> DataFrame:
    """(uri, status, content_type, body, sha256, error) of every safe URL; ``get`` (uri to status, type, body) is the caller's.

    The URLs are spread over tasks of about ``per_task``, each of which fetches its own one after the
    other; so no more are fetched at once than there are cores. A failing URL gives an error row. A
    body that comes in pieces is read no further than ``max_bytes`` and ``seconds`` allow; larger bodies
    are dropped with an error. Answers other than 2xx are errors, from 500 on marked as worth
    another try.
    """
    allowed = [a.lower() for a in allowed]
    rows = urls.where(safe_url(F.col("uri"))).select("uri")
    if allowed:
        rows = rows.where(F.lower(F.regexp_extract("uri", r"(?i)^https?://([^/:?#]+)", 1)).isin(allowed))

    rows = rows.repartition(max(1, -(-rows.count() // per_task)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                try:
                    status, kind, body = get(uri)
                    body = _bounded(body, max_bytes, time.monotonic() + seconds)
                    error = "too large" if body is None else None if 200 <= status < 300 else f"status {status}" + (", try again" if status >= 500 else "")
                    out.append((uri, status, kind, body if error is None else None, error))
                except Exception as e:  # one URL must not fail the task
                    out.append((uri, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())], names=["uri", "status", "content_type", "body", "error"])

    return rows.mapInArrow(run, "uri string, status int, content_type string, body binary, error string").withColumn("sha256", F.sha2("body", 256))


def unseen(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Artifacts whose content hash the manifest doesn't have."""
    return artifacts.join(manifest.select("sha256").distinct(), "sha256", "left_anti")


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).option("multiLine", True).json(f"{path}/*/manifest.json")


def events(spark: SparkSession, path: str, level: str | None = None) -> DataFrame:
    rows = json_lines(spark, path, EVENT, strict=False)
    return rows.where(F.col("level") == level) if level else rows
