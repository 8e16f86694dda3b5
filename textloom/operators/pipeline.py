"""Whole runs: sources to texts, texts to a searchable collection, and a query explained."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F

from textloom.functions.vectors import local_embedding
from textloom.operators import dedupe, diagnostics, index, retrieval
from textloom.operators.catalog import Project
from textloom.operators.chunking import chunk_documents
from textloom.operators.extract import pdf_text, route_responses
from textloom.runtime import durable
from textloom.schema import ChunkConfig, RetrievalProfile
from textloom.sources import readers

Get = Callable[[str], tuple[int, str, bytes]]


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], model: str, batch: int = 50, text_col: str = "text") -> DataFrame:
    """(chunk_id, embedding, model): ``embed`` is called with at most ``batch`` texts at a time, inside the tasks.

    A batch that raises is tried once more; then the task fails. Null texts are left out.
    """

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                texts = part.column(1).to_pylist()
                try:
                    vectors = embed(texts)
                except Exception:
                    vectors = embed(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32())), pa.array([model] * len(texts))], names=["chunk_id", "embedding", "model"])

    return chunks.where(F.col(text_col).isNotNull()).select("chunk_id", text_col).mapInArrow(run, "chunk_id string, embedding array<float>, model string")


def source_texts(due: DataFrame, get: Get, pdf_reader: Callable[[bytes], str] | None = None, max_pages: int = 100, max_files: int = 500, max_file_bytes: int = 5 * 1024 * 1024, min_page_chars: int = 100) -> DataFrame:
    """(source_id, part, text, error) of sources (source_id, type, uri) of the types url, sitemap, pdf, folder and text.

    Pages of a site map with fewer than ``min_page_chars`` are dropped; all folders and PDF files are
    read by one scan, whose files meet their sources on the folders above them; of a folder the first
    ``max_files`` text files count, of a PDF source the first file. A source of type text is its uri's
    page.
    """
    spark = due.sparkSession
    due = due.where(F.col("source_id").isNotNull() & F.col("uri").isNotNull()).select("source_id", "type", "uri")

    def fetched(rows: DataFrame) -> DataFrame:
        got = route_responses(readers.fetch(rows.select("uri").distinct(), get).withColumnRenamed("error", "fetch_error"))
        return rows.join(got.select("uri", "extractor", "text", "body", F.coalesce("fetch_error", "error").alias("error")), "uri", "left")

    pages = fetched(due.where(F.col("type").isin("url", "text")).withColumn("part", F.lit(0)))
    out = pages.select("source_id", "part", F.when(F.col("extractor") != "pdf", F.col("text")).alias("text"), F.coalesce("error", F.when(F.col("text").isNull(), "not fetched")).alias("error"))
    maps = readers.fetch(due.where("type = 'sitemap'").select("uri").distinct(), get)
    listed = due.where("type = 'sitemap'").join(maps.select("uri", F.decode("body", "UTF-8").alias("xml"), "error"), "uri", "left")
    urls = listed.select("source_id", F.posexplode(F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1), lambda u: u))), 1, max_pages)).alias("part", "uri"))
    below = fetched(urls).where(F.length("text") >= min_page_chars).select("source_id", "part", "text", F.lit(None).cast("string").alias("error"))
    failed = listed.where(F.col("error").isNotNull() | F.col("xml").isNull()).select("source_id", F.lit(0).alias("part"), F.lit(None).cast("string").alias("text"), F.coalesce("error", F.lit("not fetched")).alias("error"))
    out = out.unionByName(below).unionByName(failed)
    stored = due.where(F.col("type").isin("folder", "pdf"))
    roots = readers.existing(spark, [r["uri"] for r in stored.select("uri").distinct().collect()])  # a reader takes its paths from the driver
    rooted = spark.createDataFrame(list(roots.items()), "uri string, root string")
    lost = stored.join(rooted, "uri", "left_anti").select("source_id", F.lit(0).alias("part"), F.lit(None).cast("string").alias("text"), F.lit("no such path").alias("error"))
    if not roots:
        return out.unionByName(lost)
    files = readers.below(spark, list(roots.values())).join(rooted, "root").join(stored, "uri").where((F.col("type") == "pdf") | (F.col("size_bytes") <= max_file_bytes))
    plain = F.col("content_type").startswith("text/") | F.col("content_type").isin("application/json", "application/xml")
    files = files.where((F.col("type") == "pdf") | plain)
    numbered = files.withColumn("part", F.row_number().over(W.partitionBy("source_id").orderBy("file")) - 1).where(F.col("part") < F.when(F.col("type") == "pdf", 1).otherwise(max_files))
    pdf = pdf_text(F.col("content"), pdf_reader) if pdf_reader else F.lit(None).cast("string")
    read = numbered.withColumn("text", F.when(F.col("type") == "pdf", pdf).otherwise(F.decode("content", "UTF-8")))
    return out.unionByName(lost).unionByName(read.select("source_id", "part", "text", F.when(F.col("text").isNull(), "no text").alias("error")))


def run_pipeline(documents: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None, cfg: ChunkConfig = ChunkConfig(), model: str = "local", dim: int = 384, near: float | None = None) -> dict[str, DataFrame]:
    """chunks, vectors and collection of documents (text): chunk, drop repeated chunks (near-duplicates too, if ``near`` is a similarity), embed, join."""
    chunks = chunk_documents(documents, cfg).dropDuplicates(["chunk_id"])
    marked = dedupe.jaccard(chunks, "chunk_id", "text", near) if near else dedupe.exact(chunks, "chunk_id", "text")
    kept = chunks.join(marked.where("is_kept").select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    vectors = embed_chunks(kept, embed, model) if embed else kept.select("chunk_id", local_embedding(F.col("text"), dim).cast("array<float>").alias("embedding"), F.lit(model).alias("model"))
    return {"chunks": kept, "vectors": vectors, "collection": index.collection(kept, vectors, ["doc_id", "chunk_index"])}


def debug_query(rows: DataFrame, query_vector: Sequence[float], k: int = 10, expected: DataFrame | None = None, preview: int = 200) -> dict[str, DataFrame]:
    """results (rank, id, score within 0 and 1, preview), comparison with ``expected`` (id) if given, and diagnostics."""
    hits = retrieval.semantic(rows, query_vector, k)
    results = hits.join(rows.select("id", "text"), "id").select("rank", "id", F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)).alias("score"), F.substring("text", 1, preview).alias("preview"))
    out = {"results": results, "diagnostics": diagnostics.diagnose(diagnostics.score_statistics(hits))}
    if expected is not None:
        out["comparison"] = diagnostics.compare(hits, expected)
    return out


def rerank(hits: DataFrame, rows: DataFrame, score: Callable[[str], float], k: int) -> DataFrame:
    """(id, score, rank): the hits ordered anew by ``score`` of their texts; hits are few."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(score(t)) if t is not None else 0.0 for t in b.column(1).to_pylist()])], names=["id", "score"])

    kind = hits.schema["id"].dataType.simpleString()
    return retrieval.top(hits.select("id").join(rows.select("id", "text"), "id").select("id", "text").mapInArrow(run, f"id {kind}, score double"), k)


def index_stats(rows: DataFrame) -> DataFrame:
    """One row: rows, rows with text, rows with a vector, sources, and characters in all."""
    zero = F.lit(0).cast("bigint")
    return rows.agg(F.count("*").alias("rows"), F.count("text").alias("with_text"), F.count("embedding").alias("with_vector"), F.countDistinct("source_id").alias("sources"), F.coalesce(F.sum(F.length("text").cast("bigint")), zero).alias("chars"))


def example_questions(rows: DataFrame, names: Iterable[str] = (), n: int = 4) -> list[str]:
    """At most ``n`` questions a corpus may answer: from headings, then first sentences, then names, then general ones."""
    first = rows.where(F.col("text").isNotNull()).select("id", F.regexp_extract("text", r"(?m)^#{1,6}\s+(.{4,80})$", 1).alias("h"), F.regexp_extract("text", r"^\s*([^.!?\n]{20,120})[.!?]", 1).alias("s"))
    heads = [r["h"] for r in first.where("h != ''").groupBy("h").agg(F.min("id").alias("id")).orderBy("id").limit(n).collect()]
    said = [r["s"] for r in first.where("s != ''").select("id", "s").orderBy("id").limit(n).collect()]
    asked = [f"What does the section “{h}” say?" for h in heads] + [f"Why is it said that “{s}”?" for s in said] + [f"What is {x} about?" for x in names] + ["What is this corpus about?", "Which topics come up most?", "What changed recently?", "Where should one start reading?"]
    return list(dict.fromkeys(asked))[:n]


def profile_json(profile: RetrievalProfile) -> str:
    return json.dumps(asdict(profile), sort_keys=True)


def profile_from_json(text: str) -> RetrievalProfile:
    d = json.loads(text)
    return RetrievalProfile(**d | {"modes": tuple(d["modes"]), "filters": tuple(tuple(f) for f in d["filters"])})


class Trace:
    """What passed each stage of a query: rows and seconds, observed while the query runs, without running it twice."""

    def __init__(self) -> None:
        self._stages: list[tuple[str, Observation, float]] = []

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` with its rows counted under ``name`` once an action has run."""
        seen = Observation()
        self._stages.append((name, seen, time.monotonic()))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def report(self) -> list[dict]:
        """(step, name, rows, planned_after) of every stage, in order; to be called after the action."""
        began = self._stages[0][2] if self._stages else 0.0
        return [{"step": k, "name": name, "rows": seen.get["rows"], "planned_after": round(at - began, 3)} for k, (name, seen, at) in enumerate(self._stages)]


def traced_search(rows: DataFrame, query_vector: Sequence[float], k: int = 10, filters=None) -> tuple[DataFrame, list[dict]]:
    """(hits, trace): semantic search with the rows of each stage: collection, after filters, hits."""
    trace = Trace()
    kept = trace.stage("collection", rows)
    for name, op, value in filters or ():
        kept = kept.where(retrieval.predicate(name, op, value))
    hits = durable(trace.stage("hits", retrieval.semantic(trace.stage("filtered", kept), query_vector, k)), "hits")
    return hits, trace.report()


def project_stats(spark: SparkSession, root: str) -> DataFrame:
    """(project, sources, chunks, vectors, builds) of every project below a folder."""
    parts = [Project(spark, root, name).stats().select(F.lit(name).alias("project"), "*") for name in list_projects(spark, root)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "project string, sources bigint, chunks bigint, vectors bigint, builds int")


def list_projects(spark: SparkSession, root: str) -> list[str]:
    """Names of the projects below a folder, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
