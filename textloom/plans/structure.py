"""Queries of tables, catalog, lineage, index and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import catalog, diagnostics, index, tables
from textloom.operators.dedupe import new_sources
from textloom.operators.extract import html_to_text
from textloom.plans.registry import Registry
from textloom.runtime import durable, shared_dir, table
from textloom.streaming import ingest

registry = Registry()
query = registry.query


def nation_table(spark, sf_dir):
    """The nations (a fixed, small table) as one parsed table."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name", F.col("n_regionkey").cast("string").alias("r"), "n_nationkey")
    ordered = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array("k", "n_name", "r").alias("cells")))).alias("a"))
    return ordered.select(F.array(F.lit("key"), F.lit("name"), F.lit("region")).alias("headers"), F.transform("a", lambda x: x["cells"]).alias("rows"))


@query("table_linearize_rows", "SELECT string_agg('Row ' || i || ': key=' || n_nationkey || ', name=' || n_name || ', region=' || n_regionkey, '; ' ORDER BY n_nationkey) AS text FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)")
def table_linearize_rows(spark, sf_dir):
    """A table row by row."""
    return nation_table(spark, sf_dir).select(tables.linearize(F.col("headers"), F.col("rows")).alias("text"))


@query("table_linearize_columns", "SELECT 'Column ''key'': ' || string_agg(n_nationkey::VARCHAR, ', ' ORDER BY n_nationkey) || '; Column ''name'': ' || string_agg(n_name, ', ' ORDER BY n_nationkey) || '; Column ''region'': ' || string_agg(n_regionkey::VARCHAR, ', ' ORDER BY n_nationkey) AS text FROM nation")
def table_linearize_columns(spark, sf_dir):
    """A table column by column."""
    return nation_table(spark, sf_dir).select(tables.linearize(F.col("headers"), F.col("rows"), "column_by_column").alias("text"))


@query("table_linearize_words", "SELECT 'This table has ' || count(*) || ' rows and 3 columns. The column key holds values such as ' || string_agg(n_nationkey::VARCHAR, ', ' ORDER BY n_nationkey) FILTER (i <= 3) || '. The column name holds values such as ' || string_agg(n_name, ', ' ORDER BY n_nationkey) FILTER (i <= 3) || '. The column region holds values such as ' || string_agg(n_regionkey::VARCHAR, ', ' ORDER BY n_nationkey) FILTER (i <= 3) || '.' AS text FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)")
def table_linearize_words(spark, sf_dir):
    """A table in sentences."""
    return nation_table(spark, sf_dir).select(tables.linearize(F.col("headers"), F.col("rows"), "natural_language").alias("text"))


@query("table_types", "SELECT 'number string number' AS types, 'Table with ' || count(*) || ' rows and 3 columns (key, name, region)' AS summary FROM nation")
def table_types(spark, sf_dir):
    """Types of a table's columns and its summary."""
    t = nation_table(spark, sf_dir)
    return t.select(F.array_join(tables.column_types(F.col("headers"), F.col("rows")), " ").alias("types"), tables.summary(F.col("headers"), F.col("rows")).alias("summary"))


@query("table_chunks", "SELECT chunk_no::BIGINT AS chunk_no, row_start::BIGINT AS row_start, least(row_start + 10, n)::BIGINT AS row_end, row_start = 0 AS is_header FROM (SELECT n, unnest(range(0, (n - 1) // 10 + 1)) AS chunk_no, unnest(range(0, (n - 1) // 10 + 1)) * 10 AS row_start FROM (SELECT count(*) AS n FROM nation))")
def table_chunks(spark, sf_dir):
    """A table in ranges of ten rows."""
    c = nation_table(spark, sf_dir).select(F.posexplode(tables.table_chunks(F.col("headers"), F.col("rows"), 10)).alias("n", "c"))
    return c.select(F.col("n").cast("bigint").alias("chunk_no"), F.col("c.row_start").cast("bigint").alias("row_start"), F.col("c.row_end").cast("bigint").alias("row_end"), "c.is_header")


@query("tables_in_chunks")
def tables_in_chunks(spark, sf_dir):
    """Every pipe table of the chunks' texts."""
    one = table(spark, sf_dir, "chunk_records").where("text is not null").groupBy("chunk_id").agg(F.max("text").alias("text"))
    return tables.extract_tables(one, "chunk_id", "text")


@query("table_totals")
def table_totals(spark, sf_dir):
    """How many tables, rows and cells the chunks' texts hold."""
    return tables.table_stats(tables_in_chunks(spark, sf_dir))


@query("page_text")
def page_text(spark, sf_dir):
    """Documents put into pages with menu and footer, and read back from them."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><nav><a href='/'>Home</a></nav><main><h1>"), esc(F.coalesce("title", F.lit(""))), F.lit("</h1><p>"), esc(F.col("text")), F.lit("</p></main><footer>Imprint</footer></body></html>"))
    r = d.select("doc_id", html_to_text(page).alias("p"))
    return r.select("doc_id", "p.text", "p.headings", "p.links", "p.tables")


STATUS = "SELECT source_id, status FROM source_records WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY coalesce(processed_at, added_at) DESC NULLS LAST, status DESC NULLS LAST) = 1"


@query("corpus_audit", f"""WITH s AS (SELECT count(*) AS sources, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM ({STATUS})),
n AS (SELECT s.*, (SELECT count(DISTINCT chunk_id) FROM chunk_records) AS chunks, (SELECT count(DISTINCT chunk_id) FROM vector_records) AS vectors FROM s)
SELECT *, vectors < chunks AS stale, sources > 0 AND chunks > 0 AND vectors >= chunks AND failed = 0 AS healthy, CASE WHEN sources = 0 THEN 'add sources' WHEN failed > 0 THEN 'retry failed sources' WHEN pending > 0 THEN 'build pending sources' WHEN chunks = 0 THEN 'run the build' WHEN vectors < chunks THEN 'embed chunks without vectors' ELSE 'none' END AS recommendation FROM n""")
def corpus_audit(spark, sf_dir):
    """Health of the corpus."""
    return diagnostics.audit(table(spark, sf_dir, "source_records"), table(spark, sf_dir, "chunk_records"), table(spark, sf_dir, "vector_records"))


@query("build_progress", "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status IN ('completed', 'failed')) / count(*), 6) AS done_share FROM source_records")
def build_progress(spark, sf_dir):
    """Sources by status."""
    return catalog.progress(table(spark, sf_dir, "source_records"))


@query("sources_pending", "SELECT source_id, type, uri, status FROM source_records WHERE status IN ('pending', 'failed') AND source_id NOT IN (SELECT source_id FROM chunk_records WHERE source_id IS NOT NULL)")
def sources_pending(spark, sf_dir):
    """Sources still to be built: pending or failed, and without chunks so far."""
    done = table(spark, sf_dir, "chunk_records").where("source_id is not null").select("source_id")
    return catalog.pending(table(spark, sf_dir, "source_records"), done).select("source_id", "type", "uri", "status")


@query("sources_add", """WITH b AS (SELECT row_number() OVER (ORDER BY source_id, added_at, status, uri) AS position, type, uri FROM source_records WHERE type IN ('url', 'pdf')), e AS (SELECT DISTINCT type, uri FROM source_records WHERE status = 'completed'),
j AS (SELECT b.type, b.uri, e.uri IS NOT NULL AS known, position > min(position) OVER (PARTITION BY b.type, b.uri) AS again FROM b LEFT JOIN e ON b.type = e.type AND b.uri = e.uri)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN known THEN 'already exists' WHEN again THEN 'repeated in batch' ELSE '' END AS reason FROM j) GROUP BY reason""")
def sources_add(spark, sf_dir):
    """What becomes of all url and pdf sources if they are added to the completed ones."""
    from pyspark.sql import Window as W

    s = table(spark, sf_dir, "source_records")
    # a batch is small (up to 50 sources from users); here the order only has to be some total one, so it is a hash-free rank by key
    given = s.where(F.col("type").isin("url", "pdf")).withColumn("position", F.struct("source_id", "added_at", "status", F.row_number().over(W.partitionBy("source_id", "added_at", "status").orderBy("uri"))))
    return new_sources(given.select("position", "type", "uri"), s.where("status = 'completed'")).groupBy("reason").agg(F.count("*").alias("n"))


@query("sources_remove", """WITH g AS (SELECT DISTINCT source_id FROM source_records WHERE status = 'failed'), c AS (SELECT DISTINCT chunk_id, source_id FROM chunk_records WHERE source_id IN (SELECT source_id FROM g)),
v AS (SELECT c.source_id, count(*) AS n FROM vector_records JOIN c USING (chunk_id) GROUP BY c.source_id), k AS (SELECT source_id, count(*) AS n FROM c GROUP BY source_id)
SELECT g.source_id, coalesce(k.n, 0) AS chunks_removed, coalesce(v.n, 0) AS vectors_removed FROM g LEFT JOIN k USING (source_id) LEFT JOIN v USING (source_id)""")
def sources_remove(spark, sf_dir):
    """What would go with the failed sources."""
    gone = table(spark, sf_dir, "source_records").where("status = 'failed'")
    return catalog.cascade(table(spark, sf_dir, "chunk_records"), table(spark, sf_dir, "vector_records"), gone)[2]


@query("run_diff", """WITH a AS (SELECT DISTINCT chunk_id FROM chunk_records WHERE chunk_id IS NOT NULL AND created_at < TIMESTAMPTZ '2024-03-01 00:00:00+00'), b AS (SELECT DISTINCT chunk_id FROM chunk_records WHERE chunk_id IS NOT NULL AND created_at >= TIMESTAMPTZ '2024-02-01 00:00:00+00')
SELECT CASE WHEN a.chunk_id IS NULL THEN 'added' WHEN b.chunk_id IS NULL THEN 'removed' ELSE 'unchanged' END AS change, count(*) AS n FROM a FULL JOIN b ON a.chunk_id = b.chunk_id GROUP BY 1""")
def run_diff(spark, sf_dir):
    """Chunks of two overlapping runs, told apart by time."""
    c = table(spark, sf_dir, "chunk_records")
    return catalog.run_diff(c.where("created_at < timestamp '2024-03-01 00:00:00 UTC'"), c.where("created_at >= timestamp '2024-02-01 00:00:00 UTC'"), "chunk_id")


@query("chunks_to_embed", "SELECT DISTINCT chunk_id FROM chunk_records WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM vector_records WHERE chunk_id IS NOT NULL)")
def chunks_to_embed(spark, sf_dir):
    """Chunks without any vector."""
    return index.to_embed(table(spark, sf_dir, "chunk_records").select("chunk_id").where("chunk_id is not null").distinct(), table(spark, sf_dir, "vector_records"))


@query("upsert_counts", "WITH o AS (SELECT DISTINCT chunk_id AS id FROM vector_records WHERE model = 'prism-64'), n AS (SELECT DISTINCT chunk_id AS id FROM vector_records WHERE created_at >= TIMESTAMPTZ '2024-02-01 00:00:00+00' AND chunk_id IS NOT NULL) SELECT count(*) FILTER (o.id IS NULL) AS inserted, count(*) FILTER (o.id IS NOT NULL AND n.id IS NOT NULL) AS updated, count(*) FILTER (n.id IS NULL) AS untouched FROM o FULL JOIN n ON o.id = n.id")
def upsert_counts(spark, sf_dir):
    """What an upsert of the newer vectors into one model's collection would do."""
    v = table(spark, sf_dir, "vector_records").withColumnRenamed("chunk_id", "id")
    return index.upsert_counts(v.where("model = 'prism-64'"), v.where("created_at >= timestamp '2024-02-01 00:00:00 UTC'"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Events by hour and type, as a batch."""
    return ingest.windowed(table(spark, sf_dir, "events"))


@query("event_windows_stream", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING window_start + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 10 minute")
def event_windows_stream(spark, sf_dir):
    """The same as a stream: the windows that the watermark has closed."""
    schema = table(spark, sf_dir, "events").schema
    return ingest.drain(ingest.windowed(ingest.file_stream(spark, sf_dir, "events.parquet", schema)), "windows")


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS key, min(ts) AS session_start, max(ts) + INTERVAL 30 minute AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """Sessions of users with gaps of at most half an hour."""
    return ingest.sessions(table(spark, sf_dir, "events"))


@query("ingest_stream", "SELECT min(doc_id) AS doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), '    '))) AS content_hash FROM documents WHERE text IS NOT NULL GROUP BY 2")
def ingest_stream(spark, sf_dir):
    """Documents ingested by a stream, each content once."""
    import uuid

    base = f"{shared_dir(spark)}/textloom/ingest-{uuid.uuid4().hex}"
    docs = ingest.file_stream(spark, sf_dir, "documents.parquet", table(spark, sf_dir, "documents").schema)
    ingest.ingest_new(docs.select("doc_id", "text"), f"{base}/out", f"{base}/state")
    return durable(ingest.ingested(spark, f"{base}/out", kind=docs.schema["doc_id"].dataType.simpleString()), "ingested")


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


BUILT = """WITH w AS (SELECT source AS source_id, doc_id, s AS start_char, substring(text, s + 1, 1500) AS t FROM (
  SELECT source, doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 1500) / 1350.0) AS BIGINT), 0) * 1350 + 1, 1350)) AS s FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0)),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY left(sha256(t), 16) ORDER BY source_id, doc_id, start_char) = 1)"""


@query("build_forced", BUILT + " SELECT source_id, count(*) AS chunks, CAST(sum(length(t)) AS BIGINT) AS chars, count(*) AS vectors FROM f GROUP BY source_id")
def build_forced(spark, sf_dir):
    """A project of all documents' sources, built once and then built again by force: chunks, characters and vectors of each source."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    p = catalog.Project(spark, _folder(spark, "project"), "forced")
    names = docs.select(F.col("source").alias("source_id")).distinct()
    p.commit(sources=spark.createDataFrame([], catalog.SOURCE).unionByName(names.select("source_id", F.lit("text").alias("type"), F.col("source_id").alias("uri"), F.lit("pending").alias("status")), allowMissingColumns=True))
    fetch = lambda due: due.select("source_id").join(docs.select(F.col("source").alias("source_id"), F.col("doc_id").alias("part"), "text"), "source_id").withColumn("error", F.lit(None).cast("string"))
    embed = lambda chunks: chunks.select("chunk_id", F.array(F.length("text").cast("float")).alias("embedding"), F.lit("length").alias("model"))
    for force in (False, True):
        p.build(fetch, embed, catalog.BuildConfig(force=force, max_sources=None))
    return p.read("chunks").join(p.read("vectors").select("chunk_id"), "chunk_id").groupBy("source_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.count("*").alias("vectors"))


@query("run_lifecycle", "SELECT 'read' AS phase, 'completed' AS status, 60 AS seconds, count(*) AS inputs, count(text) AS outputs, count(*) - count(text) AS errors FROM documents UNION ALL SELECT 'dedupe', 'completed', 120, count(text), count(DISTINCT text), 0 FROM documents")
def run_lifecycle(spark, sf_dir):
    """A run over the documents in two phases, written to a run log and read back."""
    from datetime import datetime, timedelta

    d = table(spark, sf_dir, "documents")
    n = d.agg(F.count("*").alias("rows"), F.count("text").alias("texts"), F.countDistinct("text").alias("distinct")).first()
    log, t = catalog.RunLog(spark, _folder(spark, "runs")), datetime(2024, 5, 1)
    run = log.create({"tables": ["documents"], "phases": {"read": 1, "dedupe": 2}}, now=t)
    log.phase(run, "read", inputs=n["rows"], now=t)
    log.phase(run, "read", "completed", n["rows"], n["texts"], n["rows"] - n["texts"], t + timedelta(seconds=60))
    log.phase(run, "dedupe", inputs=n["texts"], now=t + timedelta(seconds=60))
    log.phase(run, "dedupe", "completed", n["texts"], n["distinct"], 0, t + timedelta(seconds=180))
    log.complete(run, now=t + timedelta(seconds=180))
    return catalog.run_status(log.read()).select("phase", "status", "seconds", "inputs", "outputs", "errors")


@query("sources_remaining", "SELECT count(*) FILTER (status IN ('pending', 'processing')) AS left, round(avg(CASE WHEN status IN ('completed', 'failed') AND processed_at IS NOT NULL THEN floor(epoch(processed_at)) - floor(epoch(added_at)) END), 3) AS mean_seconds, round(count(*) FILTER (status IN ('pending', 'processing')) * coalesce(round(avg(CASE WHEN status IN ('completed', 'failed') AND processed_at IS NOT NULL THEN floor(epoch(processed_at)) - floor(epoch(added_at)) END), 3), 0), 3) AS eta_seconds FROM source_records")
def sources_remaining(spark, sf_dir):
    """Sources left, mean time of the built ones, time to go."""
    return catalog.remaining(table(spark, sf_dir, "source_records"))


@query("run_report", """WITH a AS (SELECT * FROM chunk_records WHERE created_at < TIMESTAMPTZ '2024-03-01 00:00:00+00'), b AS (SELECT * FROM chunk_records WHERE created_at >= TIMESTAMPTZ '2024-02-01 00:00:00+00'), u AS (SELECT source_id, max(uri) AS uri FROM source_records GROUP BY source_id),
k AS (SELECT 'chunks' AS what, a.k AS x, b.k AS y FROM (SELECT DISTINCT chunk_id AS k FROM a WHERE chunk_id IS NOT NULL) a FULL JOIN (SELECT DISTINCT chunk_id AS k FROM b WHERE chunk_id IS NOT NULL) b ON a.k = b.k
UNION ALL SELECT 'sources', a.k, b.k FROM (SELECT DISTINCT uri AS k FROM a JOIN u USING (source_id) WHERE uri IS NOT NULL) a FULL JOIN (SELECT DISTINCT uri AS k FROM b JOIN u USING (source_id) WHERE uri IS NOT NULL) b ON a.k = b.k)
SELECT what, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'unchanged' END AS change, count(*) AS n FROM k GROUP BY 1, 2 UNION ALL SELECT 'config', 'changed', 1""")
def run_report(spark, sf_dir):
    """Configuration, source URIs and chunks of two overlapping runs."""
    c, u = table(spark, sf_dir, "chunk_records"), table(spark, sf_dir, "source_records").groupBy("source_id").agg(F.max("uri").alias("uri"))
    a, b = c.where("created_at < timestamp '2024-03-01 00:00:00 UTC'"), c.where("created_at >= timestamp '2024-02-01 00:00:00 UTC'")
    return catalog.run_report({"before": "2024-03-01"}, {"from": "2024-02-01"}, tuple(x.join(u, "source_id").select("uri") for x in (a, b)), (a, b))
