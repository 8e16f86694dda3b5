"""Queries of the smaller operators over whole tables: splitting, registered functions, sinks and readers, filters, retrieval's side functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import registered, text as texts, vectors
from textloom.operators import catalog, chunking, context, dedupe, diagnostics, enrich, extract, index, pipeline, retrieval, tables
from textloom.plans import search
from textloom.plans.corpus import EXACT, SECTIONS, TAG_RULES
from textloom.plans.registry import Registry
from textloom.plans.search import CHUNKS, ROWS, TEXT, VECTOR, rows, top
from textloom.runtime import durable, shared_dir, table
from textloom.schema import ChunkConfig, ExpandConfig, RetrievalProfile
from textloom.sources import readers, writers

registry = Registry()
query = registry.query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


# Fixed value: white space as Python's patterns see it, for an engine whose \s is ASCII only.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _packed(parts: str, joint: str) -> str:
    """SQL that packs a list of strings greedily up to 1,500 characters."""
    return f"""SELECT doc_id, unnest(range(0, len(c)))::BIGINT AS chunk_index, unnest(c) AS text FROM (SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]),
  lambda a, b: CASE WHEN length(a[-1]) + length({joint}) + length(b[1]) <= 1500 THEN list_concat(a[:-2], [a[-1] || {joint} || b[1]]) ELSE list_concat(a, b) END) AS c FROM ({parts}) WHERE len(p) > 0)"""


SENTENCES = _packed(f"SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]){BLANK}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL AND text <> ''", "' '")
PARAGRAPHS = _packed(f"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL AND text <> ''", "chr(10) || chr(10)")


def _split(spark, sf_dir, strategy):
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.posexplode(chunking.pieces(F.col("text"), ChunkConfig(strategy=strategy))).alias("chunk_index", "c"))
    return d.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "c.text")


@query("split_sentences", SENTENCES)
def split_sentences(spark, sf_dir):
    """Sentences of every document packed up to 1,500 characters."""
    return _split(spark, sf_dir, "by_sentence")


@query("split_paragraphs", PARAGRAPHS)
def split_paragraphs(spark, sf_dir):
    """Paragraphs of every document packed up to 1,500 characters."""
    return _split(spark, sf_dir, "by_paragraph")


@query("udtf_chunk_text", SENTENCES)
def udtf_chunk_text(spark, sf_dir):
    """The registered table function chunk_text called from SQL."""
    registered.register(spark)
    return spark.sql("SELECT d.doc_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.text FROM {d} d, LATERAL chunk_text(d.text, 'by_sentence', 1500, 150) c", d=table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("udf_nfc", "SELECT doc_id, sha256(nfc_normalize(text)) AS h FROM documents WHERE text IS NOT NULL")
def udf_nfc(spark, sf_dir):
    """The registered function nfc called from SQL."""
    registered.register(spark)
    return spark.sql("SELECT doc_id, sha2(nfc(text), 256) AS h FROM {d} WHERE text IS NOT NULL", d=table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("mock_embedding", """WITH s AS (SELECT doc_id, ('0x' || left(sha256(text), 8))::BIGINT::DOUBLE AS x FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_reduce(list_prepend([x], list_transform(range(64), lambda i: [0.0::DOUBLE])), lambda a, b: list_append(a, fmod(a[-1] * 1103515245.0::DOUBLE + 12345.0::DOUBLE, 2147483648.0::DOUBLE)))[2:] AS e FROM s),
v AS (SELECT doc_id, list_transform(e, lambda y: y / 2147483648.0::DOUBLE * 2 - 1) AS e FROM r)
SELECT doc_id, unnest(range(64))::BIGINT AS i, round(unnest(e) / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6) AS value FROM v""")
def mock_embeddings(spark, sf_dir):
    """All numbers of the seeded mock vectors of all documents in 64 dimensions."""
    e = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(vectors.mock_embedding(64)(F.col("text"))).alias("i", "v"))
    return e.select("doc_id", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("value"))


@query("local_embedding_values", """WITH r AS (SELECT doc_id, list_transform(range(1, 33), lambda i: CASE WHEN i <= length(text) THEN unicode(substring(text, i, 1)) / 255.0 ELSE 0.0 END::DOUBLE) AS e FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM r)
SELECT doc_id, unnest(range(32))::BIGINT AS i, round(unnest(CASE WHEN n = 0 THEN e ELSE list_transform(e, lambda x: x / n) END), 6) AS value FROM n""")
def local_embedding_values(spark, sf_dir):
    """All numbers of the placeholder embeddings of all documents in 32 dimensions."""
    e = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(vectors.local_embedding(F.col("text"), 32)).alias("i", "v"))
    return e.select("doc_id", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("value"))


@query("l2_normalize_values", "SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS i, round(unnest(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS value FROM embeddings")
def l2_normalize_values(spark, sf_dir):
    """All numbers of all vectors at unit length."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("i", "v"))
    return e.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("value"))


@query("embedding_cost", "SELECT doc_id, round(ceil(length(text) / 4.0) / 1000000 * 0.02, 9) AS cost FROM documents")
def embedding_cost(spark, sf_dir):
    """What embedding every document would cost."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(vectors.embedding_cost(texts.token_estimate(F.col("text"))), 9).alias("cost"))


@query("shell_pages", r"""WITH t AS (SELECT extract_id, max(text) AS text FROM extract_results WHERE extract_id IS NOT NULL AND text IS NOT NULL GROUP BY extract_id),
l AS (SELECT *, lower(text) AS low, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS ls FROM t)
SELECT extract_id, (length(low) - length(replace(low, 'loading', ''))) // 7 >= 3 OR regexp_matches(low, '^\s*(404|not found|page not found)') OR (len(ls) > 20 AND list_sum(list_transform(ls, lambda s: length(s))) / len(ls) < 30)
 OR (regexp_matches(text, '(?i)id=["''](root|app|__next|__nuxt)["'']|ng-app|data-reactroot') AND length(text) < 1000) AS shell FROM l""")
def shell_pages(spark, sf_dir):
    """Which extracted texts look like shells that scripts would fill."""
    one = table(spark, sf_dir, "extract_results").where("extract_id is not null and text is not null").groupBy("extract_id").agg(F.max("text").alias("text"))
    return one.select("extract_id", extract.needs_render(F.col("text"), F.col("text")).alias("shell"))


@query("page_slices", "SELECT doc_id, p AS page, substring(text, (p - 1) * n + 1, n) AS text, length(substring(text, (p - 1) * n + 1, n)) AS char_count FROM (SELECT doc_id, text, greatest(ceil(length(text) / 4.0), 1)::BIGINT AS n, unnest([2, 3])::BIGINT AS p FROM documents WHERE text IS NOT NULL)")
def page_slices(spark, sf_dir):
    """Pages two to three of four of every document without page marks."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(extract.page_slices(F.col("text"), F.lit(4), 2, 3)).alias("p"))
    return d.select("doc_id", F.col("p.page").cast("bigint").alias("page"), "p.text", F.col("p.char_count").cast("bigint").alias("char_count"))


@query("captions", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN 'Figure ' || p_partkey ELSE 'Table ' || p_partkey || ': ' || trim(p_name) END AS caption FROM part")
def captions(spark, sf_dir):
    """Captions in their three forms, and none, before a table."""
    k, name = F.col("p_partkey").cast("string"), F.trim("p_name")
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("**Table "), k, F.lit(": "), name, F.lit("**"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("table "), k, F.lit(" "), name)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Figure "), k)).otherwise("No caption")
    return table(spark, sf_dir, "part").select("p_partkey", tables.caption(F.concat(F.lit("Table 1: too far away\nx\n\n"), line, F.lit("\nlast\nlines"))).alias("caption"))


_LIST = "list(n_nationkey::VARCHAR ORDER BY n_nationkey) AS k, list(n_name ORDER BY n_nationkey) AS v FROM nation GROUP BY n_regionkey"


@query("tables_by_region", f"""SELECT n_regionkey, array_to_string(list_transform(range(1, len(k) + 1), lambda i: 'Row ' || i || ': key=' || k[i] || ', name=' || v[i]), '; ') AS by_row, 'Column ''key'': ' || array_to_string(k, ', ') || '; Column ''name'': ' || array_to_string(v, ', ') AS by_column,
'This table has ' || len(k) || ' rows and 2 columns. The column key holds values such as ' || array_to_string(k[:3], ', ') || '. The column name holds values such as ' || array_to_string(v[:3], ', ') || '.' AS words, 'number string' AS types FROM (SELECT n_regionkey, {_LIST})""")
def tables_by_region(spark, sf_dir):
    """The nations of every region as a table, in three wordings, with its types."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("c")))).alias("a"))
    h, r = F.array(F.lit("key"), F.lit("name")), F.transform("a", lambda x: x["c"])
    return n.select("n_regionkey", tables.linearize(h, r).alias("by_row"), tables.linearize(h, r, "column_by_column").alias("by_column"), tables.linearize(h, r, "natural_language").alias("words"), F.array_join(tables.column_types(h, r), " ").alias("types"))


@query("removed_lists", f"SELECT k AS kept_id, count(*) AS n_removed, string_agg(id, ' ' ORDER BY id) AS removed FROM ({EXACT.format(scope='')}) WHERE text IS NOT NULL AND id <> k GROUP BY k")
def removed_lists(spark, sf_dir):
    """Which chunks every kept chunk stands for."""
    return dedupe.removed_lists(dedupe.exact(table(spark, sf_dir, "chunk_records"), "chunk_id", "text"), 1_000_000).select("kept_id", "n_removed", F.array_join("removed", " ").alias("removed"))


@query("enrich_report", r"""WITH e AS (SELECT coalesce(lang, 'unknown') AS l, list_distinct(list_concat(list_transform(regexp_extract_all(text, '\b((?:19|20)\d\d)\b', 1), lambda x: 'year:' || x), list_transform(regexp_extract_all(text, '\b(\d{1,3},\d{3})\b', 1), lambda x: 'amount:' || x))) AS t,
 CASE """ + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in SECTIONS) + """ END AS s FROM documents WHERE text IS NOT NULL), g AS (SELECT l, count(*) AS n FROM e GROUP BY l)
SELECT (SELECT count(*) FROM e) AS enriched, (SELECT count(*) FROM e WHERE len(t) > 0) AS tagged, (SELECT count(s) FROM e) AS with_section, (SELECT sum(len(t))::BIGINT FROM e) AS tags, (SELECT string_agg(l || '=' || n, ' ' ORDER BY l) FROM g) AS languages""")
def enrich_report(spark, sf_dir):
    """How many documents got tags and sections, and a map of their languages."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("lang", enrich.regex_tags(F.col("text"), TAG_RULES).alias("t"), enrich.first_section(F.col("text"), SECTIONS).alias("s"))
    r = enrich.enrich_stats(d, "lang", "t", "s")
    return r.select("enriched", "tagged", "with_section", "tags", F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias("languages"))


# --- sources, sinks and catalog ---


@query("media_types", """SELECT extract_id, coalesce(map_extract(MAP {'text/html': 'html', 'application/pdf': 'pdf', 'text/plain': 'txt', 'text/markdown': 'md', 'application/json': 'json', 'text/csv': 'csv', 'application/xml': 'xml', 'text/xml': 'xml', 'application/octet-stream': 'bin'}, trim(lower(split_part(content_type, ';', 1))))[1], 'bin') AS extension FROM (SELECT extract_id, max(content_type) AS content_type FROM extract_results WHERE extract_id IS NOT NULL GROUP BY extract_id)""")
def media_types(spark, sf_dir):
    """Extension for the content type of every response."""
    one = table(spark, sf_dir, "extract_results").where("extract_id is not null").groupBy("extract_id").agg(F.max("content_type").alias("content_type"))
    return one.select("extract_id", texts.extension_of_type(F.col("content_type")).alias("extension"))


@query("json_lines_round_trip", "SELECT doc_id, text, source, n_chars FROM documents")
def json_lines_round_trip(spark, sf_dir):
    """All documents written as JSON lines in two appends and read back with their schema."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"), _folder(spark, "lines")
    writers.json_lines(d.where("doc_id % 2 = 0"), path)
    writers.json_lines(d.where("doc_id % 2 = 1"), path, append=True)
    return readers.json_lines(spark, path, "doc_id bigint, text string, source string, n_chars bigint")


@query("folder_files", "SELECT sha256(n_name || chr(10)) AS sha256, length(n_name) + 1 AS size_bytes, 'text/plain' AS content_type FROM nation")
def folder_files(spark, sf_dir):
    """A folder with a text file for every nation, scanned."""
    path = _folder(spark, "files")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return readers.folder(spark, path, "*.txt").select("sha256", "size_bytes", "content_type")


@query("ordered_chunks", "SELECT doc_id, chunk_id, chunk_index FROM document_chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY source.retrieved_at DESC NULLS LAST, doc_id DESC NULLS LAST, chunk_index DESC NULLS LAST) = 1")
def ordered_chunks(spark, sf_dir):
    """The current chunks written in order over files and read back."""
    path = _folder(spark, "ordered")
    writers.ordered_chunks(context.latest_chunks(table(spark, sf_dir, "document_chunks")).select("doc_id", "chunk_id", "chunk_index"), path)
    return spark.read.parquet(path)


@query("new_embeddings", "SELECT chunk_id, model FROM vector_records WHERE model = 'facet-64' AND chunk_id IS NOT NULL UNION ALL SELECT chunk_id, model FROM vector_records WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM vector_records WHERE model = 'facet-64' AND chunk_id IS NOT NULL)")
def new_embeddings(spark, sf_dir):
    """Vectors of one model, with those of chunks that have none of it appended."""
    v, path = table(spark, sf_dir, "vector_records").where("chunk_id is not null").select("chunk_id", "model"), _folder(spark, "vectors")
    writers.parquet(v.where("model = 'facet-64'"), path)
    writers.new_embeddings(v, spark.read.parquet(path), path)
    return spark.read.parquet(path)


@query("collection_stored", "SELECT v.id, c.start_char AS position_start_char, length(c.text) AS n_chars FROM (SELECT DISTINCT chunk_id AS id FROM vector_records WHERE chunk_id IS NOT NULL) v JOIN (SELECT chunk_id AS id, max(text) AS text, max(position.start_char) AS start_char FROM chunk_records GROUP BY chunk_id) c USING (id)")
def collection_stored(spark, sf_dir):
    """A collection of vectors with a nested field and the text of their chunks, stored and read back."""
    c = table(spark, sf_dir, "chunk_records").groupBy("chunk_id").agg(F.max("text").alias("text"), F.struct(F.max("position.start_char").alias("start_char")).alias("position"))
    v = table(spark, sf_dir, "vector_records").where("chunk_id is not null").select("chunk_id").distinct().withColumn("embedding", F.array(F.lit(1.0)))
    path = _folder(spark, "collection")
    writers.parquet(index.collection(c, v, ["position.start_char"]), path)
    return spark.read.parquet(path).select("id", "position_start_char", F.length("text").alias("n_chars"))


@query("collection_manifest", "SELECT 'facet' AS collection, 'facet-64' AS model_used, max(len(embedding)) AS dimensions, count(*) AS vectors_count FROM vector_records WHERE model = 'facet-64'")
def collection_manifest(spark, sf_dir):
    """What the manifest says of one model's vectors."""
    return index.manifest(table(spark, sf_dir, "vector_records").where("model = 'facet-64'"), "facet", "facet-64")


@query("upsert_rows", "WITH n AS (SELECT chunk_id AS id, max(created_at) AS made_at FROM vector_records WHERE created_at >= TIMESTAMPTZ '2024-02-01 00:00:00+00' AND chunk_id IS NOT NULL GROUP BY 1) SELECT id, made_at FROM n UNION ALL SELECT chunk_id, created_at FROM vector_records WHERE model = 'prism-64' AND (chunk_id IS NULL OR chunk_id NOT IN (SELECT id FROM n))")
def upsert_rows(spark, sf_dir):
    """The rows after an upsert of the newer vectors into one model's collection."""
    v = table(spark, sf_dir, "vector_records").select(F.col("chunk_id").alias("id"), F.col("created_at").alias("made_at"), "model")
    return index.upsert(v.where("model = 'prism-64'").drop("model"), v.where("made_at >= timestamp '2024-02-01 00:00:00 UTC'").drop("model"))


@query("event_log", "SELECT event_type AS phase, 'info' AS level, count(*)::VARCHAR AS data FROM events GROUP BY 1")
def event_log(spark, sf_dir):
    """One log line for each type of event, appended, read back and filtered by level."""
    path = _folder(spark, "log")
    for r in table(spark, sf_dir, "events").groupBy("event_type").count().orderBy("event_type").collect():  # a handful of types
        writers.event_log(spark, path, "info", r["event_type"], "count", "counted", str(r["count"]))
    writers.event_log(spark, path, "error", "none", "count", "not shown")
    return readers.events(spark, path, "info").select("phase", "level", "data")


@query("runs_listed", "SELECT 'r' || k AS run_id, 'completed' AS status, 1 AS phases, k * 10 AS seconds, k AS inputs, 2 * k AS outputs, 0 AS errors FROM range(2, 5) t(k)")
def runs_listed(spark, sf_dir):
    """Completed runs after a day, newest first, with their totals."""
    from datetime import datetime, timedelta

    log = catalog.RunLog(spark, _folder(spark, "runs"))
    for k in range(6):
        at = datetime(2024, 3, 1 + k)
        log.create({"k": k}, f"r{k}", at)
        log.phase(f"r{k}", "all", now=at)
        log.phase(f"r{k}", "all", "completed", k, 2 * k, 0, at + timedelta(seconds=10 * k))
        log.complete(f"r{k}", "completed" if k != 5 else "failed", at + timedelta(minutes=5))
    return catalog.run_totals(catalog.list_runs(log.read(), "completed", after=datetime(2024, 3, 2, 12)))


HOST = r"regexp_extract(lower(uri), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"


@query("safe_addresses", f"SELECT uri, regexp_matches(uri, '(?i)^https?://') AND regexp_replace({HOST}, '^www\\.', '') <> '' AND NOT regexp_matches(regexp_replace({HOST}, '^www\\.', ''), '^(localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2\\d|3[01])\\.|0\\.0\\.0\\.0|\\[?::1)') AS safe FROM source_records WHERE uri IS NOT NULL")
def safe_addresses(spark, sf_dir):
    """Whether the address of every source may be fetched."""
    return table(spark, sf_dir, "source_records").where("uri is not null").select("uri", texts.safe_url(F.col("uri")).alias("safe"))


@query("safe_names", "SELECT source, regexp_matches(source, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?$') AND length(source) <= 64 AS as_id, regexp_matches(source, '^[A-Za-z0-9_-]{1,64}$') AS as_tag FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def safe_names(spark, sf_dir):
    """Which names of sources could be ids of projects and tags."""
    return table(spark, sf_dir, "documents").where("source is not null").select("source").distinct().select("source", texts.safe_id(F.col("source")).alias("as_id"), texts.safe_tag(F.col("source")).alias("as_tag"))


@query("urls_selected", "SELECT DISTINCT uri FROM source_records WHERE uri <> '' AND regexp_matches(uri, '/(guide|docs)/') AND NOT regexp_matches(uri, '\\?ref=')")
def urls_selected(spark, sf_dir):
    """All addresses that match a pattern to include and none to exclude."""
    return readers.select_urls(table(spark, sf_dir, "source_records").select("uri"), ["/(guide|docs)/"], [r"\?ref="], None)


@query("sources_tagged", "SELECT source_id, status FROM source_records WHERE list_contains(tags, 'public')")
def sources_tagged(spark, sf_dir):
    """Sources that have a tag."""
    return table(spark, sf_dir, "source_records").where(retrieval.predicate("tags", "has", "public")).select("source_id", "status")


@query("sources_add_all", """WITH b AS (SELECT row_number() OVER (ORDER BY source_id, added_at, status, uri) AS position, type, uri FROM source_records), e AS (SELECT DISTINCT type, uri FROM source_records WHERE status = 'completed'),
j AS (SELECT b.type, b.uri, e.uri IS NOT NULL AS known, position > min(position) OVER (PARTITION BY b.type, b.uri) AS again FROM b LEFT JOIN e ON b.type = e.type AND b.uri = e.uri)
SELECT type, CASE WHEN known THEN 'already exists' WHEN again THEN 'repeated in batch' ELSE '' END AS reason, count(*) AS n FROM j GROUP BY ALL""")
def sources_add_all(spark, sf_dir):
    """What becomes of all sources of every type if they are added to the completed ones."""
    s = table(spark, sf_dir, "source_records")
    given = s.select("type", "uri", F.struct("source_id", "added_at", "status", F.monotonically_increasing_id()).alias("position"))
    return dedupe.new_sources(durable(given, "given"), s.where("status = 'completed'").select("type", "uri")).groupBy("type", "reason").agg(F.count("*").alias("n"))


@query("event_props", "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def event_props(spark, sf_dir):
    """A field inside the events' JSON, summed."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


# --- retrieval and context ---

BROAD = "overview of every barn ledger"
_BROAD_RATIO = " + ".join(f"contains(lower(text), '{t}')::INT" for t in retrieval.terms_of(BROAD))


@query("hybrid_broad", f"""WITH {ROWS}, b AS (SELECT id, round(({_BROAD_RATIO}) / {len(retrieval.terms_of(BROAD))}.0, 9) AS score FROM r WHERE text IS NOT NULL), w AS ({top('b', 30, 'score > 0')}), s AS ({top('sem', 30)}),
x AS (SELECT id, round(0.5 * coalesce(w.score, 0) + 0.5 * coalesce((s.score + 1) / 2, 0), 9) AS score FROM w FULL JOIN s USING (id)) {top('x', 10)}""")
def hybrid_broad(spark, sf_dir):
    """Adaptive hybrid for a query without identifiers, weighted by how specific it is."""
    return search.out(retrieval.adaptive(rows(spark, sf_dir), BROAD, VECTOR))


@query("serve_without_vector", f"WITH {ROWS}, h AS ({top('frq', 7, 'score > 0')}) SELECT h.id, h.score, h.rank, r.text FROM h JOIN r USING (id)")
def serve_without_vector(spark, sf_dir):
    """A hybrid request without a vector, served by keywords with the profile's number of hits and their texts."""
    hits = retrieval.serve(rows(spark, sf_dir), TEXT, None, "hybrid", profile=RetrievalProfile(top_k=7))
    return hits.select("id", "score", F.col("rank").cast("bigint").alias("rank"), "text")


@query("reranked", f"WITH {ROWS}, h AS ({top('rat', 30, 'score > 0')}), x AS (SELECT h.id, length(r.text)::DOUBLE AS score FROM h JOIN r USING (id)) {top('x', 5)}")
def reranked(spark, sf_dir):
    """Thirty hits ordered anew by a given function of their texts."""
    r = rows(spark, sf_dir)
    return search.out(pipeline.rerank(retrieval.keyword(r, TEXT, 30, "ratio"), r, lambda t: float(len(t)), 5))


@query("search_trace", f"WITH {ROWS} SELECT * FROM (SELECT 0::BIGINT AS step, 'collection' AS name, count(*) AS rows FROM r UNION ALL SELECT 1, 'filtered', count(*) FROM r WHERE model = 'facet-64' UNION ALL SELECT 2, 'hits', least(10, (SELECT count(*) FROM sem)))")
def search_trace(spark, sf_dir):
    """How many rows pass each stage of a search."""
    trace = pipeline.traced_search(rows(spark, sf_dir), VECTOR, 10, [("model", "eq", "facet-64")])[1]
    return spark.createDataFrame([(t["step"], t["name"], t["rows"]) for t in trace], "step bigint, name string, rows bigint")


@query("history_last_turns", "SELECT source, doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 10")
def history_last_turns(spark, sf_dir):
    """The last ten rows of every key, as of a conversation."""
    return retrieval.last_turns(table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_id"), "source", "doc_id", 10)


@query("classify_reasoning", f"SELECT doc_id, concat_ws(' ', upper(left(type, 1)) || substr(type, 2) || ' query,', complexity || ',', subtype || ',', CASE WHEN needs_retrieval THEN 'retrieval needed.' ELSE 'no retrieval needed.' END) AS reasoning FROM ({search._classify_sql()})")
def classify_reasoning(spark, sf_dir):
    """Why the titles of all documents were classified as they were."""
    return table(spark, sf_dir, "documents").select("doc_id", search.rules.classify(F.col("title")).alias("c")).select("doc_id", "c.reasoning")


ALL_HITS = CHUNKS[: CHUNKS.index("hit AS")] + """hit AS (SELECT chunk_id AS id FROM dc),
pl AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index NULLS FIRST, chunk_id) AS place FROM dc),
nb AS (SELECT a.chunk_id AS hit_id, b.chunk_id, b.place - a.place AS distance FROM pl a JOIN (SELECT unnest([-2, -1, 1, 2]) AS d) s ON true JOIN pl b ON a.doc_id = b.doc_id AND b.place = a.place + s.d)"""


@query("neighbours_all", f"WITH {ALL_HITS} SELECT hit_id, chunk_id, distance FROM nb")
def neighbours_all(spark, sf_dir):
    """Chunks up to two places around every chunk."""
    c = context.latest_chunks(table(spark, sf_dir, "document_chunks"))
    return context.neighbours(c, c.select(F.col("chunk_id").alias("id")), 2, 2).select("hit_id", "chunk_id", F.col("distance").cast("bigint").alias("distance"))


@query("parents_all", f"WITH {ALL_HITS} SELECT a.chunk_id AS hit_id, b.chunk_id, 'parent' AS role, 0::BIGINT AS distance FROM dc a JOIN dc b ON lower(trim(a.parent_id)) = lower(trim(b.chunk_id))")
def parents_all(spark, sf_dir):
    """The parent of every chunk, as hydration finds it (neighbours that are hits themselves are left out)."""
    c = context.latest_chunks(table(spark, sf_dir, "document_chunks"))
    h = context.hydrate(c, c.select(F.col("chunk_id").alias("id")), ExpandConfig(before=2, after=2, parent=True, max_total=4))
    return h.select("hit_id", "chunk_id", "role", F.col("distance").cast("bigint").alias("distance"))


@query("score_diagnosis_all", f"""WITH {ROWS}, s AS (SELECT count(*) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(var_pop(score), 6) AS variance, round(list_sort(list(score))[count(*) // 2 + 1], 6) AS upper_median FROM sem)
SELECT * FROM s""")
def score_diagnosis_all(spark, sf_dir):
    """Statistics of the cosines of all vectors to the query."""
    r = rows(spark, sf_dir).where(F.col("embedding").isNotNull())
    return diagnostics.score_statistics(r.select(F.round(vectors.cosine(F.col("embedding"), retrieval.vector(VECTOR)), 9).alias("score")))
