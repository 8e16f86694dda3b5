"""Queries over texts: identity, chunking, duplicates, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import document_id, host, normalize_text, token_estimate
from textloom.functions.vectors import l2_normalize, local_embedding, norm
from textloom.operators import chunking, dedupe, enrich
from textloom.operators.extract import format_of
from textloom.plans.registry import Registry
from textloom.runtime import table
from textloom.schema import ChunkConfig

registry = Registry()
query = registry.query
NORMALIZED = "nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), '    '))"


@query("document_ids", f"SELECT doc_id, sha256({NORMALIZED}) AS content_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def document_ids(spark, sf_dir):
    """Content identity and token estimate of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", document_id(normalize_text(F.col("text"))).alias("content_id"), token_estimate(F.col("text")).alias("tokens"))


@query("source_hosts", r"""
SELECT CASE WHEN h = '' THEN NULL ELSE h END AS host, count(*) AS n FROM (
  SELECT regexp_replace(regexp_extract(lower(uri), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') AS h FROM source_records) GROUP BY 1""")
def source_hosts(spark, sf_dir):
    """Source rows per host."""
    return table(spark, sf_dir, "source_records").groupBy(host(F.col("uri")).alias("host")).agg(F.count("*").alias("n"))


@query("response_formats", r"""
SELECT format, count(*) AS n FROM (SELECT CASE
  WHEN t IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN t = 'application/pdf' THEN 'pdf' WHEN starts_with(t, 'text/') OR t IN ('application/json', 'application/xml') THEN 'plain'
  WHEN t IN ('', 'application/octet-stream', 'binary/octet-stream') THEN CASE WHEN e IN ('html', 'htm') THEN 'html' WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('txt', 'md', 'csv', 'json', 'xml') THEN 'plain' ELSE 'unknown' END
  ELSE 'unknown' END AS format
  FROM (SELECT trim(lower(split_part(coalesce(content_type, ''), ';', 1))) AS t, regexp_extract(regexp_replace(lower(coalesce(uri, '')), '[?#].*$', ''), '\.([a-z0-9]{1,5})$', 1) AS e FROM extract_results)) GROUP BY 1""")
def response_formats(spark, sf_dir):
    """Which extractor the responses are routed to."""
    return table(spark, sf_dir, "extract_results").groupBy(format_of(F.col("content_type"), F.col("uri")).alias("format")).agg(F.count("*").alias("n"))


FIXED = "SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substring(text, CAST(i * 1350 + 1 AS BIGINT), 1500) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1350 + 1)) AS i FROM documents WHERE length(text) > 0)"


def fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"), 1500, 150)).alias("chunk_index", "text"))
    return docs.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "text")


@query("chunk_fixed", FIXED)
def chunk_fixed(spark, sf_dir):
    """Fixed windows of 1,500 characters that overlap by 150."""
    return fixed(spark, sf_dir)


@query("chunk_offsets", f"SELECT doc_id, chunk_index, CAST(coalesce(sum(strlen(text)) OVER w, 0) AS BIGINT) AS byte_start FROM ({FIXED}) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def chunk_offsets(spark, sf_dir):
    """Running byte offsets of the fixed windows."""
    sizes = F.transform(chunking.fixed_windows(F.col("text"), 1500, 150), lambda t: F.octet_length(t).cast("bigint"))
    ends = F.aggregate("sizes", F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", sizes.alias("sizes")).select("doc_id", F.posexplode(F.slice(ends, F.lit(1), F.size("sizes"))).alias("chunk_index", "byte_start"))
    return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "byte_start")


@query("chunk_pages", r"SELECT doc_id, CAST(unnest(range(0, len(p))) AS BIGINT) AS page, unnest(p) AS text FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\f|\n{4,}'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') AS p FROM documents WHERE text IS NOT NULL)")
def chunk_pages(spark, sf_dir):
    """Pages between form feeds or runs of line feeds."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.pages(F.col("text"))).alias("page", "text"))
    return rows.select("doc_id", F.col("page").cast("bigint").alias("page"), "text")


@query("chunk_stats", f"SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(round(avg(length(text))) AS BIGINT) AS avg_chars, count(*) FILTER (length(text) < 100) AS below_min, count(*) FILTER (length(text) >= 1490) AS at_max FROM ({FIXED})")
def chunk_stats(spark, sf_dir):
    """Sizes of the fixed windows."""
    return chunking.chunk_stats(fixed(spark, sf_dir).withColumn("char_count", F.length("text")))


@query("chunk_project", """
WITH w AS (SELECT source AS source_id, doc_id, s AS start_char, substring(text, s + 1, 1500) AS t FROM (
  SELECT source, doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 1500) / 1350.0) AS BIGINT), 0) * 1350 + 1, 1350)) AS s FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0)),
f AS (SELECT *, left(sha256(t), 16) AS content_hash FROM w QUALIFY row_number() OVER (PARTITION BY left(sha256(t), 16) ORDER BY source_id, doc_id, start_char) = 1)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id, start_char) - 1 AS chunk_index, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + length(t) AS BIGINT) AS end_char, content_hash FROM f""")
def chunk_project(spark, sf_dir):
    """Chunks of whole sources, repeated contents skipped and not numbered."""
    rows = chunking.chunk_project(table(spark, sf_dir, "documents"), "source", "doc_id")
    return rows.select("source_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "start_char", "end_char", "content_hash")


def _strategy(name: str):
    def run(spark, sf_dir):
        return chunking.chunk_documents(table(spark, sf_dir, "documents"), ChunkConfig(strategy=name), keep=["title"])

    run.__doc__ = f"Chunks of all documents by the strategy {name}."
    return run


for _name in ("recursive", "by_paragraph", "by_heading", "by_sentence", "hierarchical"):
    query(f"chunk_{_name}")(_strategy(_name))


EXACT = "SELECT id, min(id) OVER (PARTITION BY text{scope}) AS k, text FROM (SELECT DISTINCT chunk_id AS id, text{scope} FROM chunk_records WHERE chunk_id IS NOT NULL)"


@query("dedupe_exact", f"SELECT id, CASE WHEN text IS NULL THEN id ELSE k END AS kept_id, text IS NULL OR id = k AS is_kept FROM ({EXACT.format(scope='')})")
def dedupe_exact(spark, sf_dir):
    """For every chunk the one that stands for its text."""
    return dedupe.exact(table(spark, sf_dir, "chunk_records"), "chunk_id", "text")


@query("dedupe_exact_by_source", f"SELECT id, CASE WHEN text IS NULL THEN id ELSE k END AS kept_id, text IS NULL OR id = k AS is_kept FROM ({EXACT.format(scope=', source_id')})")
def dedupe_exact_by_source(spark, sf_dir):
    """The same within each source."""
    return dedupe.exact(table(spark, sf_dir, "chunk_records"), "chunk_id", "text", "source_id")


@query("dedupe_report", f"SELECT k AS kept_id, count(*) AS n_removed, min(id) AS first_removed, max(id) AS last_removed FROM ({EXACT.format(scope='')}) WHERE text IS NOT NULL AND id <> k GROUP BY k")
def dedupe_report(spark, sf_dir):
    """What each kept chunk stands for."""
    return dedupe.report(dedupe.exact(table(spark, sf_dir, "chunk_records"), "chunk_id", "text"))


@query("dedupe_jaccard")
def dedupe_jaccard(spark, sf_dir):
    """Greedy removal of documents with nearly the same tokens."""
    return dedupe.jaccard(table(spark, sf_dir, "documents"), "doc_id", "text", 0.95)


@query("dedupe_minhash")
def dedupe_minhash(spark, sf_dir):
    """Groups of documents that are similar in their runs of five words."""
    return dedupe.minhash(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("language_histogram")
def language_histogram(spark, sf_dir):
    """Documents by guessed language."""
    return table(spark, sf_dir, "documents").groupBy(enrich.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


TAG_RULES = {"year": r"(?<![A-Za-z0-9_])((?:19|20)\d\d)(?![A-Za-z0-9_])", "amount": r"(?<![A-Za-z0-9_])(\d{1,3},\d{3})(?![A-Za-z0-9_])"}
TAXONOMY = {"farm": ["barn", "tractor", "silo", "harvest"], "search": ["index", "embedding", "tokenizer", "query"], "town": ["library", "council", "parade", "bakery"], "game": ["goblin", "tavern", "dagger"]}
SECTIONS = [("calendar", r"(January|February|March|April|June|July|August|September|October|November|December) (?:19|20)\d\d"), ("rule", r"^The rule is simple"), ("numbers", r"\d{4,}")]


@query("tags_regex", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '\b((?:19|20)\d\d)\b', 1), lambda x: 'year:' || x), list_transform(regexp_extract_all(text, '\b(\d{1,3},\d{3})\b', 1), lambda x: 'amount:' || x)))), ' ') AS tags FROM documents WHERE text IS NOT NULL""")
def tags_regex(spark, sf_dir):
    """Years and amounts that documents name."""
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.array_join(enrich.regex_tags(F.col("text"), TAG_RULES), " ").alias("tags"))


@query("sections_first", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in SECTIONS) + " END AS section FROM documents")
def sections_first(spark, sf_dir):
    """The first section rule that matches."""
    return table(spark, sf_dir, "documents").select("doc_id", enrich.first_section(F.col("text"), SECTIONS).alias("section"))


@query("taxonomy_tags", "SELECT doc_id, concat_ws(' ', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + f" THEN '{n}' END" for n, terms in sorted(TAXONOMY.items())) + ") AS categories FROM documents")
def taxonomy_tags(spark, sf_dir):
    """Categories whose terms occur."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(enrich.taxonomy_tags(F.col("text"), TAXONOMY), " ").alias("categories"))


@query("local_embedding", """WITH r AS (SELECT doc_id, list_transform(range(1, 33), lambda i: CASE WHEN i <= length(text) THEN unicode(substring(text, i, 1)) / 255.0 ELSE 0.0 END::DOUBLE) AS e FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM r)
SELECT doc_id, round(CASE WHEN n = 0 THEN e[1] ELSE e[1] / n END, 6) AS e1, round(CASE WHEN n = 0 THEN e[32] ELSE e[32] / n END, 6) AS e32 FROM n""")
def local_embeddings(spark, sf_dir):
    """First and last number of the placeholder embedding in 32 dimensions."""
    e = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", local_embedding(F.col("text"), 32).alias("e"))
    return e.select("doc_id", F.round(F.get("e", F.lit(0)), 6).alias("e1"), F.round(F.get("e", F.lit(31)), 6).alias("e32"))


@query("l2_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def l2_normalized(spark, sf_dir):
    """Length of every vector and its first number at unit length."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"), F.round(F.get(l2_normalize(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query("metadata_filters", """SELECT count(*) FILTER (lang = 'en') AS eq, count(*) FILTER (lang <> 'en') AS neq, count(*) FILTER (n_chars > 1000) AS gt, count(*) FILTER (n_chars >= 1000) AS gte, count(*) FILTER (n_chars < 1000) AS lt,
count(*) FILTER (n_chars <= 1000) AS lte, count(*) FILTER (lang IN ('es', 'de')) AS isin, count(*) FILTER (contains(source, 'manual')) AS contains FROM documents""")
def metadata_filters(spark, sf_dir):
    """How many documents each filter operator leaves."""
    from textloom.operators.retrieval import predicate

    ops = {"eq": ("lang", "eq", "en"), "neq": ("lang", "neq", "en"), "gt": ("n_chars", "gt", 1000), "gte": ("n_chars", "gte", 1000), "lt": ("n_chars", "lt", 1000), "lte": ("n_chars", "lte", 1000), "isin": ("lang", "in", ["es", "de"]), "contains": ("source", "contains", "manual")}
    return table(spark, sf_dir, "documents").agg(*[F.count_if(predicate(*args)).alias(name) for name, args in ops.items()])
