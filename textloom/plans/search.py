"""Queries of retrieval over chunk_records with the vectors of vector_records, and of diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import classify as rules
from textloom.operators import context, diagnostics, pipeline, retrieval
from textloom.plans.registry import Registry
from textloom.runtime import durable, table
from textloom.schema import ExpandConfig

registry = Registry()
query = registry.query

TEXT = "quiet inverter payroll barn 2024"
MODEL = "facet-64"


def query_vector(text: str, dim: int = 64) -> list[float]:
    """The placeholder embedding of a query, on the driver."""
    raw = [ord(c) / 255.0 for c in text[:dim]] + [0.0] * max(0, dim - len(text))
    n = sum(x * x for x in raw) ** 0.5
    return [x / n for x in raw] if n else raw


VECTOR = query_vector(TEXT)


_STORED: dict = {}


def rows(spark, sf_dir):
    """The stored collection of a folder's chunks and vectors: built by the first search of a session, and again once a table has changed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def stamp(name):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = p.getFileSystem(conf)
        files = fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))

    key = (spark.sparkContext.applicationId, str(sf_dir))
    now = stamp("chunk_records"), stamp("vector_records")
    stored = _STORED.get(key)
    if stored:  # it may have been cleared away
        at = jvm.org.apache.hadoop.fs.Path(stored[1]._textloom_path)
        stored = stored if at.getFileSystem(conf).exists(at) else None
    if not stored or stored[0] != now:
        _STORED[key] = now, durable(collected(spark, sf_dir), "collection")
    return _STORED[key][1]


def collected(spark, sf_dir):
    """(id, text, source_id, model, embedding): every chunk with its current usable vector of one model, if it has one."""
    chunks = table(spark, sf_dir, "chunk_records").where(F.col("chunk_id").isNotNull()).groupBy(F.col("chunk_id").alias("id")).agg(F.max("text").alias("text"), F.max("source_id").alias("source_id"))
    v = table(spark, sf_dir, "vector_records").where(F.col("chunk_id").isNotNull()).groupBy(F.col("chunk_id").alias("id")).agg(F.max(F.struct("created_at", "model", "embedding")).alias("r")).select("id", "r.model", "r.embedding")
    good = (F.col("model") == MODEL) & (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return chunks.join(v.where(good), "id", "left")


ROWS = f"""c AS (SELECT chunk_id AS id, max(text) AS text, max(source_id) AS source_id FROM chunk_records WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
l AS (SELECT chunk_id AS id, model, embedding FROM vector_records WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, model DESC NULLS LAST, embedding DESC NULLS LAST) = 1),
v AS (SELECT * FROM l WHERE model = '{MODEL}' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
r AS (SELECT c.*, v.model, v.embedding FROM c LEFT JOIN v USING (id)),
sem AS (SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[]), 9) AS score FROM r WHERE embedding IS NOT NULL),
"""


def _terms(longer: int) -> list[str]:
    return retrieval.terms_of(TEXT, longer)


_FREQ = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}.0" for t in _terms(2))
_RATIO = " + ".join(f"contains(lower(text), '{t}')::INT" for t in _terms(0))
ROWS += f"frq AS (SELECT id, round(CASE WHEN length(text) > 0 THEN ({_FREQ}) / sqrt(length(text)) ELSE 0 END, 9) AS score FROM r WHERE text IS NOT NULL),\nrat AS (SELECT id, round(({_RATIO}) / {len(_terms(0))}.0, 9) AS score FROM r WHERE text IS NOT NULL)"


def top(source: str, k: int, where: str = "true") -> str:
    return f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {source} WHERE {where} QUALIFY rank <= {k}"


def ranked(sql: str, k: int = 10) -> str:
    return f"WITH {ROWS} {top('(' + sql + ')', k)}"


def out(df):
    return df.select("id", "score", F.col("rank").cast("bigint").alias("rank"))


def rrf(one: str, two: str, a: float, b: float, digits: int = 9) -> str:
    return f"SELECT id, round(sum(p), {digits}) AS score FROM (SELECT id, {a} / (60 + rank)::DOUBLE AS p FROM ({one}) UNION ALL SELECT id, {b} / (60 + rank)::DOUBLE AS p FROM ({two})) GROUP BY id"


@query("semantic_topk", ranked("SELECT * FROM sem"))
def semantic_topk(spark, sf_dir):
    """Ten chunks by cosine to the query vector."""
    return out(retrieval.semantic(rows(spark, sf_dir), VECTOR))


@query("semantic_filtered", f"WITH {ROWS} {top('(SELECT sem.* FROM sem JOIN r USING (id) WHERE source_id IN (SELECT source_id FROM source_records WHERE type = ' + chr(39) + 'pdf' + chr(39) + '))', 10)}")
def semantic_filtered(spark, sf_dir):
    """The same among chunks of pdf sources, filtered before scoring."""
    pdf = table(spark, sf_dir, "source_records").where("type = 'pdf'").select("source_id").distinct()
    return out(retrieval.semantic(rows(spark, sf_dir).join(pdf, "source_id", "left_semi"), VECTOR))


@query("keyword_frequency_topk", f"WITH {ROWS} {top('frq', 10, 'score > 0')}")
def keyword_frequency(spark, sf_dir):
    """Ten chunks by term frequency over root length."""
    return out(retrieval.keyword(rows(spark, sf_dir), TEXT))


@query("keyword_ratio_topk", f"WITH {ROWS} {top('rat', 10, 'score > 0')}")
def keyword_ratio(spark, sf_dir):
    """Ten chunks by the share of terms they hold."""
    return out(retrieval.keyword(rows(spark, sf_dir), TEXT, scoring="ratio"))


@query("hybrid_rrf", ranked(rrf(top("sem", 30), top("frq", 30, "score > 0"), 0.7, 0.30000000000000004)))
def hybrid_rrf(spark, sf_dir):
    """Weighted rank fusion of cosine and frequency."""
    return out(retrieval.hybrid(rows(spark, sf_dir), TEXT, VECTOR))


@query("hybrid_weighted", f"WITH {ROWS}, s AS ({top('sem', 30)}), t AS ({top('frq', 30, 'score > 0')}), x AS (SELECT id, round(0.7 * coalesce(s.score, 0) + 0.3 * coalesce(t.score, 0), 9) AS score FROM s FULL JOIN t USING (id)) {top('x', 10)}")
def hybrid_weighted(spark, sf_dir):
    """Weighted sum of cosine and frequency."""
    return out(retrieval.hybrid(rows(spark, sf_dir), TEXT, VECTOR, fusion="weighted_sum"))


@query("project_hybrid", ranked("SELECT id, round(0.7 * sem.score + 0.3 * coalesce(rat.score, 0), 9) AS score FROM sem LEFT JOIN rat USING (id)"))
def project_hybrid(spark, sf_dir):
    """0.7 x cosine + 0.3 x share of terms over all vectors."""
    return out(retrieval.project_hybrid(rows(spark, sf_dir), TEXT, VECTOR))


@query("chat_fusion", ranked(rrf(top("rat", 20, "score > 0"), top("sem", 20), 0.3, 0.7, 4)))
def chat_fusion(spark, sf_dir):
    """Rank fusion for conversations, rounded before ranking."""
    return out(retrieval.chat_fusion(rows(spark, sf_dir), TEXT, VECTOR))


@query("mock_semantic", ranked("SELECT id, round(0.8 * score + 0.2 * (1 - 0.5 * (row_number() OVER (ORDER BY id) - 1) / (count(*) OVER ())), 9) AS score FROM rat"))
def mock_semantic(spark, sf_dir):
    """Stand-in for semantic search without vectors."""
    return out(retrieval.mock_semantic(rows(spark, sf_dir), TEXT))


@query("plain_fusion", ranked(rrf(top("rat", 20, "score > 0"), top("sem", 20), 1.0, 1.0)))
def plain_fusion(spark, sf_dir):
    """Rank fusion without weights."""
    return out(retrieval.plain_fusion(rows(spark, sf_dir), TEXT, VECTOR))


_ANCHORS = retrieval.anchor_terms(TEXT)
_BOOST = " + ".join(f"CASE WHEN contains(lower(text), '{a}.') OR contains(lower(text), '{a}:') OR contains(lower(text), '{a})') THEN 0.4 WHEN contains(lower(text), '{a}') THEN 0.15 ELSE 0 END" for a in _ANCHORS)
_W = min(0.7, 0.3 + 0.2 * len(_ANCHORS))


@query("hybrid_adaptive", f"WITH {ROWS}, w AS ({top('rat', 30, 'score > 0')}), s AS ({top('sem', 30)}), x AS (SELECT id, round({_W} * coalesce(w.score, 0) + {1 - _W} * coalesce((s.score + 1) / 2, 0) + coalesce({_BOOST}, 0), 9) AS score FROM w FULL JOIN s USING (id) LEFT JOIN r USING (id)) {top('x', 10)}")
def hybrid_adaptive(spark, sf_dir):
    """Hybrid whose weights follow the query, with a boost for its identifiers."""
    return out(retrieval.adaptive(rows(spark, sf_dir), TEXT, VECTOR))


@query("keyword_boosted", ranked(f"SELECT id, round(w.score + {_BOOST}, 9) AS score FROM ({top('rat', 30, 'score > 0')}) w JOIN r USING (id)"))
def keyword_boosted(spark, sf_dir):
    """Share of terms with a boost for identifiers."""
    return out(retrieval.boosted_keyword(rows(spark, sf_dir), TEXT))


@query("search_many", """
WITH d AS (SELECT doc_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS token FROM documents WHERE text IS NOT NULL),
q AS (SELECT source AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(source), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS ts FROM mix_targets),
s AS (SELECT query_id, id, round(count(*) / any_value(len(ts))::DOUBLE, 9) AS score FROM (SELECT query_id, ts, unnest(ts) AS token FROM q) JOIN d USING (token) GROUP BY query_id, id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def search_many(spark, sf_dir):
    """Ten documents for each of the sources' names as queries."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    names = table(spark, sf_dir, "mix_targets").select(F.col("source").alias("query_id"), F.col("source").alias("query"))
    r = retrieval.search_many(docs, names)
    return r.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("search_documents")
def search_documents(spark, sf_dir):
    """Ten documents for every document whose id is divisible by 100, among all documents; its title is the query, its text where the title is null or has no words."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("text").alias("text"), F.max("title").alias("title"))
    query = F.coalesce(F.when(F.col("title").rlike(r"[\p{L}\p{N}]"), F.col("title")), F.col("text"))
    r = retrieval.search_many(docs, docs.where("id % 100 = 0").select(F.col("id").alias("query_id"), query.alias("query")))
    return r.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("hits_with_sources", f"WITH {ROWS}, h AS ({top('rat', 10, 'score > 0')}), n AS (SELECT source_id, source_name, type, uri FROM source_records QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY source_name DESC NULLS LAST, type DESC NULLS LAST, uri DESC NULLS LAST) = 1) SELECT h.id, round(h.score, 4) AS score, h.rank, n.source_name, n.type, n.uri FROM h LEFT JOIN r USING (id) LEFT JOIN n USING (source_id)")
def hits_with_sources(spark, sf_dir):
    """Keyword hits with their sources."""
    r = rows(spark, sf_dir)
    hits = retrieval.keyword(r, TEXT, scoring="ratio")
    return retrieval.with_sources(hits, r, table(spark, sf_dir, "source_records")).select("id", "score", F.col("rank").cast("bigint").alias("rank"), "source_name", "type", "uri")


@query("context_assembly", f"WITH {ROWS} SELECT string_agg('[' || h.rank || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY h.rank) AS context FROM ({top('rat', 10, 'score > 0')}) h JOIN r USING (id)")
def context_assembly(spark, sf_dir):
    """The hits' texts, numbered, as one context."""
    r = rows(spark, sf_dir)
    return retrieval.assemble_context(retrieval.keyword(r, TEXT, scoring="ratio"), r, numbered=True)


@query("chunk_lookup", f"WITH {ROWS} SELECT r.id, r.text FROM r JOIN ({top('rat', 10, 'score > 0')}) h USING (id)")
def chunk_lookup(spark, sf_dir):
    """Chunks by their ids."""
    r = rows(spark, sf_dir)
    return r.join(retrieval.keyword(r, TEXT, scoring="ratio").select("id"), "id").select("id", "text")


@query("debug_results", f"WITH {ROWS} SELECT h.rank, h.id, greatest(least(h.score, 1.0), 0.0) AS score, substring(r.text, 1, 200) AS preview FROM ({top('sem', 10)}) h JOIN r USING (id)")
def debug_results(spark, sf_dir):
    """Results of an explained query: clamped scores and previews."""
    d = pipeline.debug_query(rows(spark, sf_dir), VECTOR)["results"]
    return d.select(F.col("rank").cast("bigint").alias("rank"), "id", "score", "preview")


@query("index_stats", f"WITH {ROWS} SELECT count(*) AS rows, count(text) AS with_text, count(embedding) AS with_vector, count(DISTINCT source_id) AS sources, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM r")
def index_stats(spark, sf_dir):
    """What the collection holds."""
    return pipeline.index_stats(rows(spark, sf_dir))


@query("document_chunks_in_order", "SELECT doc_id, chunk_id, chunk_index, place FROM (SELECT doc_id, chunk_id, chunk_index::BIGINT AS chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index NULLS FIRST, chunk_id) - 1 AS place FROM (SELECT chunk_id, doc_id, chunk_index FROM document_chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY source.retrieved_at DESC NULLS LAST, doc_id DESC NULLS LAST, chunk_index DESC NULLS LAST) = 1))")
def document_chunks_in_order(spark, sf_dir):
    """The chunks of every document in order."""
    from textloom.operators.ranking import ranked_by_ranges

    c = context.latest_chunks(table(spark, sf_dir, "document_chunks")).select("doc_id", "chunk_id", F.col("chunk_index").cast("bigint").alias("chunk_index"))
    return ranked_by_ranges(c, ["doc_id"], ["chunk_index", "chunk_id"], "place")


CHUNKS = """dc AS (SELECT chunk_id, doc_id, chunk_index, parent_id, hierarchy_level AS level, content.text AS text FROM document_chunks WHERE chunk_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY source.retrieved_at DESC NULLS LAST, doc_id DESC NULLS LAST, chunk_index DESC NULLS LAST, parent_id DESC NULLS LAST, hierarchy_level DESC NULLS LAST, content.text DESC NULLS LAST) = 1),
hit AS (SELECT chunk_id AS id FROM dc WHERE text IS NOT NULL AND contains(lower(text), 'ledger') ORDER BY length(text) DESC, chunk_id LIMIT 10),
pl AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index NULLS FIRST, chunk_id) AS place FROM dc),
nb AS (SELECT h.id AS hit_id, b.chunk_id, b.place - a.place AS distance FROM hit h JOIN pl a ON a.chunk_id = h.id JOIN pl b ON a.doc_id = b.doc_id AND b.place <> a.place AND abs(b.place - a.place) <= 2)"""


def _hits(chunks):
    return chunks.where(F.contains(F.lower("text"), F.lit("ledger"))).orderBy(F.desc(F.length("text")), "chunk_id").limit(10).select(F.col("chunk_id").alias("id"))


@query("neighbours", f"WITH {CHUNKS} SELECT hit_id, chunk_id, distance FROM nb")
def neighbours(spark, sf_dir):
    """Chunks up to two places around ten hits."""
    c = context.latest_chunks(table(spark, sf_dir, "document_chunks"))
    n = context.neighbours(c, _hits(c), 2, 2)
    return n.select("hit_id", "chunk_id", F.col("distance").cast("bigint").alias("distance"))


@query("hydrate_capped", f"""WITH {CHUNKS}, pa AS (SELECT a.chunk_id AS hit_id, b.chunk_id FROM dc a JOIN hit ON a.chunk_id = hit.id JOIN dc b ON lower(trim(a.parent_id)) = lower(trim(b.chunk_id))),
si AS (SELECT nb.*, CASE WHEN distance < 0 THEN 'before' ELSE 'after' END AS role, 4 - (nb.hit_id IN (SELECT hit_id FROM pa))::INT AS room FROM nb WHERE nb.chunk_id NOT IN (SELECT id FROM hit)),
nu AS (SELECT *, row_number() OVER (PARTITION BY hit_id, role ORDER BY abs(distance)) AS nth FROM si)
SELECT hit_id, chunk_id, 'parent' AS role, 0::BIGINT AS distance FROM pa UNION ALL SELECT hit_id, chunk_id, role, distance FROM nu WHERE nth <= CASE WHEN role = 'before' THEN room // 2 ELSE room - room // 2 END""")
def hydrate_capped(spark, sf_dir):
    """Parent and nearest neighbours of ten hits, at most four."""
    c = context.latest_chunks(table(spark, sf_dir, "document_chunks"))
    h = context.hydrate(c, _hits(c), ExpandConfig(before=2, after=2, parent=True, max_total=4))
    return h.select("hit_id", "chunk_id", "role", F.col("distance").cast("bigint").alias("distance"))


@query("parent_chains", f"""WITH RECURSIVE {CHUNKS}, up AS (SELECT lower(trim(chunk_id)) AS node, chunk_id, lower(trim(parent_id)) AS parent FROM dc),
ch AS (SELECT up.chunk_id AS hit_id, up.chunk_id, up.parent, [up.node] AS seen, 0 AS distance FROM up JOIN hit ON up.chunk_id = hit.id
  UNION ALL SELECT ch.hit_id, up.chunk_id, up.parent, list_append(ch.seen, up.node), ch.distance + 1 FROM ch JOIN up ON ch.parent = up.node WHERE NOT list_contains(ch.seen, up.node))
SELECT hit_id, chunk_id, distance::BIGINT AS distance FROM ch WHERE distance > 0""")
def parent_chains(spark, sf_dir):
    """Ancestors of ten hits, nearest first."""
    c = context.latest_chunks(table(spark, sf_dir, "document_chunks"))
    p = context.parent_chains(c, _hits(c))
    return p.select("hit_id", "chunk_id", F.col("distance").cast("bigint").alias("distance"))


_EXPECT = "SELECT DISTINCT id FROM r WHERE contains(lower(text), 'payroll') AND contains(lower(text), 'inverter')"


@query("retrieval_compare", f"""WITH {ROWS}, h AS ({top('frq', 10, 'score > 0')}), e AS ({_EXPECT}), j AS (SELECT h.rank, e.id AS w FROM h FULL JOIN e USING (id)),
n AS (SELECT count(rank) AS n_hits, count(w) AS n_expected, count(*) FILTER (rank IS NOT NULL AND w IS NOT NULL) AS n_found, count(*) FILTER (rank <= 5 AND w IS NULL) AS unexpected FROM j)
SELECT n_expected, n_found, n_expected - n_found AS missing, unexpected, CASE WHEN n_hits > 0 THEN round(n_found / n_hits, 6) ELSE 0 END AS precision, CASE WHEN n_expected > 0 THEN round(n_found / n_expected, 6) ELSE 1 END AS recall FROM n""")
def retrieval_compare(spark, sf_dir):
    """Frequency hits against the chunks that hold both words."""
    r = rows(spark, sf_dir)
    want = r.where(F.contains(F.lower("text"), F.lit("payroll")) & F.contains(F.lower("text"), F.lit("inverter"))).select("id")
    return diagnostics.compare(retrieval.keyword(r, TEXT), want)


@query("score_diagnosis", f"""WITH {ROWS}, h AS ({top('sem', 50)}), s AS (SELECT count(*) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(var_pop(score), 6) AS variance, round(list_sort(list(score))[count(*) // 2 + 1], 6) AS upper_median FROM h)
SELECT *, CASE WHEN n = 0 THEN 'no results' WHEN max < 0.5 THEN 'low scores' ELSE 'ok' END AS finding, CASE WHEN n = 0 THEN 'check that the collection is filled and the filters match' WHEN max < 0.5 THEN 'rephrase the query or use hybrid search' WHEN max - min > 0.5 THEN 'scores spread widely: consider a smaller top_k' ELSE '' END AS advice FROM s""")
def score_diagnosis(spark, sf_dir):
    """Statistics of the fifty best cosines, and what they suggest."""
    return diagnostics.diagnose(diagnostics.score_statistics(retrieval.semantic(rows(spark, sf_dir), VECTOR, 50)))


@query("quality_by_source_type", f"""WITH {ROWS}, t AS (SELECT source_id, max(type) AS type FROM source_records GROUP BY source_id), x AS (SELECT t.type, (sem.score + 1) / 2 AS score FROM sem JOIN r USING (id) JOIN t USING (source_id)),
g AS (SELECT type, count(score) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS avg, round(var_pop(score), 6) AS variance FROM x GROUP BY type)
SELECT *, CASE WHEN n = 0 THEN 'poor' WHEN avg >= 0.8 AND min >= 0.6 THEN 'excellent' WHEN avg >= 0.65 AND min >= 0.5 THEN 'good' WHEN avg >= 0.52 THEN 'marginal' ELSE 'poor' END AS quality, CASE WHEN variance > 0.1 THEN 'uneven scores' ELSE '' END AS note FROM g""")
def quality_by_source_type(spark, sf_dir):
    """Quality of scores per type of source."""
    from textloom.functions.vectors import cosine

    kinds = table(spark, sf_dir, "source_records").groupBy("source_id").agg(F.max("type").alias("type"))
    scored = rows(spark, sf_dir).where(F.col("embedding").isNotNull()).join(kinds, "source_id").select("type", ((F.round(cosine(F.col("embedding"), retrieval.vector(VECTOR)), 9) + 1) / 2).alias("score"))
    return diagnostics.assess(scored, ["type"])


def _re2(pattern: str) -> str:
    """The same pattern for an engine without look-around."""
    for boundary in (rules._B, rules._E, "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"):
        pattern = pattern.replace(boundary, r"\b")
    return pattern.replace(r"(?<!\d)", r"(?:^|[^0-9])").replace(r"(?!\d)", r"(?:[^0-9]|$)").replace("'", "''")


def _classify_sql() -> str:
    m = lambda p, c="low": f"regexp_matches({c}, '{_re2(p)}')"
    fam = {n: "(" + " OR ".join(m(p) for p in ps) + ")" for n, ps in rules.FAMILIES.items()}
    kind = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in fam.items()) + r" WHEN length(low) < 10 AND NOT regexp_matches(low, '\p{L}{3}') THEN 'conversational' ELSE 'factual' END"
    sub = "CASE " + " ".join(f"WHEN kind = '{n}' THEN CASE " + " ".join(f"WHEN {m(p)} THEN '{s}'" for s, p in rs) + " END" for n, rs in rules.SUBTYPES.items()) + " END"
    comp = f"CASE WHEN {m(rules.COMPLEX)} THEN 'complex' WHEN {m(rules.MEDIUM)} OR len(list_filter(regexp_split_to_array(low, '\\s+'), lambda x: x <> '')) > 20 THEN 'medium' ELSE 'simple' END"
    code = f"({m(rules.CODE)} OR regexp_matches(q, '[a-z][A-Z][a-z]'))"
    needs = f"CASE WHEN kind = 'conversational' OR {m(rules.ARITHMETIC)} OR {m(rules.GENERAL)} THEN false WHEN {m(rules.DOCUMENT)} OR kind IN ('navigational', 'conceptual', 'procedural') OR complexity <> 'simple' OR code OR {m(rules.ACRONYM, 'q')} THEN true ELSE false END"
    hits = " + ".join(f"{c}::INT" for c in fam.values())
    return f"""WITH a AS (SELECT doc_id, coalesce(title, '') AS q, trim(lower(coalesce(title, ''))) AS low FROM documents), b AS (SELECT *, {kind} AS kind, {comp} AS complexity, {code} AS code, {hits} AS hits FROM a), c AS (SELECT *, {needs} AS needs FROM b)
SELECT doc_id, needs AS needs_retrieval, round(least(1.0, 0.7 + CASE WHEN hits > 1 THEN 0.15 WHEN hits = 1 THEN 0.1 ELSE 0 END), 2)::DOUBLE AS confidence, kind AS type, {sub} AS subtype, complexity,
CASE WHEN needs THEN CASE complexity WHEN 'simple' THEN 3 WHEN 'medium' THEN 7 ELSE 15 END END::BIGINT AS top_k, CASE WHEN needs THEN CASE WHEN code THEN 'keyword' WHEN kind = 'conceptual' THEN 'semantic' ELSE 'hybrid' END END AS mode FROM c"""


@query("classify_queries", _classify_sql())
def classify_queries(spark, sf_dir):
    """The titles of all documents classified as queries."""
    d = table(spark, sf_dir, "documents").select("doc_id", rules.classify(F.col("title")).alias("c"))
    return d.select("doc_id", "c.needs_retrieval", "c.confidence", "c.type", "c.subtype", "c.complexity", F.col("c.top_k").cast("bigint").alias("top_k"), "c.mode")
