"""The queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.llm.boilerplate import main_content, page_lines
from textloom.llm.knn import nearest, similar_pairs
from textloom.llm.mixing import mix, mix_report
from textloom.llm.near_dup import group_pairs, near_duplicates
from textloom.llm.packing import fill_report, pack
from textloom.llm.residue import found as residue_found, judged, real_content
from textloom.llm.shared_spans import removal_clusters, shared_shares, shared_spans
from textloom.llm.splitting import split_blocks, split_oversized
from textloom.plans.registry import Registry
from textloom.runtime import durable, table

registry = Registry()


@registry.query("p1_found")
def p1_found(spark, sf_dir):
    """Lines of chunks of web pages that don't belong to the article."""
    return page_lines(table(spark, sf_dir, "chunk_records"), table(spark, sf_dir, "source_records")).where("boilerplate").select("chunk_id", "line_no")


@registry.query("p1_content")
def p1_content(spark, sf_dir):
    """The article's own lines of every chunk of a web page."""
    return main_content(table(spark, sf_dir, "chunk_records"), table(spark, sf_dir, "source_records"))


@registry.query("p2_found")
def p2_found(spark, sf_dir):
    """The block starts at which oversized chunks may be cut."""
    return split_blocks(table(spark, sf_dir, "chunk_records")).withColumnRenamed("id", "chunk_id")


@registry.query("p2_pieces")
def p2_pieces(spark, sf_dir):
    """Oversized chunks as pieces of at most 1,500 characters that repeat 150 of the piece before."""
    return split_oversized(table(spark, sf_dir, "chunk_records")).withColumnRenamed("id", "chunk_id")


@registry.query("p3_found")
def p3_found(spark, sf_dir):
    """Pairs among each other's 10 most similar with a cosine of at least 0.8."""
    return similar_pairs(nearest(table(spark, sf_dir, "vector_records"), k=10, least=0.8), 0.8)


@registry.query("p3_neighbours")
def p3_neighbours(spark, sf_dir):
    """The 10 most similar vectors of every vector."""
    return nearest(table(spark, sf_dir, "vector_records"), k=10)


@registry.query("p4_found")
def p4_found(spark, sf_dir):
    """Records whose text is residue of a template, filler, an error or a demand for scripts."""
    return residue_found(table(spark, sf_dir, "extract_results"))


@registry.query("p4_content")
def p4_content(spark, sf_dir):
    """The records with real content, one row per extract_id, the latest fetched."""
    rows = table(spark, sf_dir, "extract_results")
    latest = rows.where(F.col("extract_id").isNotNull()).groupBy("extract_id").agg(F.max(F.struct("fetched_at", *[c for c in rows.columns if c not in ("fetched_at", "extract_id")])).alias("r")).select("extract_id", "r.*")
    return real_content(latest).select("extract_id", "source_id", "extractor_used", "fetched_at", F.length("text").cast("bigint").alias("n_chars"))


@registry.query("p4_extractors")
def p4_extractors(spark, sf_dir):
    """How many records of each extractor are residue, by kind; the names are normalised."""
    rows = table(spark, sf_dir, "extract_results").where(F.col("extract_id").isNotNull())
    j = judged(rows.groupBy("extract_id").agg(F.max(F.struct("fetched_at", "extractor_used", "text")).alias("r")).select("extract_id", "r.extractor_used", "r.text"))
    return j.groupBy(F.lower(F.coalesce("extractor_used", F.lit("unknown"))).alias("extractor"), F.when(F.col("residue_kind") == "", "content").otherwise(F.col("residue_kind")).alias("kind")).agg(F.count("*").alias("n"))


P5 = r"""
WITH RECURSIVE t AS (SELECT chunk_id AS id, any_value(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM chunk_records WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 3),
k AS (SELECT min(id) AS id, g FROM (SELECT id, list_sort(g) AS g FROM s) GROUP BY g), x AS (SELECT id, len(g) AS n, unnest(g) AS token FROM k),
b AS (SELECT a.id AS u, c.id AS v, count(*) AS shared, any_value(a.n) AS nu, any_value(c.n) AS nv FROM x a JOIN x c ON a.token = c.token AND a.id < c.id GROUP BY a.id, c.id),
l AS (SELECT u, v FROM b WHERE shared >= 0.6 * (nu + nv - shared) - 1e-9 UNION ALL SELECT v, u FROM b WHERE shared >= 0.6 * (nu + nv - shared) - 1e-9),
c AS (SELECT id AS node, id AS seen FROM k UNION SELECT c.node, l.v FROM c JOIN l ON c.seen = l.u),
m AS (SELECT node, min(seen) AS grp FROM c GROUP BY node), z AS (SELECT s.id, m.grp FROM s JOIN k ON list_sort(s.g) = k.g JOIN m ON m.node = k.id)
SELECT a.id AS chunk_id_a, b.id AS chunk_id_b FROM z a JOIN z b ON a.grp = b.grp AND a.id < b.id"""


@registry.query("p5_found", P5)
def p5_found(spark, sf_dir):
    """Pairs of chunks in one group of near-duplicates."""
    return group_pairs(durable(near_duplicates(table(spark, sf_dir, "chunk_records")), "nd-groups"))


P5_GROUPS = P5[: P5.rindex("SELECT a.id")].replace("SELECT s.id, m.grp FROM", "SELECT s.id, m.grp, k.id AS class FROM") + "SELECT id AS chunk_id, grp AS group_id, class AS class_id FROM z"


@registry.query("p5_groups", P5_GROUPS)
def p5_groups(spark, sf_dir):
    """Per chunk its group of near-duplicates and its class of equal texts, each named by its least id."""
    return near_duplicates(table(spark, sf_dir, "chunk_records")).withColumnRenamed("id", "chunk_id")


@registry.query("p7_containers")
def p7_containers(spark, sf_dir):
    """Every text's container of 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


@registry.query("p7_fill")
def p7_fill(spark, sf_dir):
    """How full the containers are."""
    return fill_report(pack(table(spark, sf_dir, "documents")))


@registry.query("p8_mix")
def p8_mix(spark, sf_dir):
    """The documents of the mix with the number of times each is used."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), redistribute=True)


@registry.query("p8_shares")
def p8_shares(spark, sf_dir):
    """Target and actual share of every source of the mix."""
    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(durable(mix(table(spark, sf_dir, "documents"), targets, redistribute=True), "mix"), targets)


P9 = """
WITH p AS (SELECT doc_id, i, hash(substring(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
g AS (SELECT h FROM p GROUP BY h HAVING min(doc_id) <> max(doc_id)), q AS (SELECT doc_id, i FROM p JOIN g USING (h)),
o AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS cut FROM q), n AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM n GROUP BY doc_id, k"""


@registry.query("p9_found", P9)
def p9_found(spark, sf_dir):
    """Stretches of at least 200 characters that other documents hold too."""
    return shared_spans(table(spark, sf_dir, "documents"))


P9_SHARES = f"""SELECT d.doc_id, d.n_chars, coalesce(s.n, 0) AS n_spans, coalesce(s.chars, 0)::BIGINT AS shared_chars, CASE WHEN d.n_chars > 0 THEN round(coalesce(s.chars, 0) / d.n_chars, 6) ELSE 0 END AS shared_share
FROM (SELECT doc_id, max(length(text)) AS n_chars FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id) d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(span_end - span_start) AS chars FROM ({P9}) GROUP BY doc_id) s USING (doc_id)"""


@registry.query("p9_shares", P9_SHARES)
def p9_shares(spark, sf_dir):
    """Per document how much of it is shared elsewhere."""
    return shared_shares(table(spark, sf_dir, "documents"))


@registry.query("p9_clusters")
def p9_clusters(spark, sf_dir):
    """Documents that share spans or similar paragraphs, by component."""
    return removal_clusters(table(spark, sf_dir, "documents"))
