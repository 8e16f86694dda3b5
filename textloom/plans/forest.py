"""Queries of problem 6 over document_chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators.hierarchy import descendant_counts, descendants, hierarchy
from textloom.plans.registry import Registry
from textloom.runtime import durable, table

registry = Registry()


def chunk_forest(spark, sf_dir, with_path=False):
    rows = table(spark, sf_dir, "document_chunks").select("chunk_id", "parent_id", "doc_id", "chunk_index", F.col("source.retrieved_at").alias("retrieved_at"))
    return hierarchy(rows, near=["doc_id", "chunk_index"], order=["retrieved_at"], with_path=with_path)


CURRENT = r"""cur AS (SELECT node, parent FROM (SELECT lower(trim(chunk_id, b)) AS node, CASE WHEN trim(parent_id, b) = '' THEN NULL ELSE lower(trim(parent_id, b)) END AS parent, source.retrieved_at AS t0
    FROM document_chunks, (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288) AS b)) WHERE node <> '' QUALIFY row_number() OVER (PARTITION BY node ORDER BY t0 DESC NULLS LAST, parent DESC NULLS LAST) = 1),
e AS (SELECT c.node, p.node AS parent FROM cur c LEFT JOIN cur p ON c.parent = p.node),
w AS (SELECT node, node AS top, parent AS nxt, 0 AS d, [node] AS seen, false AS again FROM e
  UNION ALL SELECT w.node, e.node, e.parent, w.d + 1, list_append(w.seen, e.node), list_contains(w.seen, e.node) FROM w JOIN e ON w.nxt = e.node WHERE NOT w.again),
f AS (SELECT node, CASE WHEN again THEN 'cycle' ELSE top END AS root, CASE WHEN NOT again THEN d WHEN top = node THEN -1 ELSE -2 END::BIGINT AS depth, CASE WHEN NOT again THEN array_to_string(list_reverse(seen), ' > ') END AS path, again FROM w WHERE again OR nxt IS NULL)"""


@registry.query("p6_found", f"WITH RECURSIVE {CURRENT} SELECT node AS chunk_id, root AS root_id, depth FROM f")
def p6_found(spark, sf_dir):
    """Per chunk its root and depth; 'cycle' with -1 on a loop and -2 leading into one."""
    f = chunk_forest(spark, sf_dir)
    return f.select(F.col("node").alias("chunk_id"), F.when(F.col("state") < 0, "cycle").otherwise(F.col("root")).alias("root_id"), "depth")


@registry.query("p6_paths", f"""WITH RECURSIVE {CURRENT}, a AS (SELECT node, unnest(string_split(path, ' > ')) AS up, depth FROM f WHERE path IS NOT NULL), n AS (SELECT up AS node, count(*) AS n FROM a WHERE up <> node GROUP BY up),
k AS (SELECT e.parent AS node, count(*) AS n FROM e JOIN f ON f.node = e.node WHERE NOT f.again AND e.parent IS NOT NULL GROUP BY e.parent)
SELECT f.node AS chunk_id, CASE WHEN NOT f.again THEN f.root END AS root, f.depth, f.path, coalesce(k.n, 0) AS n_children, coalesce(n.n, 0) AS n_descendants FROM f LEFT JOIN n USING (node) LEFT JOIN k USING (node)""")
def p6_paths(spark, sf_dir):
    """Per chunk its full path from the root, depth, and the number of children and of all descendants."""
    f = durable(chunk_forest(spark, sf_dir, with_path=True), "paths")
    return f.join(descendant_counts(f), "node").select(F.col("node").alias("chunk_id"), "root", "depth", "path", "n_children", "n_descendants")


@registry.query("p6_descendants", f"""WITH RECURSIVE {CURRENT}, s AS (SELECT node, depth, string_split(path, ' > ') AS ups FROM f WHERE path IS NOT NULL), u AS (SELECT node, depth, ups, unnest(range(depth)) AS level FROM s)
SELECT ups[level + 1] AS ancestor, node AS descendant, depth - level AS distance FROM u""")
def p6_descendants(spark, sf_dir):
    """Every pair of a chunk and one below it, with their distance."""
    return descendants(chunk_forest(spark, sf_dir, with_path=True))
