"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.runtime import durable, release


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round over directed edges (u, v): each neighbour of u is tied to the least node around u.

    Large-star looks at all neighbours and moves the larger ones; small-star looks at the smaller
    neighbours and moves all of them and u itself. Only one minimum per node is aggregated, which
    combines before the shuffle, so a node with very many neighbours is no hot group.
    """
    if small:
        d = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        d = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = d.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = d.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v of one sortable type).

    ``component`` is the least node of the component. Rows with a null end are ignored, self-loops
    yield their node, repeated edges count once; an empty input gives an empty result. Every round is
    written to the shared folder, so the lineage stays short and a lost executor costs one round.
    """
    clean = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v")
    nodes = clean.select(F.col("u").alias("node")).union(clean.select("v")).distinct()
    now = durable(clean.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        old, now = now, durable(_star(_star(now, small=False), small=True), "cc")
        release(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    root = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
