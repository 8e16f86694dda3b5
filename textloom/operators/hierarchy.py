"""Parent-child links to full hierarchies: path, depth, root and descendants, with cycles detected.

Partition-local parent chains are contracted to fragment exits, the smaller quotient forest of the
exits is solved recursively in the same way, and the fragments' results are then expanded.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.runtime import durable

SEPARATOR = " > "
BLANKS = " \t\r\n\x0b\x0c\xa0\u3000"
#: States of a node: resolved below a root, on a loop, leads into a loop.
ROOT, ON_LOOP, INTO_LOOP = 0, -1, -2


def _no_path():
    return F.lit(None).cast("array<string>")


def _chase(nodes, parents, weights, labels):
    """Follow the parents inside one fragment.

    Gives, per node, (end, hops, state, label, walked): ``end`` is the root (state 0), the first
    ancestor outside the fragment (state 1), or None for nodes at a local loop (-1, -2). ``label``
    lists the labels of the path from below the end down to the node; None where there are none.
    """
    at = {n: k for k, n in enumerate(nodes)}
    size = len(nodes)
    end, hops, state, text = [None] * size, [0] * size, [None] * size, [None] * size
    for k in range(size):
        trail = []
        seen = {}
        j = k
        while state[j] is None and j not in seen:
            seen[j] = len(trail)
            trail.append(j)
            up = parents[j]
            if up is None:
                end[j], hops[j], state[j], text[j] = nodes[j], 0, ROOT, labels and labels[j]
                trail.pop()
                break
            nxt = at.get(up)
            if nxt is None:
                end[j], hops[j], state[j], text[j] = up, weights[j], 1, labels and labels[j]
                trail.pop()
                break
            j = nxt
        else:
            if state[j] is None:  # a loop within the fragment: from where the trail met itself
                for i in trail[seen[j] :]:
                    state[i] = ON_LOOP
                trail = trail[: seen[j]]
        for i in reversed(trail):
            up = at[parents[i]]
            if state[up] < 0:
                state[i] = INTO_LOOP
            else:
                end[i], hops[i], state[i] = end[up], hops[up] + weights[i], state[up]
                text[i] = labels and text[up] + labels[i]
    return end, hops, state, text


def _contract(with_path: bool):
    def run(rows: pa.Table) -> pa.Table:
        nodes, parents = rows["node"].to_pylist(), rows["parent"].to_pylist()
        end, hops, state, text = _chase(nodes, parents, rows["weight"].to_pylist(), [x or [] for x in rows["label"].to_pylist()] if with_path else None)
        kind = rows.schema.field("node").type
        return pa.table({"part": rows["part"], "node": rows["node"], "parent": rows["parent"], "end": pa.array(end, kind), "hops": pa.array(hops, pa.int64()), "state": pa.array(state, pa.int32()), "label": pa.array(text, pa.list_(pa.string()))})

    return run


def _on_the_way(rows: pa.Table) -> pa.Table:
    """Of one fragment, the nodes between a node known to be on a loop (``hit``) and the fragment's exit."""
    up = dict(zip(rows["node"].to_pylist(), rows["parent"].to_pylist()))
    out = set()
    for n, hit in zip(up, rows["hit"].to_pylist()):
        while hit and n in up and n not in out:
            out.add(n)
            n = up[n]
    return pa.table({"node": pa.array(sorted(out), rows.schema.field("node").type)})


def _solve(edges: DataFrame, kind: str, level: int, with_path: bool, shrink: int) -> DataFrame:
    """(node, root, depth, state, path) for edges (part, node, parent, weight, label); every parent is a node or null."""
    fragments = durable(
        edges.groupBy("part").applyInArrow(_contract(with_path), f"part bigint, node {kind}, parent {kind}, end {kind}, hops bigint, state int, label array<string>"),
        f"forest-{level}",
    )
    done = fragments.where("state != 1").select("node", F.col("end").alias("root"), F.when(F.col("state") == 0, F.col("hops")).otherwise(F.col("state").cast("bigint")).alias("depth"), "state", F.col("label").alias("path"))
    open_ = fragments.where("state = 1")
    exits = open_.select(F.col("end").alias("node")).distinct()
    entries = fragments.join(exits, "node")
    if open_.isEmpty():
        return done
    quotient = entries.select(
        F.floor(F.col("part") / shrink).cast("bigint").alias("part"), "node", F.when(F.col("state") == 1, F.col("end")).alias("parent"),
        F.when(F.col("state") == 1, F.col("hops")).otherwise(F.lit(0)).cast("bigint").alias("weight"), F.when(F.col("state") == 1, F.col("label")).alias("label"), F.col("state").alias("own"), F.col("hops").alias("own_hops"), F.col("end").alias("own_end"), F.col("label").alias("own_label"),
    )
    known = durable(quotient, f"quotient-{level}")
    solved = _solve(known.select("part", "node", "parent", "weight", "label"), kind, level + 1, with_path, shrink)
    # an entry that ends within its own fragment is a root of the quotient only; put its own result below
    own = known.where("own != 1").select(F.col("node").alias("root"), "own", "own_hops", "own_end", "own_label")
    tops = solved.join(own, "root", "left").select(
        "node",
        F.when(F.col("state") < 0, F.lit(None)).when(F.col("own") < 0, F.lit(None)).otherwise(F.col("own_end")).alias("root"),
        F.when(F.col("state") < 0, F.col("state")).when(F.col("own") < 0, F.when(F.col("node") == F.col("root"), F.col("own")).otherwise(INTO_LOOP)).otherwise(ROOT).alias("state"),
        (F.col("depth") + F.col("own_hops")).alias("depth"),
        (F.when(F.col("node") == F.col("root"), F.col("own_label")).otherwise(F.concat("own_label", "path")) if with_path else _no_path()).alias("path"),
    )
    tops = durable(tops, f"tops-{level}")
    expanded = open_.join(tops.select(F.col("node").alias("end"), "root", F.col("depth").alias("above"), F.col("state").alias("top"), F.col("path").alias("head")), "end").select(
        "part", "node", "parent", "root", F.when(F.col("top") == 0, F.col("above") + F.col("hops")).otherwise(F.lit(INTO_LOOP)).cast("bigint").alias("depth"),
        F.when(F.col("top") == 0, F.lit(ROOT)).otherwise(INTO_LOOP).alias("state"), F.when(F.col("top") == 0, F.concat("head", "label") if with_path else _no_path()).alias("path"),
    )
    expanded = durable(expanded, f"expanded-{level}")
    # loops that pass through several fragments: mark the way from every entry on a loop to its exit
    loops = tops.where(F.col("state") == ON_LOOP).select(F.col("node").alias("hit_node"))
    if not loops.isEmpty():
        inside = expanded.where("state < 0").join(loops, F.col("node") == F.col("hit_node"), "left").select("part", "node", "parent", F.col("hit_node").isNotNull().alias("hit"))
        way = inside.groupBy("part").applyInArrow(_on_the_way, f"node {kind}").withColumn("way", F.lit(True))
        expanded = expanded.join(way, "node", "left").withColumn("state", F.when(F.col("way"), ON_LOOP).otherwise(F.col("state"))).withColumn("depth", F.when(F.col("state") < 0, F.col("state").cast("bigint")).otherwise(F.col("depth")))
    return done.unionByName(expanded.select("node", "root", "depth", "state", "path"))


def hierarchy(df: DataFrame, id_col: str = "chunk_id", parent_col: str = "parent_id", near: list[str] | None = None, order: list[str] | None = None, with_path: bool = False, rows_per_fragment: int = 20_000, least_fragments: int = 4, shrink: int = 8) -> DataFrame:
    """(node, parent, root, depth, state[, path, steps]): one row per node.

    ``depth`` counts from the root (0); nodes on a loop have no root, depth and state -1, nodes that
    lead into one -2, all others state 0. ``steps`` (with ``with_path``) is the array of the nodes from
    the root down to the node itself, ``path`` the same joined by " > "; both are null at loops and
    grow with the depth.

    Ids compare without letter case and surrounding blanks and come out in lower case. Rows whose id is
    null or blank are left out. Of several rows of one id the one with the greatest ``order`` columns
    (nulls least, then the greatest parent) holds. A parent that is null, blank or no node makes a
    root; a node that is its own parent is a loop. Other columns are ignored; an empty table gives an
    empty result.

    Rows are range-partitioned by the ``near`` columns, which should keep relatives together and are
    best unique together (a document and the place in it), into fragments of about
    ``rows_per_fragment`` rows, at least ``least_fragments`` at any size; a key that holds a third of all rows is spread over many fragments.
    Every level of the quotient merges ``shrink`` neighbouring fragments, so there are few levels.
    """
    clean = lambda c: F.lower(F.btrim(F.col(c).cast("string"), F.lit(BLANKS)))
    near, order = near or [], order or []
    extra = [F.col(c).alias(f"near_{k}") for k, c in enumerate(near)]
    latest = F.struct(*[F.col(c) for c in order], clean(parent_col).alias("parent"), *extra)
    current = durable(df.select(clean(id_col).alias("node"), latest.alias("r")).where("node != ''").groupBy("node").agg(F.max("r").alias("r")).select("node", F.nullif("r.parent", F.lit("")).alias("parent"), *[f"r.near_{k}" for k in range(len(near))]), "forest-rows")
    parts = max(least_fragments, -(-current.count() // rows_per_fragment))
    known = current.select(F.col("node").alias("parent"), F.lit(True).alias("exists"))
    linked = current.join(known, "parent", "left").withColumn("parent", F.when(F.col("exists"), F.col("parent"))).drop("exists")
    keys = [F.col(f"near_{k}") for k in range(len(near))] + [F.col("node")]
    spread = linked.repartitionByRange(parts, *keys) if parts > 1 else linked
    part = F.spark_partition_id().cast("bigint") if parts > 1 else F.lit(0).cast("bigint")
    edges = durable(spread.select(part.alias("part"), "node", "parent", F.lit(1).cast("bigint").alias("weight"), (F.array("node") if with_path else _no_path()).alias("label")), "forest-edges")
    solved = _solve(edges, "string", 0, with_path, shrink)
    out = solved.join(edges.select("node", "parent"), "node").select("node", "parent", "root", "depth", "state", F.array_join("path", SEPARATOR).alias("path"), F.col("path").alias("steps"))
    return out if with_path else out.drop("path", "steps")


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair of a node and one below it, from hierarchy(..., with_path=True).

    Nodes at loops have no path and give no row. The result has as many rows as the depths add up to.
    """
    return paths.where(F.col("steps").isNotNull()).select(F.col("node").alias("descendant"), "depth", F.posexplode("steps").alias("level", "ancestor")).where("level < depth").select("ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))


def _sizes(rows: pa.Table) -> pa.Table:
    """Of one fragment, per node how much weight lies below it (``below``) and, per exit it hangs from, what it hands up (``up``)."""
    nodes, parents = rows["node"].to_pylist(), rows["parent"].to_pylist()
    at = {n: k for k, n in enumerate(nodes)}
    up = [at.get(p, -1) for p in parents]
    waiting = [0] * len(nodes)
    for u in up:
        if u >= 0:
            waiting[u] += 1
    total = [w + e for w, e in zip(rows["weight"].to_pylist(), rows["extra"].to_pylist())]
    own = list(total)
    leaves = [k for k, w in enumerate(waiting) if not w]
    while leaves:  # nodes whose children are all done
        k = leaves.pop()
        u = up[k]
        if u >= 0:
            total[u] += total[k]
            waiting[u] -= 1
            if not waiting[u]:
                leaves.append(u)
    kind = rows.schema.field("node").type
    hands = [p if u < 0 else None for p, u in zip(parents, up)]
    return pa.table({"part": rows["part"], "node": rows["node"], "parent": rows["parent"], "below": pa.array([t - o for t, o in zip(total, own)], pa.int64()), "total": pa.array(total, pa.int64()), "exit": pa.array(hands, kind)})


def _accumulate(edges: DataFrame, level: int, shrink: int) -> DataFrame:
    """(node, total) for a forest of edges (part, node, parent, weight): the weights of every node and all below it.

    Every fragment adds up its own part of the trees; what hangs from a node of another fragment is
    handed to that node, and the sums over the nodes that are handed something, the quotient, are
    solved in the same way. A second pass over the fragments then takes them in.
    """
    shape = "part bigint, node string, parent string, below bigint, total bigint, exit string"
    local = durable(edges.withColumn("extra", F.lit(0).cast("bigint")).groupBy("part").applyInArrow(_sizes, shape), f"sizes-{level}")
    handed = local.where("exit is not null").groupBy(F.col("exit").alias("node")).agg(F.sum("total").alias("handed"))
    if handed.isEmpty():
        return local.select("node", "total")
    tops = durable(handed, f"handed-{level}")
    # which node handed to, if any, a node's own fragment leads to next: the chase of the fragments gives it
    ends = durable(edges.select("part", "node", "parent", F.lit(1).cast("bigint").alias("weight"), _no_path().alias("label")).groupBy("part").applyInArrow(_contract(False), "part bigint, node string, parent string, end string, hops bigint, state int, label array<string>"), f"ends-{level}")
    quotient = tops.join(ends.select("part", "node", F.when(F.col("state") == 1, F.col("end")).alias("parent")), "node").select(F.floor(F.col("part") / shrink).cast("bigint").alias("part"), "node", "parent", F.col("handed").alias("weight"))
    quotient = durable(quotient, f"sizes-quotient-{level}")
    solved = _accumulate(quotient, level + 1, shrink)
    fed = durable(edges.join(solved.withColumnRenamed("total", "extra"), "node", "left").select("part", "node", "parent", "weight", F.coalesce("extra", F.lit(0)).alias("extra")), f"sizes-fed-{level}")
    return fed.groupBy("part").applyInArrow(_sizes, shape).select("node", "total")


def descendant_counts(forest: DataFrame, rows_per_fragment: int = 20_000, least_fragments: int = 4, shrink: int = 8) -> DataFrame:
    """(node, n_descendants, n_children) for every node of hierarchy(); 0 where there are none, loops included.

    Sizes are added up along the trees, fragment by fragment (see _accumulate), so no pair of a node
    and a descendant is made. Rows should come ordered near their relatives; they are put into
    fragments by root and depth.
    """
    rows = durable(forest.where("state = 0").select("node", "parent", "root", "depth"), "sizes-rows")
    parts = max(least_fragments, -(-rows.count() // rows_per_fragment))
    placed = rows.repartitionByRange(parts, "root", "depth", "node").select(F.spark_partition_id().cast("bigint").alias("part"), "node", "parent", F.lit(1).cast("bigint").alias("weight"))
    totals = _accumulate(durable(placed, "sizes-edges"), 0, shrink)
    children = rows.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("bigint")
    return forest.select("node").join(totals, "node", "left").join(children, "node", "left").select("node", F.coalesce(F.col("total") - 1, zero).alias("n_descendants"), F.coalesce("n_children", zero).alias("n_children"))
