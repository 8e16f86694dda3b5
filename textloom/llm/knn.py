"""Problem 3: the k most similar vectors of every vector, by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.runtime import durable, release


def _unit(column, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def design(n: int, list_rows: int = 900, max_ends: int = 65_536) -> tuple[int, int]:
    """(ends, depth) for n vectors: how many array ends there are, and at how many of them a vector is posted.

    ``depth`` grows with the logarithm of n, so that recall holds; ``ends`` grows with n, so that a
    list at an end keeps about ``list_rows`` rows and the work per query hardly grows.
    """
    depth = max(5, round(4 * math.log10(max(n, 10)) - 9))
    ends = min(max_ends, max(2 * depth, -(-n * depth // list_rows)))
    return ends + ends % 2, depth


def directions(ends: int, dim: int, seed: int = 5) -> np.ndarray:
    """Random directions; each is one sorted array, whose two ends are numbered k and k + ends / 2."""
    return np.random.default_rng(seed).standard_normal((dim, ends // 2)).astype(np.float32)


def outermost(x: np.ndarray, a: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Per vector the ``depth`` array ends it lies nearest to, and how far out it lies there."""
    v = x.astype(np.float32) @ a
    v = np.concatenate((v, -v), axis=1)
    depth = min(depth, v.shape[1])
    at = np.argpartition(-v, depth - 1, axis=1)[:, :depth] if depth < v.shape[1] else np.tile(np.arange(depth), (len(v), 1))
    return at.astype(np.int32), np.take_along_axis(v, at, 1)


def _sizes(plan: dict[str, tuple[int, int]], dim: int):
    """(model, end, n): how many of a task's vectors are posted at every end."""

    def run(batches):
        arrays = {m: directions(ends, dim) for m, (ends, _) in plan.items()}
        total = {m: np.zeros(ends, np.int64) for m, (ends, _) in plan.items()}
        for batch in batches:
            models, x = np.array(batch.column(0).to_pylist(), object), _unit(batch.column(1), dim)
            for m, (ends, depth) in plan.items():
                own = np.flatnonzero(models == m)
                for i in range(0, len(own), 1024):
                    total[m] += np.bincount(outermost(x[own[i : i + 1024]], arrays[m], depth)[0].ravel(), minlength=ends)
        for m, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["model", "end", "n"])

    return run


def _post(plan: dict[str, tuple[int, int]], dim: int, order: dict[str, np.ndarray], with_vectors: bool = True):
    """(id, model, ends, places[, embedding]): the ends of every vector, numbered and sorted by the length of their lists."""

    def run(batches):
        arrays = {m: directions(ends, dim) for m, (ends, _) in plan.items()}
        for batch in batches:
            models, x = np.array(batch.column(1).to_pylist(), object), _unit(batch.column(2), dim)
            ends, places = [None] * len(models), [None] * len(models)
            for m, (_, depth) in plan.items():
                own = np.flatnonzero(models == m)
                for i in range(0, len(own), 1024):
                    part = own[i : i + 1024]
                    at, far = outermost(x[part], arrays[m], depth)
                    at = order[m][at]
                    s = np.argsort(at, axis=1)
                    for k, e, f in zip(part, np.take_along_axis(at, s, 1), np.take_along_axis(far, s, 1)):
                        ends[k], places[k] = e, f
            cols = [*batch.columns[:2], pa.array(ends, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.float32())), *batch.columns[2 : 3 if with_vectors else 2]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "model", "ends", "places", "embedding"][: len(cols)])

    return run


def collisions(ends: np.ndarray, here: int, settled: int, rows: int = 256):
    """Blocks (a, b, count), a < b, of rows that collide at end ``here`` and at further ends.

    ``count`` leaves ``here`` itself out. Pairs that collide at an end before ``here`` and before
    ``settled`` are left out: the list of that end has them. Only rows that meet in another list are
    touched, and ``rows`` of them at a time.
    """
    n, depth = ends.shape
    flat, row = ends.ravel(), np.repeat(np.arange(n), depth)
    other = flat != here
    flat, row = flat[other], row[other]
    s = np.argsort(flat, kind="stable")  # within a list the rows stay in order
    flat, row = flat[s], row[s]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, int)
    size = np.diff(np.r_[start, len(flat)])
    behind = np.repeat(start + size, size) - np.arange(len(flat)) - 1  # how many of the same list follow each posting
    early = flat < min(here, settled)
    by_row = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[by_row], np.arange(0, n + rows, rows))
    for k, r0 in enumerate(range(0, n, rows)):
        own = by_row[cuts[k] : cuts[k + 1]]
        more = behind[own]
        first = np.repeat(own, more)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)
        key = (row[first] - r0) * n + row[second]
        met = np.bincount(key, minlength=0)
        met[key[early[first]]] = 0
        at = np.flatnonzero(met)
        yield at // n + r0, at % n, met[at]


def best(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest similarities of every q, ties by d."""
    order = np.lexsort((d, -s, q))
    g = q[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, int)
    return order[np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)])) < k]


def search_list(ids: np.ndarray, x: np.ndarray, ends: np.ndarray, here: int, settled: int, side: np.ndarray, k: int, least: float, need: int):
    """(id, other, similarity) of one list: pairs with at least ``need`` collisions, verified by their cosine.

    ``side`` tells two neighbouring windows of a long list apart; pairs within the second (side 1) are left to its own task.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    rough = x.astype(np.float32)  # its error is below 1e-5; what is near the limit is decided in double precision
    for a, b, met in collisions(ends, here, settled):
        keep = (met >= need - 1) & ((side[a] == 0) | (side[b] == 0))
        a, b = a[keep], b[keep]
        for i in range(0, len(a), 50_000):
            p, q = a[i : i + 50_000], b[i : i + 50_000]
            if least > -1:
                near = np.einsum("ij,ij->i", rough[p], rough[q]) >= least - 1e-4
                p, q = p[near], q[near]
            sims = np.einsum("ij,ij->i", x[p], x[q])
            keep = sims >= least
            out.append((p[keep], q[keep], sims[keep]))
    a, b, sims = (np.concatenate(c) for c in zip(*out))
    q, d, s = np.r_[a, b], np.r_[b, a], np.r_[sims, sims]
    top = best(q, ids[d], s, k)
    return ids[q[top]], ids[d[top]], s[top]


def _search(dim: int, k: int, least: float, need: int, settled: dict[str, int]):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        if rows.num_rows < 2:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        ids, side, here = rows["id"].to_numpy(), rows["side"].to_numpy(), rows["end"][0].as_py()
        x = _unit(rows["embedding"].chunk(0), dim)
        ends = rows["ends"].chunk(0).flatten().to_numpy().reshape(len(ids), -1)
        out = search_list(ids, x, ends, here, settled[rows["model"][0].as_py()], side, k, least, need)
        return pa.table({"id": pa.array(out[0]), "other": pa.array(out[1]), "similarity": pa.array(out[2])})

    return run


def usable_vectors(df: DataFrame, dim: int = 64) -> DataFrame:
    """(chunk_id, model, embedding): of every chunk_id the row with the latest created_at, if it has ``dim`` finite numbers that aren't all zero and a model.

    Null ids are left out; of rows with one created_at the greatest (model, embedding) holds.
    """
    row = F.struct("created_at", "model", "embedding")
    latest = df.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(row).alias("r")).select("chunk_id", "r.model", "r.embedding")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return latest.where(F.col("model").isNotNull() & (F.size("embedding") == dim) & ~bad & F.exists("embedding", lambda v: v != 0))


def nearest(df: DataFrame, k: int = 10, least: float = -1.0, dim: int = 64, need: int = 2, list_rows: int = 900, window: int = 4000, max_ends: int = 65_536) -> DataFrame:
    """(chunk_id, neighbour, similarity, rank): the k most similar others of the same model, of at least ``least`` similarity.

    Only usable vectors count (see usable_vectors). Similarity is the cosine in double precision; ties
    are put in order of the neighbour's id. Equal vectors form one class that is searched once; its
    members are each other's nearest. An empty table gives an empty result; other columns are ignored.

    Method: every random direction is a sorted array of the vectors' projections. Around a query that
    lies in the middle of an array a window holds a share of all rows, which makes counting over all
    arrays quadratic for all queries together; so a query opens windows only in the arrays at whose
    ends it lies (the ``depth`` outermost of ``ends``, see design; both follow the number of vectors).
    Two vectors collide where they lie at the same end; pairs with at least ``need`` collisions are
    verified by their cosine. Of a vector's lists the ``need - 1`` longest needn't be posted, since
    pairs with enough collisions meet in one of the others; a pair is counted in the shortest list it
    shares, so no counts are shuffled. Lists of more than ``window`` rows are cut into windows of
    projections, each with its neighbour in one task, so a vector is compared with at least the
    ``window`` / 2 rows around it and a list of any length is no hot group. Nothing is fitted or sampled.

    What the driver sees is one count per model and per end (at most ``max_ends`` a model).
    """
    spark = df.sparkSession
    current = usable_vectors(df, dim).withColumn("id", F.xxhash64("model", "embedding"))
    current = durable(current, "knn-vectors")
    keys = durable(current.select("id", "chunk_id"), "knn-keys")
    same = W.partitionBy("id").orderBy("chunk_id")
    members = durable(keys.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1), "knn-members")
    vectors = durable(current.select("id", "model", "embedding").dropDuplicates(["id"]), "knn-classes-vectors")
    release(current)
    plan = {r["model"]: design(r["n"], list_rows, max_ends) for r in vectors.groupBy("model").agg(F.count("*").alias("n")).collect()}
    sizes = vectors.select("model", "embedding").mapInArrow(_sizes(plan, dim), "model string, end int, n bigint").groupBy("model", "end").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    order, long, settled = {}, [], {}
    for m, (ends, _) in plan.items():
        n = np.zeros(ends, np.int64)
        own = sizes[sizes["model"] == m]
        n[own["end"].to_numpy()] = own["n"].to_numpy()
        order[m] = np.empty(ends, np.int32)
        order[m][np.argsort(n, kind="stable")] = np.arange(ends)
        settled[m] = int((n <= window).sum())
        long += [(m, int(order[m][e]), int(-(-2 * n[e] // window))) for e in np.flatnonzero(n > window)]
    slim = "id bigint, model string, ends array<int>, places array<float>"
    zipped = F.arrays_zip("ends", "places")
    numbered = vectors.select("id", "model", "embedding").mapInArrow(_post(plan, dim, order), f"{slim}, embedding array<float>")
    posts = numbered.select("id", "model", "embedding", "ends", F.explode(F.slice(zipped, F.lit(1), F.size("ends") - (need - 1))).alias("p")).select("id", "model", "embedding", "ends", F.col("p.ends").alias("end"), F.col("p.places").alias("place"))
    if long:
        lists = spark.createDataFrame(long, "model string, end int, cuts int")  # fewer than ends a model
        places = vectors.select("id", "model", "embedding").mapInArrow(_post(plan, dim, order, False), slim).select("model", F.explode(zipped).alias("p")).select("model", F.col("p.ends").alias("end"), F.col("p.places").alias("place"))
        marks = places.join(lists, ["model", "end"]).groupBy("model", "end").agg(F.percentile_approx("place", [i / 1000 for i in range(1, 1000)], 20_000).alias("permille"), F.max("cuts").alias("cuts"))
        # windows of equal share of the list; more than a thousand of them would need finer marks
        marks = durable(marks.select("model", "end", F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.col("cuts"), F.lit(1000)) - 1), lambda i: F.get("permille", F.floor(i * 1000 / F.least("cuts", F.lit(1000))).cast("int") - 1))).alias("marks")), "knn-marks")
        posts = posts.join(marks, ["model", "end"], "left").withColumn("w", F.coalesce(F.size(F.filter("marks", lambda m: m < F.col("place"))), F.lit(0)))
        pair = F.when(F.col("marks").isNull() | (F.col("w") == 0), F.array(F.struct(F.col("w").alias("g"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("w").alias("g"), F.lit(0).alias("side")), F.struct((F.col("w") - 1).alias("g"), F.lit(1).alias("side"))))
        posts = posts.select("id", "model", "embedding", "ends", "end", F.explode(pair).alias("p")).select("id", "model", "embedding", "ends", "end", F.col("p.g").alias("g"), F.col("p.side").alias("side"))
    else:
        posts = posts.select("id", "model", "embedding", "ends", "end", F.lit(0).alias("g"), F.lit(0).alias("side"))
    found = posts.groupBy("model", "end", "g").applyInArrow(_search(dim, k, least, need, settled), "id bigint, other bigint, similarity double").repartition("id")
    if long:  # pairs of long lists may come from several
        found = found.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    nearer = W.partitionBy("id").orderBy(F.desc("similarity"), "other")
    classes = durable(found.withColumn("place", F.row_number().over(nearer)).where(F.col("place") <= k).drop("place"), "knn-classes")
    release(vectors)
    across = classes.join(members.select(F.col("id").alias("other"), F.col("chunk_id").alias("neighbour")), "other").select("id", "neighbour", "similarity")
    inside = members.join(members.where("n = 2").select("id"), "id", "left_semi").select("id", F.col("chunk_id").alias("neighbour"), F.lit(1.0).alias("similarity"))
    ranked = W.partitionBy("chunk_id").orderBy(F.desc("similarity"), "neighbour")
    return keys.join(across.union(inside), "id").where("chunk_id != neighbour").select("chunk_id", "neighbour", "similarity", F.row_number().over(ranked).alias("rank")).where(F.col("rank") <= k)


def similar_pairs(neighbours: DataFrame, least: float = 0.8) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: pairs of which at least one is among the other's nearest, with at least ``least`` similarity."""
    return neighbours.where(F.col("similarity") >= least).select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()
