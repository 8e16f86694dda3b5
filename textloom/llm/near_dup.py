"""Problem 5: groups of near-duplicate texts, by a signature-coordinate inverted join."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.functions.shingles import MULT, WordHashes, mix, permutations, shingle_hashes, signature
from textloom.operators.components import connected_components
from textloom.runtime import durable, release, sieved, split_join


def _keys(sig: np.ndarray, values: int) -> np.ndarray:
    """One posting key per (coordinate, value) pair; a coordinate's value is made of ``values`` MinHash values."""
    parts = sig.view(np.uint32).reshape(-1, values).astype(np.uint64)
    acc = np.arange(len(parts), dtype=np.uint64)
    for k in range(values):
        acc = mix(acc + MULT) ^ parts[:, k]
    return (mix(acc) >> np.uint64(8)).view(np.int64)


def _signatures(coordinates: int, values: int, words: int):
    salts = permutations(coordinates * values)

    def run(batches):
        known, seen = WordHashes(), set()
        for batch in batches:
            ids, fps, coords, ends = [], [], [], [0]
            for cid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_hashes(text, words, known)
                if not len(s):
                    continue
                fp = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                ids.append(cid)
                fps.append(fp)
                if fp not in seen:  # copies within a task need no postings of their own
                    seen.add(fp)
                    coords.append(_keys(signature(s, salts), values))
                ends.append(coordinates * len(coords))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(fps, pa.int64()), pa.ListArray.from_arrays(np.array(ends, np.int32), np.concatenate(coords) if coords else np.empty(0, np.int64))],
                names=["id", "fp", "coords"],
            )

    return run


def _sets(coordinates: int, values: int, words: int):
    """(fp, sig, set): signature and whole set of shingle hashes of every class that is compared."""
    salts = permutations(coordinates * values)

    def run(batches):
        known = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, words, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_keys(signature(s, salts), values).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "sig", "set"])

    return run


def _verify(threshold: float, matches: int):
    """Count the coordinates in which the two signatures agree; pairs with enough are verified on the whole sets."""

    def run(batches):
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1), np.int64) for c in ("us", "vs"))
            keep = (u == v).sum(axis=1) >= matches
            at = np.flatnonzero(keep)
            part = batch.take(pa.array(at))
            for k, a, b in zip(at, part.column("ut").to_pylist(), part.column("vt").to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
                    keep[k] = False
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both >= threshold * (len(x) + len(y) - both) - 1e-9
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shared(posts: DataFrame) -> DataFrame:
    """(key, df): the postings of more than one class, with how often they are posted."""
    return posts.groupBy("key").agg(F.count("*").alias("df"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("key", "df")


def _alive(posts: DataFrame, shared: DataFrame, matches: int) -> DataFrame:
    """(fp, keys): per class its postings that others share too, rarest first; classes with fewer than ``matches`` of them can't be linked and are skipped."""
    return split_join(posts, shared.withColumn("n", F.col("df")), "key", weight="n").groupBy("fp").agg(F.array_sort(F.collect_set(F.struct("df", "key"))).alias("keys")).where(F.size("keys") >= matches)  # at most one entry a coordinate


def near_duplicates(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", words: int = 3, threshold: float = 0.6, coordinates: int = 32, values: int = 3, matches: int = 2, heavy: int = 500, slices: int = 4) -> DataFrame:
    """(id, group_id, class_id) for every text that has at least ``words`` words.

    Two texts are linked if the Jaccard similarity of their word n-gram sets is at least
    ``threshold``; a group is all that is linked directly or through others, named by its least id.
    Texts with equal sets form one class, named by its least id too.

    Method: every class is posted under each (coordinate, value) pair of a signature. A coordinate
    takes ``values`` MinHash values together, because the postings of single values of common phrases
    grow with the corpus. Pairs that agree in at least ``matches`` of the ``coordinates`` are
    candidates (99.6 % of the pairs of a similarity of 0.6, 99.96 % of those of 0.65), so what can't
    reach that count is skipped before any pair is made: postings of one class, then classes with fewer than ``matches`` shared postings, twice over.
    What is left is posted under its prefix only, with the rarest postings first: two classes that
    share ``matches`` postings share one of all but the last ``matches - 1`` of either. Candidates'
    agreeing coordinates are counted on the signatures, and pairs above the match threshold are
    verified on the whole shingle sets.

    Most postings have one class and most texts no candidate, so little is moved of either: postings
    are counted in ``slices`` runs over some of the coordinates each, whose shuffle files are removed
    before the next; after that, postings and texts are sieved by the keys looked for before they are
    shuffled (``runtime.sieved``).

    Within a posting every class is first compared with the posting's least class only, beginning with
    the least over all its postings; classes that are then in one component need no further
    comparison, and only pairs across components are enumerated. So a posting made of one big group
    of copies costs as many comparisons as it has members. A posting of more than ``heavy`` classes
    that are still apart is split: its classes are posted under the pairs of it and one more posting
    of the prefix, made longer by one, which pairs with at least two agreements share too.

    Null ids, null texts and texts with fewer words are in no group and give no row; repeated ids
    count once; other columns are ignored; an empty table gives an empty result.
    """
    if not 2 <= matches <= coordinates:
        raise ValueError("matches must be from 2 to the number of coordinates")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    marked = durable(rows.mapInArrow(_signatures(coordinates, values, words), f"id {kind}, fp bigint, coords array<bigint>"), "nd-signatures")
    members = durable(marked.groupBy("id").agg(F.min("fp").alias("fp")), "nd-members")
    width = -(-coordinates // slices)
    counted = [durable(_shared(marked.select("fp", F.explode(F.slice("coords", k + 1, width)).alias("key"))), "nd-shared") for k in range(0, coordinates, width)]
    shared = reduce(DataFrame.unionByName, counted)
    once = durable(_alive(sieved(marked.select("fp", F.explode("coords").alias("key")), shared, "key"), shared, matches), "nd-alive")
    release(marked, *counted)
    posts = once.select("fp", F.explode("keys.key").alias("key"))
    again = durable(_shared(posts), "nd-shared")
    alive = durable(_alive(posts, again, matches), "nd-alive")
    release(once, again)
    prefix = F.slice("keys.key", F.lit(1), F.size("keys") - (matches - 1))
    posts = durable(alive.select("fp", F.explode(prefix).alias("key")), "nd-postings")

    hubs = posts.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("last"), F.count("*").alias("n")).where("hub != last").select("key", "hub", "n")
    linked = durable(split_join(posts, durable(hubs, "nd-hubs"), "key", weight="n"), "nd-linked")
    needed = durable(linked.select("fp").distinct().join(members, "fp").groupBy("fp").agg(F.min("id").alias("id")), "nd-needed")
    sets = durable(sieved(rows, needed, "id").join(needed, "id").dropDuplicates(["fp"]).select("fp", "text").mapInArrow(_sets(coordinates, values, words), "fp bigint, sig binary, set binary"), "nd-sets")
    release(needed)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = durable(pairs, "nd-pairs")
        a = sets.select(F.col("fp").alias("u"), F.col("sig").alias("us"), F.col("set").alias("ut"))
        b = sets.select(F.col("fp").alias("v"), F.col("sig").alias("vs"), F.col("set").alias("vt"))
        out = durable(split_join(pairs, a, "u").join(b, "v").select("u", "v", "us", "vs", "ut", "vt").mapInArrow(_verify(threshold, matches), "u bigint, v bigint"), "nd-links")
        release(pairs)
        return out

    # every class with the least of its postings' hubs first; pairs whose ends are tied to one hub by then are connected
    nearest = durable(linked.groupBy("fp").agg(F.min("hub").alias("hub0")), "nd-nearest")
    tied = verified(nearest.where("fp != hub0").select(F.col("hub0").alias("u"), F.col("fp").alias("v")))
    label = tied.select(F.col("v").alias("of"), F.col("u").alias("to"))
    open_hubs = (
        linked.where("fp != hub").select("fp", "hub").distinct().join(nearest, "fp").where("hub != hub0")
        .join(label.select(F.col("of").alias("fp"), F.col("to").alias("a")), "fp", "left").join(label.select(F.col("of").alias("hub"), F.col("to").alias("b")), "hub", "left")
        .where(F.coalesce("a", "fp") != F.coalesce("b", "hub")).select(F.col("hub").alias("u"), F.col("fp").alias("v"))
    )
    star = tied.unionByName(verified(open_hubs))
    first = durable(connected_components(star), "nd-components")
    placed = durable(linked.select("key", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("c")), "nd-placed")
    mixed = durable(placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("c0 != c1 and n > 2").select("key", (F.col("n") > heavy).alias("heavy")), "nd-mixed")
    open_posts = placed.join(mixed, "key")
    longer = F.slice("keys.key", F.lit(1), F.size("keys") - (matches - 2))
    more = open_posts.where("heavy").join(alive.select("fp", longer.alias("also")), "fp").select("key", "fp", "c", F.explode("also").alias("second")).where("second != key")
    light = open_posts.where("not heavy").select("key", "fp", "c").unionByName(more.select(F.xxhash64("key", "second").alias("key"), "fp", "c"))
    light = durable(light, "nd-open")
    x, y = light.alias("x"), light.alias("y")
    crossing = x.join(y, F.expr("x.key = y.key and x.fp < y.fp and x.c != y.c")).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).distinct()
    across = verified(crossing)
    if across.isEmpty():
        label = first
    else:  # between components only
        label = durable(connected_components(star.unionByName(across)), "nd-components")
    classes = durable(members.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("id", "fp", F.coalesce("component", "fp").alias("c")), "nd-classes")
    release(members, alive, posts, linked, sets, nearest, placed, mixed, light)
    names = classes.groupBy("c").agg(F.min("id").alias("group_id"), F.count("*").alias("n"))
    same = classes.groupBy("fp").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    return split_join(split_join(classes, names, "c", weight="n"), same, "fp", weight="n").select("id", "group_id", "class_id")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: all pairs of members of a group; the pairs are the result asked for."""
    many = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    g = groups.join(many, "group_id").select("group_id", "id")
    a, b = g.alias("a"), g.alias("b")
    return a.join(b, F.expr("a.group_id = b.group_id and a.id < b.id")).select(F.col("a.id").alias("chunk_id_a"), F.col("b.id").alias("chunk_id_b"))
