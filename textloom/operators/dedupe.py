"""Duplicates: exact by hash, near by token sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.functions.shingles import MULT, WordHashes, mix, permutations, shingle_hashes, signature
from textloom.operators.components import connected_components
from textloom.runtime import durable, release, split_join


def exact(df: DataFrame, id_col: str, text_col: str, scope: str | None = None) -> DataFrame:
    """(id, kept_id, is_kept): the least id of every text (within ``scope``, a column, if given) is kept.

    Null texts are no duplicates of each other; null ids are left out; a repeated row counts once.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.sha2(F.col(text_col), 256).alias("text_hash"), *([F.col(scope).alias("scope")] if scope else [])).distinct()
    key = ["text_hash"] + (["scope"] if scope else [])
    least = rows.where("text_hash is not null").groupBy(*key).agg(F.min("id").alias("kept_id"))
    same = rows["text_hash"] == least["text_hash"]
    if scope:
        same = same & rows["scope"].eqNullSafe(least["scope"])
    out = rows.join(least, same, "left").select(rows["id"], F.coalesce(least["kept_id"], rows["id"]).alias("kept_id"))
    return out.select("id", "kept_id", (F.col("id") == F.col("kept_id")).alias("is_kept"))


def removed_lists(marked: DataFrame, limit: int = 1000) -> DataFrame:
    """(kept_id, n_removed, removed) for every id that stands for others; ``removed`` lists, in order, the first ``limit`` of what it stands for, ``n_removed`` counts all."""
    gone = marked.where("not is_kept")
    place = F.row_number().over(W.partitionBy("kept_id").orderBy("id"))
    lists = gone.withColumn("place", place).where(F.col("place") <= limit).groupBy("kept_id").agg(F.array_sort(F.collect_list("id")).alias("removed"))  # at most ``limit`` ids each
    return gone.groupBy("kept_id").agg(F.count("*").alias("n_removed")).join(lists, "kept_id")


def report(marked: DataFrame) -> DataFrame:
    """(kept_id, n_removed, first_removed, last_removed) for every id that stands for others (see removed_lists for all of them)."""
    gone = marked.where("not is_kept")
    return gone.groupBy("kept_id").agg(F.count("*").alias("n_removed"), F.min("id").alias("first_removed"), F.max("id").alias("last_removed"))


def _prefixes(threshold: float, known: np.ndarray, df: np.ndarray, complete: bool):
    """(set, n, m0, m1, prefix) of sets of token hashes: size, parities of the tokens over 128 buckets, and the first tokens, with their places, by frequency in the sorted ``known`` (others first), then by hash."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            offsets = column.offsets.to_numpy()
            flat, offsets = column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            count = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                count = np.where(known[at] == flat, df[at], 0)
            order = np.lexsort((flat, count, row))  # rows stay where they are
            place = np.arange(len(flat)) - np.repeat(offsets[:-1], n)
            first = place < np.repeat(n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1, n)
            if complete:  # what isn't known has no other set
                first &= count[order] > 0
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(n))))).astype(np.int32)
            posts = pa.StructArray.from_arrays([pa.array(flat[order][first]), pa.array(place[first].astype(np.int32))], names=["token", "place"])
            bucket = (mix(flat.view(np.uint64)) & np.uint64(127)).astype(np.int64)
            odd = (np.bincount(row * 128 + bucket, minlength=len(n) * 128) & 1).astype(np.uint8).reshape(len(n), 128)
            bits = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1])), pa.ListArray.from_arrays(ends, posts)], names=["set", "n", "m0", "m1", "prefix"])

    return run


def jaccard(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.95, scope: str | None = None, known_tokens: int = 1_000_000) -> DataFrame:
    """(id, kept_id, is_kept, n_links): greedy removal of near-duplicates by token sets, in the order of ids.

    Tokens are runs between white space, lower case. A row is removed if it is at least ``threshold``
    similar (Jaccard) to an earlier row that is kept; ``kept_id`` is the earliest such row of those it
    was compared with. With ``scope`` (a column) only rows of one scope are compared. ``n_links``
    counts the links found to other sets. Null or blank texts and null ids are left out; repeated ids
    count once. Tokens are compared by 64-bit hashes.

    Candidates come from an exact prefix filter: with the tokens of a set in order of rarity, two
    sets that similar share one of their first (1 - threshold) of tokens. Any order will do, if it is
    one for all: the frequencies of the most frequent tokens, at most ``known_tokens`` of them, are
    counted over all rows, the others come before these, by hash. Only prefixes are posted; sets and
    texts are read again for pairs that may be similar by their sizes, by the places of the shared
    token and by the parities of their tokens over 128 buckets, which differ in no more buckets than
    the sets do in tokens. None of this loses a pair.

    Equal sets count as one row, and what rows that are surely kept remove is compared no further, so
    groups of copies and near-copies give about one pair a row. The greedy order is resolved in
    rounds: a row none of whose earlier links is undecided or kept is kept. Every round decides at
    least the first of what is undecided, so the rounds end, after as many as the longest chain of
    rows that depend on each other.
    """

    def sets_of(rows: DataFrame, *more: str) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
        return rows.select("id", F.array_sort(F.array_distinct(F.transform(words, lambda t: F.xxhash64(t, "k")))).alias("tokens"), *more).withColumn("set", F.xxhash64("tokens"))

    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.xxhash64(scope) if scope else F.lit(0).cast("bigint")).alias("k")).where(F.col("text").rlike(r"\S"))  # a filter on the tokens would compute them twice
    marked = durable(sets_of(rows).select("id", "set", F.size("tokens").alias("n")), "jaccard-rows")
    members = durable(marked.groupBy("id").agg(F.min("set").alias("set")), "jaccard-members")
    sets = durable(members.groupBy("set").agg(F.min("id").alias("id")), "jaccard-sets")
    least = max(2, -(-(marked.agg(F.sum("n")).first()[0] or 0) // known_tokens))
    counted = sets_of(rows).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least).toArrow()
    known, often = counted.column("token").to_numpy(), counted.column("df").to_numpy()
    order = np.argsort(known)
    cut = sets_of(rows).select("set", "tokens").mapInArrow(_prefixes(threshold, known[order], often[order], least == 2), "set bigint, n int, m0 bigint, m1 bigint, prefix array<struct<token: bigint, place: int>>")
    cut = cut.groupBy("set").agg(F.first("n").alias("n"), F.first("m0").alias("m0"), F.first("m1").alias("m1"), F.first("prefix").alias("prefix"))
    prefix = durable(sets.join(cut, "set").select("set", "id", "n", "m0", "m1", F.explode("prefix").alias("t")).select("set", "id", "n", "m0", "m1", "t.token", "t.place"), "jaccard-postings")

    def near_enough(a: str, b: str) -> str:
        """Exact: what two sets of these sizes and parities must meet to be similar enough."""
        most = f"({a}n + {b}n) * {(1 - threshold) / (1 + threshold)!r} + 1e-6"
        return f"least({a}n, {b}n) >= {threshold} * greatest({a}n, {b}n) - 1e-9 and bit_count({a}m0 ^ {b}m0) + bit_count({a}m1 ^ {b}m1) <= {most}"

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = durable(pairs.distinct(), "jaccard-pairs")
        needed = pairs.select(F.col("u").alias("wanted"), F.col("uid").alias("id")).union(pairs.select("v", "vid")).distinct()
        texts = durable(rows.join(needed, "id"), "jaccard-texts")  # else the tokens of all rows would be computed for the join
        lead = durable(sets_of(texts, "wanted").where("set = wanted").dropDuplicates(["set"]).select("set", "tokens"), "jaccard-tokens")
        x, y = lead.select(F.col("set").alias("u"), F.col("tokens").alias("ut")), lead.select(F.col("set").alias("v"), F.col("tokens").alias("vt"))
        both = F.size(F.array_intersect("ut", "vt"))
        out = durable(split_join(pairs, x, "u").join(y, "v").where(both >= threshold * (F.size("ut") + F.size("vt") - both) - 1e-9).select("u", "v", "uid", "vid"), "jaccard-links")
        release(pairs, texts, lead)
        return out

    # first what is surely kept: the rows that come first in each of their postings; what they remove is compared no further
    firsts = durable(prefix.groupBy("token").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("size")).where("first != last").select("token", "first", "size"), "jaccard-firsts")
    placed = durable(split_join(prefix, firsts, "token", weight="size"), "jaccard-placed")
    release(prefix)
    sure = placed.groupBy("set", "id", "n", "m0", "m1").agg(F.max(F.col("id") != F.col("first")).alias("other")).where("not other").drop("other")
    a, b = sure.alias("a"), placed.where("id != first").select("set", "id", "n", "m0", "m1", "first").distinct().alias("b")
    star = verified(a.join(b, F.expr(f"a.id = b.first and {near_enough('a.', 'b.')}")).select(F.col("a.set").alias("u"), F.col("b.set").alias("v"), F.col("a.id").alias("uid"), F.col("b.id").alias("vid")))
    rest = placed.drop("first").join(star.select(F.col("v").alias("set")).distinct(), "set", "left_anti")
    a, b = rest.alias("a"), rest.alias("b")
    in_place = f"least(a.n - a.place, b.n - b.place) >= (a.n + b.n) * {threshold / (1 + threshold)!r} - 1e-6"  # the first shared token is followed by enough
    near = a.join(b, F.expr(f"a.token = b.token and a.id < b.id and {in_place} and {near_enough('a.', 'b.')}")).select(F.col("a.set").alias("u"), F.col("b.set").alias("v"), F.col("a.id").alias("uid"), F.col("b.id").alias("vid"))
    links = durable(star.union(verified(near)).distinct(), "jaccard-links")
    release(placed, firsts, star)
    degree = links.select(F.explode(F.array("u", "v")).alias("set")).groupBy("set").agg(F.count("*").alias("n_links"))
    state = durable(degree.select("set", F.lit(None).cast("boolean").alias("kept")), "jaccard-state")  # what has no link is kept
    while True:
        now = links.join(state.withColumnRenamed("set", "u"), "u").groupBy("v").agg(F.max(F.coalesce("kept", F.lit(False))).alias("any_kept"), F.max(F.col("kept").isNull()).alias("any_open"))
        new = state.join(now.withColumnRenamed("v", "set"), "set", "left").select("set", F.coalesce("kept", F.when(F.col("any_kept"), False).when(F.coalesce("any_open", F.lit(False)), F.lit(None)).otherwise(True)).alias("kept"))
        old, state = state, durable(new, "jaccard-state")
        release(old)
        if state.where("kept is null").isEmpty():
            break
    stands = links.join(state.where("kept").select(F.col("set").alias("u")), "u").groupBy("v").agg(F.min("uid").alias("kept_id"))
    told = state.join(stands.withColumnRenamed("v", "set"), "set", "left").join(degree, "set", "left").where("n_links > 0")
    lead = sets.select("set", F.col("id").alias("lead")).join(told, "set", "left").select("set", F.when(F.coalesce("kept", F.lit(True)), F.col("lead")).otherwise(F.col("kept_id")).alias("kept_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return members.join(lead, "set").select("id", "kept_id", (F.col("id") == F.col("kept_id")).alias("is_kept"), "n_links")


def _minhash(words: int, bands: int, rows: int):
    salts = permutations(bands * rows)

    def run(batches):
        known = WordHashes()
        for batch in batches:
            out = []
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_hashes(t, words, known)
                if len(s):
                    keys = np.arange(bands, dtype=np.uint64)
                    for column in signature(s, salts).reshape(bands, rows).T:
                        keys = mix(keys + MULT) ^ column.astype(np.uint64)
                    out.append((n, int(mix(s).sum(dtype=np.uint64).view(np.int64)), mix(keys).view(np.int64), s.tobytes()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())], names=["id", "set", "keys", "s"])

    return run


def _similar(threshold: float):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def minhash(df: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, bands: int = 16, rows_per_band: int = 4) -> DataFrame:
    """(id, group_id, is_kept): groups of texts whose sets of ``words`` words are at least ``threshold`` similar, by banded MinHash.

    The least id of a group is kept. Candidates share a band of ``rows_per_band`` MinHash values and
    are verified exactly: first every member with the band's least one, then the other pairs of each
    band whose ends aren't connected by that. At a similarity of 0.8 a pair shares one of 16 bands of
    4 with a probability of 99.98 %. Bands shared by many texts that are *not* similar enough are
    compared in pairs. Texts with fewer words, null texts and null ids are left out; equal sets are
    one row; repeated ids count once.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("__t"))
    kind = rows.schema["id"].dataType.simpleString()
    marked = durable(rows.mapInArrow(_minhash(words, bands, rows_per_band), f"id {kind}, set bigint, keys array<bigint>, s binary"), "minhash-rows")
    sets = durable(marked.groupBy("id").agg(F.min("set").alias("set")), "minhash-sets")
    posts = marked.select("set", F.explode("keys").alias("key"))
    hubs = posts.groupBy("key").agg(F.min("set").alias("u"), F.max("set").alias("last")).where("u != last").select("key", "u")
    linked = durable(posts.join(hubs, "key").where("set != u").distinct(), "minhash-postings")
    needed = linked.select("set").union(linked.select("u")).distinct()
    lead = durable(marked.select("set", "s").join(needed, "set", "left_semi").dropDuplicates(["set"]), "minhash-shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = lead.select(F.col("set").alias("u"), F.col("s").alias("us")), lead.select(F.col("set").alias("v"), F.col("s").alias("vs"))
        return pairs.join(x, "u").join(y, "v").select("u", "v", "us", "vs").mapInArrow(_similar(threshold), "u bigint, v bigint")

    star = durable(verified(linked.select("u", F.col("set").alias("v")).distinct()), "minhash-links")
    first = connected_components(star).withColumnRenamed("node", "set")
    placed = durable(linked.join(first, "set", "left").select("key", "set", F.coalesce("component", "set").alias("c")), "minhash-placed")
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("key")
    left = placed.join(mixed, "key")
    p, q = left.alias("p"), left.alias("q")
    crossing = p.join(q, F.expr("p.key = q.key and p.set < q.set and p.c != q.c")).select(F.col("p.set").alias("u"), F.col("q.set").alias("v")).distinct()
    links = durable(star.unionByName(verified(crossing)), "minhash-links")
    groups = connected_components(links).withColumnRenamed("node", "set")
    release(marked, linked, lead, star, placed)
    named = sets.select("id", "set").join(groups, "set", "left").select("id", F.coalesce("component", "set").alias("c"))
    names = named.groupBy("c").agg(F.min("id").alias("group_id"))
    return named.join(names, "c").select("id", "group_id", (F.col("id") == F.col("group_id")).alias("is_kept"))


def new_content(chunks: DataFrame, history: DataFrame, key: str = "content_hash") -> DataFrame:
    """Chunks whose content hash is not in ``history``."""
    return chunks.join(history.select(key).distinct(), key, "left_anti")


def new_sources(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``incoming`` (position, type, uri, ...) with ``added`` and ``reason``: '' or why it is skipped.

    A source is skipped if its (type, uri) exists or came earlier in the batch (by ``position``).
    """
    known = existing.select("type", "uri").distinct().withColumn("known", F.lit(True))
    first = incoming.groupBy("type", "uri").agg(F.min("position").alias("first_position"))
    judged = incoming.join(first, ["type", "uri"]).join(known, ["type", "uri"], "left")
    reason = F.when(F.col("known"), "already exists").when(F.col("position") > F.col("first_position"), "repeated in batch").otherwise("")
    return judged.withColumn("reason", reason).withColumn("added", F.col("reason") == "").drop("known", "first_position")
