"""Retrieval: semantic, keyword and hybrid top-k over one collection, for one query or many.

A collection has (id, text) and, for semantic search, embedding; other columns stay out of the way.
Scores are folded in the JVM; every ranking breaks ties by id. A top-k keeps k rows a task before
anything is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.vectors import cosine
from textloom.operators.ranking import ranked_by_ranges
from textloom.runtime import durable
from textloom.schema import RetrievalProfile

RRF_K = 60
#: Similarities are rounded before they are ranked, so that engines that add in another order rank alike.
DIGITS = 9


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def terms_of(query: str, longer_than: int = 0) -> list[str]:
    """Distinct query terms in order: lower case, between white space."""
    return [t for t in dict.fromkeys(query.lower().split()) if len(t) > longer_than]


def _filter(df: DataFrame, filters) -> DataFrame:
    for name, op, value in filters or ():
        df = df.where(predicate(name, op, value))
    return df


def predicate(name: str, op: str, value) -> Column:
    """One filter: eq, neq, gt, gte, lt, lte, in, contains (a part of a string) or has (an element of an array). Nulls never match, neq included."""
    c = F.col(name)
    if op == "contains":
        return F.coalesce(F.contains(c, F.lit(str(value))), F.lit(False))
    if op == "has":
        return F.coalesce(F.array_contains(c, value), F.lit(False))
    simple = {"eq": lambda: c == value, "neq": lambda: c != value, "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value, "in": lambda: c.isin(list(value))}
    if op not in simple:
        raise ValueError(f"unknown filter operator {op}")
    return F.coalesce(simple[op](), F.lit(False))


def top(scored: DataFrame, k: int) -> DataFrame:
    """(id, score, rank): the k best, ties by id."""
    best = scored.select("id", "score").orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))  # k rows only


def semantic(df: DataFrame, query: Sequence[float], k: int = 10, filters=None) -> DataFrame:
    """Cosine to the query vector; filters come before scoring; rows without a vector are left out."""
    rows = _filter(df, filters).where(F.col("embedding").isNotNull())
    return top(rows.select("id", F.round(cosine(F.col("embedding"), vector(query)), DIGITS).alias("score")), k)


def _occurrences(low: Column, term: str) -> Column:
    return (F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / F.lit(len(term))


def frequency_score(text: Column, query: str) -> Column:
    """Occurrences of all terms of more than two characters, over the square root of the text's length."""
    low = F.lower(text)
    hits = sum((_occurrences(low, t) for t in terms_of(query, 2)), F.lit(0.0))
    return F.round(F.when(F.length(text) > 0, hits / F.sqrt(F.length(text))).otherwise(0.0), DIGITS)


def ratio_score(text: Column, query: str) -> Column:
    """Share of the query's terms that occur in the text."""
    terms = terms_of(query)
    low = F.lower(text)
    return F.round(sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)) / F.lit(max(len(terms), 1)), DIGITS)


def keyword(df: DataFrame, query: str, k: int = 10, scoring: str = "frequency", filters=None, keep_zeros: bool = False) -> DataFrame:
    """Literal term matching by frequency_score or ratio_score; rows that match nothing are dropped unless asked for."""
    score = {"frequency": frequency_score, "ratio": ratio_score}[scoring](F.col("text"), query)
    rows = _filter(df, filters).where(F.col("text").isNotNull()).select("id", score.alias("score"))
    return top(rows if keep_zeros else rows.where("score > 0"), k)


def fuse_ranks(sides: Sequence[tuple[DataFrame, float]], k: int, digits: int = DIGITS) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (60 + rank) over the sides a row is on."""
    parts = [side.select("id", (F.lit(float(w)) / (F.lit(RRF_K) + F.col("rank"))).alias("part")) for side, w in sides]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return top(union.groupBy("id").agg(F.round(F.sum("part"), digits).alias("score")), k)


def hybrid(df: DataFrame, query: str, query_vector: Sequence[float], k: int = 10, alpha: float = 0.7, fusion: str = "rrf", filters=None, over_fetch: int = 3) -> DataFrame:
    """Semantic and frequency-keyword search fused: 'rrf' by ranks, 'weighted_sum' as alpha x cosine + (1 - alpha) x frequency."""
    one, two = semantic(df, query_vector, over_fetch * k, filters), keyword(df, query, over_fetch * k, "frequency", filters)
    if fusion == "rrf":
        return fuse_ranks([(one, alpha), (two, 1 - alpha)], k)
    joined = one.select("id", F.col("score").alias("s")).join(two.select("id", F.col("score").alias("t")), "id", "full_outer")
    return top(joined.select("id", F.round(alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.coalesce("t", F.lit(0.0)), DIGITS).alias("score")), k)


def project_hybrid(df: DataFrame, query: str, query_vector: Sequence[float], k: int = 10, filters=None) -> DataFrame:
    """0.7 x cosine + 0.3 x share of terms, over the rows that have a vector."""
    rows = _filter(df, filters).where(F.col("embedding").isNotNull())
    score = 0.7 * F.round(cosine(F.col("embedding"), vector(query_vector)), DIGITS) + 0.3 * F.coalesce(ratio_score(F.col("text"), query), F.lit(0.0))
    return top(rows.select("id", F.round(score, DIGITS).alias("score")), k)


def chat_fusion(df: DataFrame, query: str, query_vector: Sequence[float] | None, k: int = 10) -> DataFrame:
    """Rank fusion for conversations: keyword 0.3, semantic 0.7, top 2k of each, scores rounded to 4 digits before ranking; keyword alone without a vector."""
    words = keyword(df, query, 2 * k, "ratio")
    if query_vector is None:
        return top(words, k)
    return fuse_ranks([(words, 0.3), (semantic(df, query_vector, 2 * k), 0.7)], k, digits=4)


def mock_semantic(df: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Stand-in for semantic search: 0.8 x share of terms + 0.2 x (1 - 0.5 x place / number), the place by id from 0.

    The place of a row among all goes into the score; rows are ranked by ranges of ids, so that no
    window spans the table.
    """
    rows = df.where(F.col("text").isNotNull()).select("id", ratio_score(F.col("text"), query).alias("kw"), F.lit(0).alias("all"))
    placed = ranked_by_ranges(rows, ["all"], ["id"], "place").crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
    score = 0.8 * F.col("kw") + 0.2 * (1 - 0.5 * F.col("place") / F.col("total"))
    return top(placed.select("id", F.round(score, DIGITS).alias("score")), k)


def plain_fusion(df: DataFrame, query: str, query_vector: Sequence[float], k: int = 10) -> DataFrame:
    """Rank fusion without weights, top 2k of each side."""
    return fuse_ranks([(keyword(df, query, 2 * k, "ratio"), 1.0), (semantic(df, query_vector, 2 * k), 1.0)], k)


# What counts as an identifier in a query, and words that ask broadly.
ANCHORS = (r"(?<![A-Za-z0-9_])[A-Za-z]\d{1,3}(?![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])[A-Z]{2,3}\d{1,4}(?![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])\d{3,}(?![A-Za-z0-9_])", r"\"([^\"]+)\"")
BROAD = ("all", "every", "everything", "overview", "general", "list", "summary", "anything")


def anchor_terms(query: str) -> list[str]:
    """Identifiers and quoted phrases of a query, lower case, each once."""
    return list(dict.fromkeys(m.lower() for p in ANCHORS for m in re.findall(p, query)))


def specificity(query: str, anchors: Sequence[str]) -> float:
    """0 to 1: how narrow a query is, by its anchors, its few words, and no broad words."""
    words = [w for w in query.lower().split() if len(w) > 2]
    short = 0.2 if len(words) <= 3 else 0.1 if len(words) <= 6 else 0.0
    return min(1.0, max(0.0, min(0.5, 0.2 * len(anchors)) + short - (0.2 if any(w in BROAD for w in words) else 0.0)))


def anchor_boost(text: Column, anchors: Sequence[str]) -> Column:
    """Per anchor 0.4 if it stands before one of . : ) and 0.15 if it merely occurs."""
    low = F.lower(text)
    parts = [F.when(F.contains(low, F.lit(a + ".")) | F.contains(low, F.lit(a + ":")) | F.contains(low, F.lit(a + ")")), 0.4).when(F.contains(low, F.lit(a)), 0.15).otherwise(0.0) for a in anchors]
    return sum(parts, F.lit(0.0))


def adaptive(df: DataFrame, query: str, query_vector: Sequence[float], k: int = 10) -> DataFrame:
    """Hybrid whose keyword weight follows the query: more with anchors, less the more specific it is without; plus anchor_boost."""
    anchors = anchor_terms(query)
    weight = min(0.7, 0.3 + 0.2 * len(anchors)) if anchors else max(0.2, 0.5 - 0.3 * specificity(query, anchors))
    words = keyword(df, query, 3 * k, "ratio").select("id", F.col("score").alias("w"))
    near = semantic(df, query_vector, 3 * k).select("id", ((F.col("score") + 1) / 2).alias("s"))
    both = words.join(near, "id", "full_outer").join(df.select("id", "text"), "id", "left")
    score = weight * F.coalesce("w", F.lit(0.0)) + (1 - weight) * F.coalesce("s", F.lit(0.0)) + F.coalesce(anchor_boost(F.col("text"), anchors), F.lit(0.0))
    return top(both.select("id", F.round(score, DIGITS).alias("score")), k)


def boosted_keyword(df: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Share of terms plus anchor_boost over the 3k best keyword matches."""
    words = keyword(df, query, 3 * k, "ratio").join(df.select("id", "text"), "id")
    return top(words.select("id", F.round(F.col("score") + anchor_boost(F.col("text"), anchor_terms(query)), DIGITS).alias("score")), k)


def serve(df: DataFrame, query: str | None = None, query_vector: Sequence[float] | None = None, mode: str = "hybrid", k: int | None = None, alpha: float | None = None, profile: RetrievalProfile = RetrievalProfile(), filters=None) -> DataFrame:
    """One query by the given mode, defaults from the profile; hybrid without a vector falls back to keyword."""
    k, alpha = profile.top_k if k is None else k, profile.alpha if alpha is None else alpha
    RetrievalProfile(top_k=k, alpha=alpha, fusion=profile.fusion)
    filters = [*profile.filters, *(filters or [])]
    if mode not in profile.modes:
        raise ValueError(f"mode must be one of {', '.join(profile.modes)}")
    if mode == "semantic":
        if query_vector is None:
            raise ValueError("semantic search needs a vector")
        hits = semantic(df, query_vector, k, filters)
    elif mode == "keyword" or query_vector is None:
        hits = keyword(df, query or "", k, "frequency", filters)
    else:
        hits = hybrid(df, query or "", query_vector, k, alpha, profile.fusion, filters)
    return hits.join(df.select("id", "text"), "id", "left") if profile.include_text else hits


def search_many(df: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): share of terms for many queries (query_id, query), exact, ties by id.

    Texts and queries meet on their tokens (runs of letters and digits, lower case); the score is the
    share of the query's distinct tokens that the text has. Null texts and queries give no row, as do
    texts that share no token.

    A text with at least L of the m tokens of a query that occur at all has one of the m - L + 1
    rarest of them. So the texts that have the rarest tokens are scored first, as many tokens as give
    a few times k texts; the k-th of them gives L, and then only texts with one of so many rare tokens
    are scored. Frequent tokens, which nearly all texts have, are thus hardly ever joined.
    """
    token = lambda c: F.array_distinct(F.transform(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.xxhash64(t)))
    asked = durable(queries.where(F.col("query").isNotNull()).select("query_id", token(F.col("query")).alias("q")).where(F.size("q") > 0), "search-queries")
    docs = durable(df.where(F.col("text").isNotNull()).select("id", token(F.col("text")).alias("d")), "search-texts")
    wanted = asked.select(F.explode("q").alias("token")).distinct()
    posts = durable(docs.select("id", F.explode("d").alias("token")).join(wanted, "token", "left_semi"), "search-postings")
    often = posts.groupBy("token").agg(F.count("*").alias("df"))
    ranked = durable(
        asked.select("query_id", F.explode("q").alias("token")).join(often, "token").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("rare")).join(asked, "query_id"), "search-ranked"
    )  # the tokens of one query

    def scored(prefix: DataFrame) -> DataFrame:
        """(query_id, id, n, met) of all texts that have one of the tokens of ``prefix`` (query_id, token)."""
        pairs = posts.join(prefix, "token").select("query_id", "id").distinct()
        met = pairs.join(docs, "id").join(asked, "query_id")
        return met.select("query_id", "id", F.size("q").alias("n"), F.size(F.array_intersect("d", "q")).alias("met"))

    enough = F.aggregate("rare", F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("sum")), lambda a, t: F.when(a["sum"] >= 3 * k, a).otherwise(F.struct((a["at"] + 1).alias("at"), (a["sum"] + t["df"]).alias("sum"))), lambda a: a["at"])
    first = scored(ranked.select("query_id", F.explode(F.slice("rare", F.lit(1), enough)).alias("t")).select("query_id", "t.token"))
    by_met = W.partitionBy("query_id").orderBy(F.desc("met"), "id")
    least = first.withColumn("place", F.row_number().over(by_met)).where(F.col("place") == k).select("query_id", F.col("met").alias("least"))
    length = F.size("rare") - F.coalesce("least", F.lit(1)) + 1
    second = ranked.join(least, "query_id", "left").select("query_id", F.explode(F.slice("rare", F.lit(1), F.greatest(length, F.lit(1)))).alias("t")).select("query_id", "t.token")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    hits = scored(durable(second, "search-prefixes")).select("query_id", "id", F.round(F.col("met") / F.col("n"), DIGITS).alias("score"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_sources(hits: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with source_id, name, type and uri of their source; scores rounded to 4 digits. ``rows``: (id, source_id)."""
    one = sources.groupBy("source_id").agg(F.max(F.struct("source_name", "type", "uri")).alias("s")).select("source_id", "s.*")
    return hits.join(rows.select("id", "source_id"), "id", "left").join(one, "source_id", "left").withColumn("score", F.round("score", 4))


def assemble_context(hits: DataFrame, rows: DataFrame, separator: str = "\n\n---\n\n", numbered: bool = False) -> DataFrame:
    """One row ``context``: the hits' texts in the order of rank. Hits are k rows."""
    text = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text")) if numbered else F.col("text")
    ordered = hits.join(rows.select("id", "text"), "id").select("rank", text.alias("t"))
    return ordered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), separator).alias("context"))


def last_turns(turns: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The last n rows of every key."""
    return turns.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")
