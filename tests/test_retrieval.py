import pytest
from pyspark.sql import functions as F

from textloom.functions.vectors import cosine, l2_normalize, local_embedding, mock_embedding, seeded_vector
from textloom.operators import context, diagnostics, retrieval
from textloom.operators.classify import classify
from textloom.plans import search
from textloom.schema import ExpandConfig, RetrievalProfile

ROWS = [("a", "red barn. red", [1.0, 0.0], "x"), ("b", "blue barn", [0.0, 1.0], "y"), ("c", "green", [1.0, 1.0], "x"), ("d", None, None, "x"), ("e", "red barn. red", [1.0, 0.0], None), ("f", "", [0.0, 0.0], "x")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, text string, embedding array<double>, tag string")


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_semantic_breaks_ties_by_id_and_filters_first(rows):
    assert ids(retrieval.semantic(rows, [1, 0], 3)) == ["a", "e", "c"]
    assert ids(retrieval.semantic(rows, [1, 0], 2, [("tag", "eq", "x")])) == ["a", "c"]
    assert ids(retrieval.semantic(rows.limit(0), [1, 0], 3)) == []


def test_keyword(rows):
    assert ids(retrieval.keyword(rows, "Red barn")) == ["a", "e", "b"]
    assert ids(retrieval.keyword(rows, "red (barn", scoring="ratio")) == ["a", "e"]
    assert len(ids(retrieval.keyword(rows, "red", scoring="ratio", keep_zeros=True))) == 5


def test_fusion(rows):
    got = retrieval.hybrid(rows, "red barn", [1, 0], 3).collect()
    assert got[0]["id"] == "a" and got[0]["score"] == pytest.approx(1 / 61, abs=1e-8)
    assert ids(retrieval.chat_fusion(rows, "blue", None, 3)) == ["b"]
    assert ids(retrieval.mock_semantic(rows, "blue", 2)) == ["b", "a"]
    assert ids(retrieval.plain_fusion(rows, "blue", [0, 1], 1)) == ["b"]


def test_serving_falls_back_and_checks(rows):
    assert ids(retrieval.serve(rows, "red", mode="hybrid", k=1)) == ["a"]
    with pytest.raises(ValueError):
        retrieval.serve(rows, mode="semantic")
    with pytest.raises(ValueError):
        retrieval.serve(rows, "x", k=1000)
    assert "text" not in retrieval.serve(rows, "red", profile=RetrievalProfile(include_text=False)).columns


def test_filters(rows):
    n = lambda *f: rows.where(retrieval.predicate(*f)).count()
    assert (n("tag", "eq", "x"), n("tag", "neq", "x"), n("tag", "in", ["x", "y"]), n("text", "contains", "barn"), n("embedding", "has", 0.0)) == (4, 1, 5, 3, 4)
    assert (n("id", "gt", "c"), n("id", "gte", "c"), n("id", "lt", "c"), n("id", "lte", "c")) == (3, 4, 2, 3)
    with pytest.raises(ValueError):
        retrieval.predicate("tag", "like", "x")


def test_anchors(rows):
    assert retrieval.anchor_terms('rule A12 and ABC123 in 2024, "exact words"') == ["a12", "abc123", "2024", "exact words"]
    assert retrieval.specificity("list all", []) == 0.0 and retrieval.specificity("A12 B34", ["a12", "b34"]) > 0.5
    assert ids(retrieval.boosted_keyword(rows, '"red barn"', 2)) == []
    assert ids(retrieval.adaptive(rows, "blue barn", [0, 1], 1)) == ["b"]


def test_many_queries_at_once(spark, rows):
    q = spark.createDataFrame([(1, "Blue barn"), (2, "green?"), (3, None), (4, "nothing")], "query_id int, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.search_many(rows, q, 2).collect()}
    assert got == {(1, "b"): 1.0, (1, "a"): 0.5, (2, "c"): 1.0}


def test_every_hundredth_document_is_a_query(spark, tmp_path):
    rows = [(i, f"word{i} common", None if i == 100 else "?" if i == 200 else f"Word{i + 1}") for i in range(401)]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string").write.parquet(str(tmp_path / "documents.parquet"))
    hits = search.search_documents(spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["id"], r["score"]) for r in hits if r["rank"] == 1} == {(0, 1, 1.0), (100, 100, 1.0), (200, 200, 1.0), (300, 301, 1.0)}
    assert sum(r["query_id"] == 100 for r in hits) == 10


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(F.round(cosine(F.col("a"), F.col("b")), 9)).collect()] == [1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(l2_normalize(F.col("a"))).collect()] == [[0.6, 0.8], [0.0, 0.0], [1.0]]
    t = spark.createDataFrame([("é",), ("",)], "t string")
    assert [r[0] for r in t.select(local_embedding(F.col("t"), 3)).collect()] == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    v = t.select(mock_embedding(8)("t").alias("v")).first()["v"]
    assert v == list(seeded_vector("é", 8)) and sum(x * x for x in v) == pytest.approx(1)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d", f"c{i}", i, f"C{i // 2}" if i else None, 0, f"text {i}") for i in range(7)] + [("z", "other", 0, "gone", 0, "t")]
    return spark.createDataFrame(rows, "doc_id string, chunk_id string, chunk_index int, parent_id string, level int, text string")


def test_context(spark, chunks):
    hits = spark.createDataFrame([("c3",), ("c4",), ("other",)], "id string")
    near = {(r["hit_id"], r["chunk_id"], r["distance"]) for r in context.neighbours(chunks, hits, 1, 1).collect()}
    assert near == {("c3", "c2", -1), ("c3", "c4", 1), ("c4", "c3", -1), ("c4", "c5", 1)}
    one = spark.createDataFrame([("c3",)], "id string")
    got = sorted((r["role"], r["chunk_id"]) for r in context.hydrate(chunks, one, ExpandConfig(2, 2, True, 4)).collect())
    assert got == [("after", "c4"), ("after", "c5"), ("before", "c2"), ("parent", "c1")]
    assert sorted(r["role"] for r in context.hydrate(chunks, one, ExpandConfig(2, 2, True, 1)).collect()) == ["parent"]
    assert [(r["chunk_id"], r["distance"]) for r in context.parent_chains(chunks, spark.createDataFrame([("c6",)], "id string")).orderBy("distance").collect()] == [("c3", 1), ("c1", 2), ("c0", 3)]


def test_parent_chains_reach_the_root_and_end_at_loops(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(17)] + [("a", "b"), ("b", "a")]
    deep = spark.createDataFrame(rows, "chunk_id string, parent_id string")
    got = {(r["hit_id"], r["chunk_id"], r["distance"]) for r in context.parent_chains(deep, spark.createDataFrame([("n16",), ("a",)], "id string")).collect()}
    assert got == {("n16", f"n{16 - d}", d) for d in range(1, 17)} | {("a", "b", 1)}


def test_diagnostics(spark):
    hits = spark.createDataFrame([("a", 1, 0.9), ("b", 2, 0.7), ("c", 3, 0.2), ("d", 4, 0.1)], "id string, rank int, score double")
    got = diagnostics.compare(hits, spark.createDataFrame([("a",), ("x",), ("a",)], "id string")).first().asDict()
    assert got == {"n_expected": 2, "n_found": 1, "missing": 1, "unexpected": 3, "precision": 0.25, "recall": 0.5}
    stats = diagnostics.diagnose(diagnostics.score_statistics(hits)).first()
    assert stats["upper_median"] == 0.7 and stats["finding"] == "ok" and "top_k" in stats["advice"]
    none = diagnostics.diagnose(diagnostics.score_statistics(hits.limit(0))).first()
    assert none["n"] == 0 and none["finding"] == "no results"
    q = spark.createDataFrame([("g", 0.9), ("g", 0.8), ("m", 0.55), ("p", 0.1)], "k string, score double")
    assert {r["k"]: r["quality"] for r in diagnostics.assess(q, ["k"]).collect()} == {"g": "excellent", "m": "marginal", "p": "poor"}


def test_classification(spark):
    cases = {"hello": ("conversational", False), "How do I install the scorer?": ("procedural", True), "where is the index manual": ("navigational", True), "why do shards split": ("conceptual", True), "what is a shard": ("factual", False), "2 + 2": ("conversational", False), "call parse_rows() twice": ("factual", True), "": ("conversational", False)}
    got = spark.createDataFrame([(q,) for q in cases], "q string").select("q", classify(F.col("q")).alias("c")).collect()
    assert {r["q"]: (r["c"]["type"], r["c"]["needs_retrieval"]) for r in got} == cases
    by = {r["q"]: r["c"] for r in got}
    assert by["call parse_rows() twice"]["mode"] == "keyword" and by["hello"]["top_k"] is None and by["How do I install the scorer?"]["subtype"] is None
    assert spark.createDataFrame([(None,)], "q string").select(classify(F.col("q"), F.lit("farming"))["confidence"]).first()[0] == 0.75


def test_stored_collections_are_built_again_once_cleared(spark):
    from pathlib import Path

    import pytest

    from textloom.plans import search
    from textloom.runtime import clear

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test data")
    one = search.rows(spark, folder)
    assert search.rows(spark, folder) is one
    n = one.count()
    clear(spark)
    assert search.rows(spark, folder).count() == n


def test_many_queries_equal_brute_force(spark):
    import random
    import re

    from textloom.operators import retrieval

    rng = random.Random(3)
    words = ["the", "of", "and"] + [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choices(words, [40, 30, 20] + [1] * 60, k=n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(300)] + [(900, None), (901, ""), (902, "lonely")]
    asked = [(f"q{i}", text(rng.randint(1, 8))) for i in range(40)] + [("none", None), ("odd", "zzz unknown"), ("empty", " .. "), ("one", "Lonely, THE unknown")]
    tokens = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    want = set()
    for q, t in asked:
        qs = tokens(t) if t else set()
        hits = sorted((-round(len(qs & tokens(d)) / len(qs), 9), i) for i, d in docs if d and qs & tokens(d)) if qs else []
        want |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(hits[:5])}
    got = retrieval.search_many(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(asked, "query_id string, query string"), 5)
    assert {tuple(r) for r in got.collect()} == want
    assert retrieval.search_many(spark.createDataFrame([], "id int, text string"), spark.createDataFrame(asked, "query_id string, query string")).count() == 0
