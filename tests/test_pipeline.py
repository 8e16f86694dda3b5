import pytest
from pyspark.sql import functions as F

from textloom.operators import catalog, pipeline, retrieval
from textloom.schema import ChunkConfig, RetrievalProfile


def get(uri):
    pages = {
        "https://a.example/p": (200, "text/html", b"<main><p>" + b"A page about barns. " * 10 + b"</p></main>"), "https://a.example/t.txt": (200, "text/plain", b"plain"),
        "https://a.example/map.xml": (200, "application/xml", b"<urlset><url><loc>https://a.example/p</loc></url><url><loc> https://a.example/t.txt </loc></url></urlset>"), "https://a.example/busy": (503, "text/html", b""),
    }
    return pages[uri]


def test_source_texts_of_every_type(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.md").write_text("alpha")
    (tmp_path / "f" / "b.bin").write_text("no")
    (tmp_path / "d.pdf").write_bytes(b"%PDF " + b"words " * 20)
    rows = [("u", "url", "https://a.example/p"), ("t", "text", "https://a.example/t.txt"), ("m", "sitemap", "https://a.example/map.xml"), ("x", "url", "https://a.example/busy"), ("k", "url", "https://a.example/unknown"), ("f", "folder", str(tmp_path / "f")), ("p", "pdf", str(tmp_path / "d.pdf")), ("g", "folder", str(tmp_path / "gone")), ("n", "url", None)]
    due = spark.createDataFrame(rows, "source_id string, type string, uri string")
    got = {r["source_id"]: r for r in pipeline.source_texts(due, get, lambda b: b.decode()).collect()}
    assert got["u"]["text"].startswith("A page") and got["t"]["text"] == "plain" and got["m"]["text"].startswith("A page") and got["f"]["text"] == "alpha" and got["p"]["text"].startswith("%PDF")
    assert got["x"]["error"].startswith("status 503") and got["k"]["error"].startswith("KeyError") and got["g"]["error"] and set(got) == {"u", "t", "m", "x", "k", "f", "p", "g"}


def test_build_from_sources(spark, tmp_path):
    p = catalog.Project(spark, str(tmp_path), "one")
    p.add_sources([{"type": "url", "uri": "https://a.example/p"}, {"type": "sitemap", "uri": "https://a.example/map.xml"}])
    p.build(lambda due: pipeline.source_texts(due, get), lambda c: pipeline.embed_chunks(c, lambda ts: [[len(t), 1.0] for t in ts], "m"))
    assert p.read("chunks").count() == p.read("vectors").count() == 1  # both sources hold one page
    assert pipeline.list_projects(spark, str(tmp_path)) == ["one"] and pipeline.list_projects(spark, str(tmp_path / "no")) == []


def test_pipeline_and_debugging(spark):
    docs = spark.createDataFrame([("# Barns\n" + "red barn text. " * 20,), ("# Barns\n" + "red barn text. " * 20,), ("# Silos\n" + "grey silo text. " * 20,), (None,)], "text string")
    out = pipeline.run_pipeline(docs, cfg=ChunkConfig(strategy="fixed_chars", max_chars=200, overlap_chars=0), dim=16)
    n = out["chunks"].count()
    assert n == out["vectors"].count() == out["collection"].count() == 4
    rows = out["collection"].withColumn("source_id", F.col("doc_id"))
    vector = rows.first()["embedding"]
    d = pipeline.debug_query(rows, vector, 2, rows.limit(1).select("id"), preview=5)
    assert d["results"].count() == 2 and all(0 <= r["score"] <= 1 and len(r["preview"]) == 5 for r in d["results"].collect()) and d["comparison"].first()["n_expected"] == 1
    assert pipeline.index_stats(rows).first()["with_vector"] == 4
    hits = retrieval.keyword(rows, "text", 4)
    assert pipeline.rerank(hits, rows, lambda t: "silo" in t, 1).join(rows, "id").first()["text"].count("silo") > 0
    q = pipeline.example_questions(rows)
    assert len(q) == 4 and any("Barns" in x for x in q) and len(pipeline.example_questions(rows.limit(0))) == 4


def test_embedding_batches_and_profiles(spark):
    chunks = spark.createDataFrame([(f"c{i}", "x" * i) for i in range(7)] + [("n", None)], "chunk_id string, text string").coalesce(1)
    got = {r["chunk_id"]: r["embedding"] for r in pipeline.embed_chunks(chunks, lambda ts: [[len(t), len(ts)] for t in ts], "m", batch=3).collect()}
    assert got["c6"] == [6.0, 1.0] and got["c0"] == [0.0, 3.0] and "n" not in got
    with pytest.raises(Exception):
        pipeline.embed_chunks(chunks, lambda ts: [], "m").collect()
    p = RetrievalProfile(top_k=5, filters=(("lang", "eq", "en"),))
    assert pipeline.profile_from_json(pipeline.profile_json(p)) == p


def test_folders_are_read_by_one_scan(spark, tmp_path):
    from textloom.operators.pipeline import source_texts

    for name, n in (("one", 3), ("two", 2)):
        (tmp_path / name / "sub").mkdir(parents=True)
        for k in range(n):
            (tmp_path / name / "sub" / f"{k}.txt").write_text(f"{name} {k}")
    (tmp_path / "one" / "image.bin").write_bytes(b"\x00\x01")
    (tmp_path / "one" / "large.txt").write_text("x" * 2000)
    (tmp_path / "doc.pdf").write_bytes(b"%PDF-1.4 " + b"words " * 20)
    due = spark.createDataFrame([("a", "folder", str(tmp_path / "one")), ("b", "folder", str(tmp_path / "two")), ("c", "pdf", str(tmp_path / "doc.pdf")), ("d", "folder", str(tmp_path / "none")), ("e", "folder", str(tmp_path / "two"))], "source_id string, type string, uri string")
    got = source_texts(due, lambda u: (404, "", b""), pdf_reader=lambda b: b.decode(), max_files=2, max_file_bytes=1000).collect()
    rows = {(r["source_id"], r["part"]): (r["text"], r["error"]) for r in got}
    assert rows["a", 0][0] == "one 0" and rows["b", 1][0] == "two 1" and rows["e", 0][0] == "two 0" and rows["c", 0][0].startswith("%PDF")
    assert rows["d", 0] == (None, "no such path") and len(rows) == 8 and ("a", 2) not in rows
    assert source_texts(due.where("source_id = 'd'"), lambda u: (404, "", b"")).count() == 1


def test_traces_and_stats_of_projects(spark, tmp_path):
    from textloom.operators import catalog, pipeline

    rows = spark.createDataFrame([(i, "m" if i % 2 else "n", [float(i), 1.0]) for i in range(20)], "id int, model string, embedding array<float>")
    hits, trace = pipeline.traced_search(rows, [1.0, 0.0], 3, [("model", "eq", "m")])
    assert [(t["step"], t["name"], t["rows"]) for t in trace] == [(0, "collection", 20), (1, "filtered", 10), (2, "hits", 3)] and hits.count() == 3
    assert pipeline.project_stats(spark, str(tmp_path / "nothing")).count() == 0
    for name in ("x", "y"):
        catalog.Project(spark, str(tmp_path), name).add_sources([{"type": "url", "uri": f"https://{name}/1"}])
    assert {(r["project"], r["sources"], r["chunks"], r["builds"]) for r in pipeline.project_stats(spark, str(tmp_path)).collect()} == {("x", 1, 0, 1), ("y", 1, 0, 1)}
