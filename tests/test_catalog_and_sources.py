import datetime

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import extension_of_type, safe_url
from textloom.operators import catalog, index
from textloom.schema import BuildConfig
from textloom.sources import readers, writers
from textloom.streaming import ingest


def test_project_life(spark, tmp_path):
    p = catalog.Project(spark, str(tmp_path), "demo")
    items = [{"type": "url", "uri": "https://a/1"}, {"type": "url", "uri": "https://a/2"}, {"type": "url", "uri": "https://a/1"}]
    assert [r["reason"] for r in p.add_sources(items).collect()] == ["", "", "repeated in batch"]
    assert [r["reason"] for r in p.add_sources(items[:1]).collect()] == ["already exists"]
    texts = {"https://a/1": "one " * 600}

    def fetch(due):
        m = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
        return due.select("source_id", F.lit(0).alias("part"), F.element_at(m, F.col("uri")).alias("text"), F.when(F.element_at(m, F.col("uri")).isNull(), "not there").alias("error"))

    def embed(chunks):
        return chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), F.lit("m").alias("model"))

    assert p.build(fetch, embed, BuildConfig(dry_run=True)).count() == 2 and p.read("chunks").count() == 0
    assert {r["uri"]: r["status"] for r in p.build(fetch, embed).collect()} == {"https://a/1": "completed", "https://a/2": "failed"}
    n = p.read("chunks").count()
    assert n > 1 and p.read("vectors").count() == n
    texts["https://a/2"] = "two " * 600
    assert {r["uri"] for r in p.build(fetch, embed).collect()} == {"https://a/2"}  # failed sources are tried again, done ones aren't
    assert p.read("chunks").count() > n and catalog.progress(p.read("sources")).first()["done_share"] == 1.0
    dry = p.remove_sources(["https://a/1", "nowhere"])
    assert {(r["key"], r["found"]) for r in dry.collect()} == {("https://a/1", True), ("nowhere", False)} and p.read("sources").count() == 2
    p.remove_sources(["https://a/1"], confirm=True)
    assert p.read("sources").count() == 1 and p.read("vectors").count() == p.read("chunks").count() > 0
    assert not p.delete() and p.delete(confirm=True)
    with pytest.raises(ValueError):
        catalog.Project(spark, str(tmp_path), "../x")


def test_forced_builds_lose_nothing_and_renew_vectors(spark, tmp_path):
    p = catalog.Project(spark, str(tmp_path), "forced")
    p.add_sources([{"type": "url", "uri": f"https://a/{i}"} for i in range(3)])
    texts = {f"https://a/{i}": f"{i} " + " ".join(f"word{i}x{k}" for k in range(800)) for i in range(3)}

    def fetch(due):
        m = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
        return due.select("source_id", F.lit(0).alias("part"), F.element_at(m, F.col("uri")).alias("text"), F.lit(None).cast("string").alias("error"))

    def embed(chunks):
        return chunks.select("chunk_id", F.array(F.crc32(F.col("text")).cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit("m").alias("model"))

    def state():
        rows = p.read("chunks").join(p.read("vectors"), "chunk_id", "full_outer").select("chunk_id", "text", "embedding", F.crc32("text").cast("float").alias("crc")).collect()
        assert all(r["text"] is not None and r["embedding"][0] == r["crc"] for r in rows)
        return {(r["chunk_id"], r["text"]) for r in rows}

    p.build(fetch, embed)
    first = state()
    assert len(first) > 6
    p.build(fetch, embed, BuildConfig(force=True))
    assert state() == first
    texts["https://a/1"] = "changed " + texts["https://a/1"]
    p.build(fetch, embed, BuildConfig(force=True))
    second = state()
    assert len(second - first) > 0 and {c for c, _ in second} >= {c for c, _ in first}
    texts["https://a/2"] = None  # can't be fetched any more: what there was stays
    assert {r["uri"]: r["status"] for r in p.build(fetch, embed, BuildConfig(force=True)).collect()}["https://a/2"] == "failed"
    assert state() == second
    p.compact()
    assert state() == second and p.stats().first()["builds"] == 1

    def broken(due):
        raise OSError("no network")

    with pytest.raises(OSError):
        p.build(broken, embed, BuildConfig(force=True))
    assert state() == second and p.build_status() == "idle"


def test_builds_go_on_from_their_checkpoint(spark, tmp_path):
    p = catalog.Project(spark, str(tmp_path), "resumed")
    p.add_sources([{"type": "url", "uri": f"https://a/{i}"} for i in range(5)])
    fetch = lambda due: due.select("source_id", F.lit(0).alias("part"), F.concat(F.lit("text of "), "uri").alias("text"), F.lit(None).cast("string").alias("error"))
    p.build(fetch)
    seen = []
    for left in ("checkpoint_available", "checkpoint_available", "idle"):
        seen += [r["uri"] for r in p.build(fetch, cfg=BuildConfig(force=True, max_sources=2)).collect()]
        assert p.build_status() == left
    assert sorted(seen) == [f"https://a/{i}" for i in range(5)] and p.read("chunks").count() == 5
    assert not p.clear_checkpoint() and p.load_checkpoint().count() == 0


def test_run_log(spark, tmp_path):
    from datetime import datetime

    log = catalog.RunLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.get("a") is None
    t = [datetime(2024, 1, 1, 12, m) for m in range(10)]
    log.create({"x": {"y": 1}}, "a", t[0])
    with pytest.raises(ValueError):
        log.create({}, "a")
    assert log.ensure("a", {}) == "a" and log.get("a")["config_hash"] == catalog.config_hash({"x": {"y": 1}})
    log.phase("a", "chunk", now=t[1])
    log.phase("a", "chunk", "completed", 10, 30, 1, now=t[3])
    log.phase("a", "embed", "failed", 30, 0, 30, now=t[4])
    log.complete("a", "failed", t[5])
    log.complete("a", "completed", t[6])
    assert log.get("a")["status"] == "failed"
    assert {(r["phase"], r["status"], r["seconds"], r["outputs"]) for r in catalog.run_status(log.read()).collect()} == {("chunk", "completed", 120, 30), ("embed", "failed", 0, 0)}
    r = catalog.run_totals(log.read()).first()
    assert (r["phases"], r["seconds"], r["inputs"], r["outputs"], r["errors"]) == (2, 120, 40, 30, 31)
    with pytest.raises(KeyError):
        log.complete("b")
    with pytest.raises(ValueError):
        log.phase("a", "x", "odd")
    (tmp_path / "log" / "data" / "a").mkdir(parents=True)
    assert log.cleanup(30, datetime(2024, 6, 1)) == ["a"] and (tmp_path / "log" / "data" / "a").exists()
    log.cleanup(30, datetime(2024, 6, 1), dry_run=False)
    assert not (tmp_path / "log" / "data" / "a").exists() and log.get("a")


def test_lineage(spark):
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {r["change"]: r["n"] for r in catalog.run_diff(a, b, "k").collect()} == {"added": 1, "removed": 1, "unchanged": 1}
    assert catalog.config_hash({"a": {"x": 1, "y": 2}}) == catalog.config_hash({"a": {"y": 2, "x": 1}}) != catalog.config_hash({"a": {"x": 1, "y": 3}})
    day = datetime.datetime(2024, 1, 10)
    runs = spark.createDataFrame([("r1", "done", day), ("r2", "failed", day + datetime.timedelta(3))], "run_id string, status string, created_at timestamp")
    assert [r["run_id"] for r in catalog.list_runs(runs).collect()] == ["r2", "r1"]
    assert [r["run_id"] for r in catalog.list_runs(runs, status="done", before=day + datetime.timedelta(1)).collect()] == ["r1"]
    assert [r["run_id"] for r in catalog.cleanup(runs, 2, datetime.date(2024, 1, 14)).collect()] == ["r1"]


def test_upserts(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), spark.createDataFrame([("b", 2), ("c", 2), ("c", 3), (None, 9)], "id string, v int")
    rows = lambda m: {(r["id"], r["v"]) for r in index.upsert(old, new, mode=m).collect()}
    assert rows("upsert") == {("a", 1), ("b", 2), ("c", 3)} and rows("insert") == {("a", 1), ("b", 1), ("c", 3)} and rows("replace") == {("b", 2), ("c", 3)}
    assert index.upsert_counts(old, new).first().asDict() == {"inserted": 1, "updated": 1, "untouched": 1}


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.md", "alpha"), ("b.txt", "beta beta"), ("skip.md", "x"), ("big.md", "y" * 100)):
        (tmp_path / "in" / name).write_text(text)
    got = readers.folder(spark, str(tmp_path / "in"), "*.md", exclude=["skip"], max_bytes=50).collect()
    assert [(r["uri"].rsplit("/", 1)[1], r["size_bytes"], r["content_type"]) for r in got] == [("a.md", 5, "text/markdown")]
    assert len(readers.listing(spark, str(tmp_path / "in")).collect()) == 4
    (tmp_path / "map.xml").write_text("<urlset><url><loc>https://a/2</loc></url><url><loc> https://a/1 </loc></url><url><loc>https://a/no</loc></url></urlset>")
    assert [r["uri"] for r in readers.site_map(spark, str(tmp_path / "map.xml"), include=["a/"], exclude=["no$"]).collect()] == ["https://a/1", "https://a/2"]
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "rows.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_fetching(spark):
    def get(uri):
        if uri.endswith("boom"):
            raise OSError("no answer")
        return (503, "text/html", b"x") if uri.endswith("busy") else (200, "text/html", b"hello")

    urls = spark.createDataFrame([("https://ok.example/a",), ("https://ok.example/busy",), ("https://ok.example/boom",), ("http://localhost/x",), ("ftp://ok.example/a",), ("https://else.example/a",)], "uri string")
    got = {r["uri"].rsplit("/", 1)[1]: r for r in readers.fetch(urls, get, allowed=["ok.example"]).collect()}
    assert set(got) == {"a", "busy", "boom"} and bytes(got["a"]["body"]) == b"hello" and got["busy"]["error"] == "status 503, try again" and got["boom"]["error"].startswith("OSError")
    assert [r[0] for r in urls.select(safe_url(F.col("uri"))).collect()] == [True, True, True, False, False, True]
    kinds = spark.createDataFrame([("text/html; charset=x",), ("image/x",), (None,)], "t string")
    assert [r[0] for r in kinds.select(extension_of_type(F.col("t"))).collect()] == ["html", "bin", "bin"]


def test_writers_and_streams(spark, tmp_path):
    chunks = spark.createDataFrame([("d2", 1), ("d1", 2), ("d1", 0)], "doc_id string, chunk_index int")
    writers.ordered_chunks(chunks, str(tmp_path / "c"), 2)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3
    writers.event_log(spark, str(tmp_path / "log"), "error", "build", "fetch", "no answer")
    assert readers.events(spark, str(tmp_path / "log"), "error").count() == 1
    (tmp_path / "docs").mkdir()
    schema = "doc_id bigint, text string"
    for k, rows in enumerate(([(1, "a"), (2, "a"), (3, None)], [(4, "a\r\nb"), (5, "a"), (6, "a\nb")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        ingest.ingest_new(ingest.file_stream(spark, str(tmp_path / "docs"), "*.parquet", schema), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4]


def test_ingest_of_a_table_of_several_files(spark, tmp_path):
    import __spark_entry__ as entry
    from tests.oracle import difference

    table = tmp_path / "documents.parquet"
    for rows in ([(5, "a"), (6, "b"), (None, "e")], [(2, "a"), (9, "b\r\nb")], [(3, "a"), (4, "b\nb"), (7, None), (8, "e")]):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(table))
    got = entry.queries()["ingest_stream"](spark, str(tmp_path))
    assert difference(got, entry.oracle_sql()["ingest_stream"], str(tmp_path)) == ""


def test_bodies_in_pieces_are_read_no_further_than_allowed(spark):
    from textloom.sources import readers

    def get(uri):
        def pieces():
            for k in range(10):
                if k > 5:
                    raise AssertionError("read too far")
                yield b"x" * 100

        return (200, "text/plain", pieces()) if uri.endswith("big") else (200, "text/plain", iter([b"a", b"b"])) if uri.endswith("small") else (200, "text/plain", b"whole")

    urls = spark.createDataFrame([("https://a.example/big",), ("https://a.example/small",), ("https://a.example/plain",)], "uri string")
    got = {r["uri"].rsplit("/", 1)[1]: r for r in readers.fetch(urls, get, max_bytes=450, per_task=1).collect()}
    assert got["big"]["error"] == "too large" and got["big"]["body"] is None
    assert bytes(got["small"]["body"]) == b"ab" and bytes(got["plain"]["body"]) == b"whole"
    late = readers.fetch(urls.where("uri like '%small'"), get, seconds=-1.0).first()
    assert late["error"].startswith("TimeoutError")
    assert readers.fetch(urls.limit(0), get).count() == 0
