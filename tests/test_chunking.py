import pytest

from textloom.operators.chunking import chunk_documents, chunk_project, covering_windows, fixed_windows, split_headings, split_hierarchical, split_paragraphs, split_recursive, split_sentences
from textloom.schema import ChunkConfig
from pyspark.sql import functions as F


def windows(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("w")).first()["w"]


def test_fixed_windows(spark):
    assert windows(spark, "abcdefghij", lambda c: fixed_windows(c, 4, 1)) == ["abcd", "defg", "ghij", "j"]
    assert windows(spark, "", lambda c: fixed_windows(c, 4, 1)) == []
    assert windows(spark, "é😀ab", lambda c: fixed_windows(c, 2, 0)) == ["é😀", "ab"]
    with pytest.raises(ValueError):
        fixed_windows(F.col("t"), 4, 4)


def test_covering_windows_end_at_the_end(spark):
    assert [(w["start"], w["text"]) for w in windows(spark, "abcdefghij", lambda c: covering_windows(c, 4, 1))] == [(0, "abcd"), (3, "defg"), (6, "ghij")]
    assert [w["text"] for w in windows(spark, "abc", lambda c: covering_windows(c, 4, 1))] == ["abc"]


CFG = ChunkConfig(max_chars=100, min_chars=50, overlap_chars=0)


def test_sentences_and_paragraphs_are_packed():
    s = ["A" * 40 + ".", "B" * 40 + "!", "C" * 40 + "?"]
    assert split_sentences(" ".join(s), CFG) == [f"{s[0]} {s[1]}", s[2]]
    p = ["a" * 45, "b" * 45, "c" * 120]
    assert split_paragraphs("\n\n\n".join(p), CFG) == [f"{p[0]}\n\n{p[1]}", p[2]]


def test_headings():
    text = "intro\n# One\nbody one\n## Empty\n# Two\n" + "x" * 90
    assert split_headings(text, CFG) == ["intro\n\n# One\nbody one", "# Two\n" + "x" * 90]


def test_recursive_keeps_all_words_and_respects_the_size():
    words = [f"w{i}" for i in range(400)]
    text = "\n\n".join(" ".join(words[i : i + 37]) for i in range(0, 400, 37))
    chunks = split_recursive(text, CFG)
    assert all(len(c) <= 100 for c in chunks) and " ".join(chunks).split() == words
    overlapped = split_recursive(text, ChunkConfig(max_chars=100, min_chars=50, overlap_chars=10))
    assert all(b.startswith(a[-10:]) for a, b in zip(chunks, overlapped[1:]))
    assert split_recursive("short", CFG) == ["short"]
    assert split_recursive("z" * 250, CFG) == ["z" * 100, "z" * 100, "z" * 50]


def test_recursive_small_pieces():
    text = "tiny\n\n" + "a" * 99 + "\n\n" + "b" * 99
    assert split_recursive(text, CFG)[0] == "tiny"
    assert split_recursive(text, ChunkConfig(max_chars=100, min_chars=50, overlap_chars=0, compat=True)) == ["a" * 99, "b" * 99]


def test_hierarchical():
    body = "b" * 60
    text = f"pre\n# A\n{body}\n## B\n{body}\n### Dropped\nx\n## C\n{body}\n# No body\n## D\n{body}\n"
    got = split_hierarchical(text, ChunkConfig(max_chars=1000, min_chars=50, parent_context_chars=5))
    assert [(c.split("\n")[0], lv, p, ctx) for c, lv, p, ctx in got] == [("pre", 0, -1, None), ("# A", 1, 0, "pre"), ("## B", 2, 1, "# A\nb"), ("## C", 2, 1, "# A\nb"), ("## D", 2, 1, "# A\nb")]


@pytest.mark.parametrize("strategy", ["fixed_chars", "recursive", "by_paragraph", "by_heading", "by_sentence", "by_page", "hierarchical"])
def test_documents_by_every_strategy(spark, strategy):
    rows = [(1, "# T\r\n" + "word " * 120 + "\n\n\n\n\n## U\n" + "second part. " * 30), (2, None), (3, ""), (4, "café\tend")]
    got = chunk_documents(spark.createDataFrame(rows, "n int, text string"), ChunkConfig(strategy=strategy, max_chars=200, min_chars=50, overlap_chars=20), keep=["n"]).collect()
    assert {r["n"] for r in got} == {1, 4}
    one = sorted((r for r in got if r["n"] == 1), key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in one] == list(range(len(one))) and one[0]["byte_start"] == 0
    assert all(a["byte_end"] == b["byte_start"] for a, b in zip(one, one[1:])) and len({r["chunk_id"] for r in one}) == len(one)
    assert [r["text"] for r in got if r["n"] == 4] == ["café    end"]
    ids = {r["chunk_id"] for r in one}
    assert all(r["parent_id"] is None or r["parent_id"] in ids for r in one)


def test_project_chunks_skip_repeats_and_history(spark):
    rows = [("s", 1, "a" * 10), ("s", 2, "a" * 10), ("t", 1, "b" * 10), ("u", 1, None), (None, 1, "c")]
    df = spark.createDataFrame(rows, "source string, part int, text string")
    first = chunk_project(df, "source", "part", size=10, overlap=0)
    assert {(r["source_id"], r["chunk_index"], r["text"]) for r in first.collect()} == {("s", 0, "a" * 10), ("t", 0, "b" * 10)}
    assert chunk_project(df, "source", "part", size=10, overlap=0, seen=first.where("source_id = 's'")).select("source_id").collect() == [("t",)]


def test_configuration_is_checked():
    for bad in ({"max_chars": 50}, {"strategy": "x"}, {"max_chars": 100, "overlap_chars": 150}, {"min_chars": 10}):
        with pytest.raises(ValueError):
            ChunkConfig(**bad)
