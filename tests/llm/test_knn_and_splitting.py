import random

import numpy as np
import pytest

from textloom.llm.knn import collisions, design, nearest, search_list, similar_pairs, usable_vectors
from textloom.llm.splitting import block_starts, pack, pieces, split_blocks, split_oversized

SCHEMA = "chunk_id string, embedding array<float>, model string, created_at timestamp"


def clustered(n, dim=64, centres=40, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    x = c[rng.integers(0, centres, n)] + rng.standard_normal((n, dim)) * rng.uniform(0.1, 0.8, (n, 1))
    return x.astype(np.float32)


def exact(ids, x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {ids[i]: {ids[j] for j in np.argsort(-s[i], kind="stable")[:k]} for i in range(len(ids))}, s


def test_recall_against_brute_force(spark):
    import datetime

    x = clustered(3000)
    ids = [f"v{i:05d}" for i in range(len(x))]
    when = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, v.tolist(), "m", when) for i, v in zip(ids, x)], SCHEMA)
    want, sims = exact(ids, x, 10)
    got = {}
    for r in nearest(df, k=10).collect():
        got.setdefault(r["chunk_id"], set()).add(r["neighbour"])
        assert 1 <= r["rank"] <= 10
    recall = np.mean([len(got[i] & want[i]) / 10 for i in ids])
    assert recall >= 0.9 and all(len(g) == 10 for g in got.values())
    at = {i: k for k, i in enumerate(ids)}
    pairs = {tuple(r) for r in similar_pairs(nearest(df, k=10, least=0.8)).collect()}
    true = {tuple(sorted((a, b))) for a in ids for b in want[a] if sims[at[a], at[b]] >= 0.8}
    assert len(pairs & true) >= 0.95 * len(true) and len(pairs - true) <= 0.02 * len(true)


def test_long_lists_are_searched_in_windows(spark):
    import datetime

    x = clustered(900, centres=1)
    ids = [f"v{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), "m", datetime.datetime(2024, 1, 1)) for i, v in zip(ids, x)], SCHEMA)
    want, _ = exact(ids, x, 5)
    one = {tuple(r)[:2] for r in nearest(df, k=5, list_rows=10_000).collect()}
    many = {tuple(r)[:2] for r in nearest(df, k=5, list_rows=10_000, window=400).collect()}
    true = {(a, b) for a in ids for b in want[a]}
    assert len(one & true) >= 0.9 * len(true) and len(many & true) >= 0.8 * len(true)


def test_unusable_vectors_models_and_copies(spark):
    import datetime

    t0, t1 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    rng = np.random.default_rng(1)
    v = lambda: rng.standard_normal(64).tolist()
    a = v()
    rows = [("null", None, "m", t0), ("zero", [0.0] * 64, "m", t0), ("nan", [float("nan")] + a[1:], "m", t0), ("inf", [float("inf")] + a[1:], "m", t0), ("short", a[:10], "m", t0), ("hole", [None] + a[1:], "m", t0), (None, a, "m", t0), ("nomodel", a, None, t0)]
    rows += [("old", a, "m", t0), ("old", None, "m", t1), ("new", [0.0] * 64, "m", t0), ("new", a, "m", t1), ("new", a, "m", t1), ("other", a, "n", t0), ("notime", a, "m", None)]
    rows += [(f"copy{i:02d}", a, "m", t0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["chunk_id"] for r in usable_vectors(df).collect()} == {"new", "other", "notime"} | {f"copy{i:02d}" for i in range(20)}
    got = {}
    for r in nearest(df, k=10).orderBy("chunk_id", "rank").collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour"])
    assert got["notime"] == [f"copy{i:02d}" for i in range(10)] and got["copy00"] == [f"copy{i:02d}" for i in range(1, 11)] and "other" not in got
    assert nearest(df.limit(0)).count() == 0


def test_collisions_are_counted_once_and_in_the_first_shared_list():
    rng = np.random.default_rng(4)
    ends = np.sort(np.array([rng.choice(12, 4, replace=False) for _ in range(60)]), axis=1)
    ends = ends[(ends == 5).any(axis=1)]
    for settled in (12, 3):
        got = {(int(a), int(b)): int(c) for x in collisions(ends, 5, settled, rows=7) for a, b, c in zip(*x)}
        want = {}
        for a in range(len(ends)):
            for b in range(a + 1, len(ends)):
                both = set(ends[a]) & set(ends[b])
                if len(both) > 1 and min(both) >= min(5, settled):
                    want[a, b] = len(both) - 1
        assert got == want


def test_design_grows_with_the_collection():
    assert design(0)[0] >= 2 and design(10**5)[1] > design(10**3)[1] and design(10**6)[0] > design(10**5)[0] and design(10**12)[0] == 65_536


def test_search_of_nothing():
    q, d, s = search_list(np.empty(0, np.int64), np.empty((0, 64)), np.empty((0, 3), np.int32), 0, 3, np.empty(0, np.int32), 3, -1.0, 2)
    assert len(q) == len(d) == len(s) == 0


TEXT = "\n \nFirst line\nstill first\n\t\r\nSecond\n# Head\nunder head\f\fAfter feed\n```python\n\n# no heading\n\n```\nsame block\n~~~\n\nunclosed\n####### seven\n###### six\n"


def test_block_starts():
    starts = [a for a, _ in block_starts(TEXT)]
    assert [TEXT[a:].split("\n")[0].split("\f")[0] for a in starts] == ["First line", "Second", "# Head", "under head", "After feed", "unclosed", "###### six"]
    assert block_starts("") == [] and block_starts(" \n\t\n") == []
    assert [a for a, _ in block_starts("a\n````\n\n```\n\n````\n\nb")] == [0, 19]
    assert [a for a, _ in block_starts("```\nx\f\ny\n```\fnext\n```\nz\n```\nsame")] == [0, 13]


def test_packing_tiles_the_text():
    random.seed(0)
    parts = [random.choice(["# T\n", "## U\n", "\n\n", "word " * random.randint(1, 60), "长" * 50, "x" * 300, "Ends. Here! ", "\f", "- item\n", "```\na\n\nb\n```\n"]) for _ in range(400)]
    for limit in (50, 200, 1000):
        text = "".join(parts)
        got = pack(text, limit)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:])) and all(0 < b - a <= limit for a, b in got)
    assert pack("", 10) == [] and pack("abc", 10) == [(0, 3)] and pack(" " * 25, 10) == [(0, 10), (10, 20), (20, 25)]


def test_pieces_start_at_blocks_where_they_fit():
    text = "".join(f"# Section {i}\n" + "w" * 80 + "\n\n" + "v" * 80 + "\n\n" for i in range(10))
    starts = {a for a, _ in block_starts(text)}
    got = pieces(text, 400, 50)
    assert all(b - a <= 400 for a, b, _ in got) and all(a + r in starts for a, _, r in got) and [r for *_, r in got] == [0] + [50] * (len(got) - 1)
    assert "".join(text[a + r : b] for a, b, r in got) == text


def test_split_columns(spark):
    long = "para. " * 100 + "\n\n" + "more. " * 300
    rows = [("a", long, (0, 100, 5), "m"), ("a", long, (0, 100, 5), "m"), ("b", long, None, "m"), ("c", "short", (0, 0, 5), "m"), ("d", None, None, "m"), (None, long, None, "m")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, position struct<index:int,start_char:bigint,end_char:bigint>, id string")
    got = split_oversized(df).orderBy("id", "piece_no").collect()
    assert {r["id"] for r in got} == {"a", "b"}
    one = [r for r in got if r["id"] == "a"]
    assert "".join(r["text"][r["repeated"] :] for r in one) == long and all(len(r["text"]) <= 1500 and r["start_char"] == 100 + r["offset_start"] and r["text"] == long[r["offset_start"] : r["offset_end"]] for r in one)
    assert all(r["start_char"] is None for r in got if r["id"] == "b")
    assert sorted(tuple(r) for r in split_blocks(df).collect()) == [("a", 0), ("a", 602), ("b", 0), ("b", 602)]
    with pytest.raises(ValueError):
        split_oversized(df, limit=10, overlap=10)
    assert split_oversized(df.limit(0)).count() == 0
