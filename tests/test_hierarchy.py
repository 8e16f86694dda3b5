import random

import pytest
from pyspark.sql import functions as F

from textloom.operators.components import connected_components
from textloom.operators.hierarchy import descendant_counts, descendants, hierarchy


def brute(rows):
    """(id, parent, time) by walking up one node at a time."""
    best, up = {}, {}
    for n, p, t in rows:
        if n is None or not n.strip():
            continue
        n, p = n.strip().lower(), None if p is None or not p.strip() else p.strip().lower()
        if n not in best or (t, p or "") > best[n]:
            best[n], up[n] = (t, p or ""), p
    up = {n: p if p in up else None for n, p in up.items()}
    out = {}
    for n in up:
        path, seen, x = [n], {n}, up[n]
        while x is not None and x not in seen:
            path.append(x)
            seen.add(x)
            x = up[x]
        out[n] = (path[-1], len(path) - 1, " > ".join(reversed(path))) if x is None else (None, -1 if x == n else -2, None)
    return out


def solved(df, **kw):
    return {r["node"]: (r["root"], r["depth"], r["path"]) for r in hierarchy(df, "id", "p", ["k"], ["t"], True, **kw).collect()}


@pytest.mark.parametrize("fragment", [9, 60, 1000])
def test_random_forest_with_loops_equals_walking_up(spark, fragment):
    random.seed(fragment)
    rows = []
    for i in range(300):
        r = random.random()
        p = None if r < 0.05 else f"n{max(0, i - random.randint(0, 3))}" if r < 0.9 else f"n{random.randrange(300)}"
        rows.append((f"N{i} ", p, 1))
    df = spark.createDataFrame([(a, b, t, i) for i, (a, b, t) in enumerate(rows)], "id string, p string, t int, k int")
    assert solved(df, rows_per_fragment=fragment, shrink=3) == brute(rows)


def test_chain_across_all_fragments_and_global_loop(spark):
    rows = [(f"c{i:03d}", f"c{i - 1:03d}" if i else None, 1) for i in range(120)]
    rows += [(f"l{i:03d}", f"l{(i + 1) % 90:03d}", 1) for i in range(90)] + [("into", "l040", 1), ("self", "self", 1)]
    df = spark.createDataFrame([(a, b, t, i) for i, (a, b, t) in enumerate(rows)], "id string, p string, t int, k int")
    got = solved(df, rows_per_fragment=10, shrink=2)
    assert got == brute(rows)
    assert got["l000"][1] == -1 and got["into"][1] == -2 and got["self"][1] == -1 and got["c119"][1] == 119


def test_nulls_blanks_missing_parents_and_older_rows(spark):
    rows = [("A", None, 1), (" b", "a ", 1), ("B", "zzz", 0), ("c", " ", 2), ("d", "nowhere", 1), (None, "a", 1), ("", "a", 1), ("e", "B", 1), ("e", "B", 1)]
    df = spark.createDataFrame([(a, b, t, 0, "x", "y") for a, b, t in rows], "id string, p string, t int, k int, node string, parent string")
    assert solved(df) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, p string, t int, k int")
    assert solved(df) == {}


def test_descendants(spark):
    rows = [("r", None), ("a", "r"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x")]
    f = hierarchy(spark.createDataFrame(rows, "id string, p string"), "id", "p", with_path=True)
    assert {tuple(r) for r in descendants(f).collect()} == {("r", "a", 1), ("r", "b", 2), ("r", "c", 2), ("a", "b", 1), ("a", "c", 1)}
    assert {r["node"]: (r["n_descendants"], r["n_children"]) for r in descendant_counts(f).collect()} == {"r": (3, 1), "a": (2, 2), "b": (0, 0), "c": (0, 0), "x": (0, 0), "y": (0, 0)}


def test_components(spark):
    random.seed(4)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900), (None, 3), (3, None)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {n: find(n) for n in list(label)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    star = spark.range(3000).select(F.lit(0).cast("bigint").alias("u"), F.col("id").alias("v"))
    assert connected_components(star).agg(F.max("component")).first()[0] == 0


def test_ranks_of_a_hot_key(spark):
    from textloom.operators.ranking import ranked_by_ranges

    rows = [("hot", i * 7 % 1000) for i in range(1000)] + [("b", 5), ("b", 2), (None, 9), (None, 1)]
    got = ranked_by_ranges(spark.createDataFrame(rows, "k string, v int").repartition(7), ["k"], ["v"], "place", 6).collect()
    assert sorted(r["place"] for r in got if r["k"] == "hot") == list(range(1000)) and all(r["place"] == r["v"] for r in got if r["k"] == "hot")
    assert {(r["k"], r["v"], r["place"]) for r in got if r["k"] != "hot"} == {("b", 2, 0), ("b", 5, 1), (None, 1, 0), (None, 9, 1)}


def test_sizes_and_odd_names_across_fragments(spark):
    rng = random.Random(7)
    rows = [(f"n{i:03d}", f"n{rng.randrange(i):03d}" if i and rng.random() < 0.97 else None) for i in range(400)]
    rows += [("a > x", None), ("b > y", "a > x"), ("loop1", "loop2"), ("loop2", "loop1"), ("into", "loop1")]
    up = dict(rows)
    want = {n: 0 for n in up}
    for n in up:
        x, seen = up[n], {n}
        while x is not None and x not in seen:
            seen.add(x)
            x = up[x]
        if x is None:
            x = up[n]
            while x is not None:
                want[x] += 1
                x = up[x]
    f = hierarchy(spark.createDataFrame(rows, "id string, p string"), "id", "p", with_path=True, rows_per_fragment=30, shrink=2)
    pairs = descendants(f).collect()
    assert ("a > x", "b > y", 1) in {tuple(r) for r in pairs}
    got = {r["node"]: r["n_descendants"] for r in descendant_counts(f, rows_per_fragment=25, shrink=2).collect()}
    assert got == want and sum(got.values()) == len(pairs)
