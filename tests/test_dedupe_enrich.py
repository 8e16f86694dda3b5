import random

from pyspark.sql import functions as F

from textloom.operators import dedupe, enrich


def test_exact(spark):
    rows = [("b", "x", 1), ("a", "x", 2), ("c", "y", 1), ("d", None, 1), ("e", None, 1), (None, "x", 1), ("a", "x", 2)]
    df = spark.createDataFrame(rows, "id string, t string, scope int")
    assert {r["id"]: r["kept_id"] for r in dedupe.exact(df, "id", "t").collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert {r["id"]: r["kept_id"] for r in dedupe.exact(df, "id", "t", "scope").collect()} == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "e"}
    assert [tuple(r) for r in dedupe.report(dedupe.exact(df, "id", "t")).collect()] == [("a", 1, "b", "b")]


def test_jaccard_equals_greedy_scan(spark):
    random.seed(2)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        words = random.sample(base, 30)
        for j in range(random.randint(1, 6)):
            edit = list(words)
            for _ in range(random.randint(0, 4)):
                edit[random.randrange(30)] = random.choice(base)
            rows.append((len(rows), " ".join(edit).upper() if j % 2 else " ".join(edit)))
    rows += [(100, None), (101, "  "), (102, rows[0][1])]
    kept, want = [], {}
    for i, t in rows:
        s = set((t or "").lower().split())
        if not s:
            continue
        near = [k for k, z in kept if len(s & z) >= 0.8 * len(s | z)]
        want[i] = not near
        if not near:
            kept.append((i, s))
    got = dedupe.jaccard(spark.createDataFrame(rows, "id int, t string"), "id", "t", 0.8).collect()
    assert {r["id"]: r["is_kept"] for r in got} == want
    assert all(want[r["kept_id"]] for r in got)
    assert dedupe.jaccard(spark.createDataFrame([], "id int, t string"), "id", "t").count() == 0


def test_jaccard_within_a_large_group_of_near_copies(spark):
    rows = [(i, " ".join(["same"] + [f"w{j}" for j in range(40)] + [f"own{i}"])) for i in range(400)]
    got = dedupe.jaccard(spark.createDataFrame(rows, "id int, t string"), "id", "t", 0.9)
    assert got.where("is_kept").count() == 1 and got.where("kept_id = 0").count() == 400


def test_jaccard_stores_no_tokens_but_prefixes(spark, monkeypatch):
    random.seed(5)
    rows = [(i, " ".join(random.sample([f"w{j}" for j in range(3000)], 200))) for i in range(300)]
    rows += [(300 + i, t + " more") for i, (_, t) in enumerate(rows[:20])]
    stored = []

    def durable(df, name="step"):
        out = kept(df, name)
        stored.append(sum(v or 0 for v in out.select(*[(F.size(c) if d.startswith("array") else F.lit(1)).alias(c) for c, d in df.dtypes]).groupBy().sum().first()))
        return out

    kept = dedupe.durable
    monkeypatch.setattr(dedupe, "durable", durable)
    for known in (10, 1_000_000):
        got = dedupe.jaccard(spark.createDataFrame(rows, "id int, t string"), "id", "t", known_tokens=known)
        assert {r["id"]: r["kept_id"] for r in got.collect() if not r["is_kept"]} == {300 + i: i for i in range(20)}
    assert max(stored) < 320 * 200 / 2


def test_minhash_groups(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(reversed(words))), (4, "too few words"), (5, None), (6, " ".join(words))]
    got = {r["id"]: r["group_id"] for r in dedupe.minhash(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 6: 1}


def test_minhash_compares_members_whose_hub_is_similar_to_neither(spark):
    template = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(40):  # texts of one template are 0.7 similar, each has one near-copy
        own = template + [f"own{i}x{j}" for j in range(20)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, "more"]))]
    got = {r["id"]: r["group_id"] for r in dedupe.minhash(spark.createDataFrame(rows, "id int, t string"), "id", "t", bands=4, rows_per_band=1).collect()}
    assert got == {k: k - k % 2 for k in range(80)}


def test_new_sources(spark):
    old = spark.createDataFrame([("url", "u1")], "type string, uri string")
    new = spark.createDataFrame([(0, "url", "u1"), (1, "url", "u2"), (2, "url", "u2"), (3, "pdf", "u1")], "position int, type string, uri string")
    assert [r["reason"] for r in dedupe.new_sources(new, old).orderBy("position").collect()] == ["already exists", "", "repeated in batch", ""]


def test_enrichment(spark):
    df = spark.createDataFrame([("The barn of the farm is in the north and it was red.",), ("Der Hof und die Scheune sind nicht alt.",), ("La casa de la plaza no es grande y el río",), ("记录队列公共仓库",), ("xyz",), (None,)], "t string")
    assert [r[0] for r in df.select(enrich.language(F.col("t"))).collect()] == ["en", "de", "es", "zh", "unknown", "unknown"]
    t = spark.createDataFrame([("In 2019 and 2020, 2019 again: RED-7",), ("none",)], "t string")
    assert [r[0] for r in t.select(enrich.regex_tags(F.col("t"), {"y": r"(20\d\d)", "c": r"RED-\d"})).collect()] == [["c:RED-7", "y:2019", "y:2020"], []]
    assert [r[0] for r in t.select(enrich.first_section(F.col("t"), [("a", "zzz"), ("b", "none")])).collect()] == [None, "b"]
    assert [r[0] for r in t.select(enrich.taxonomy_tags(F.col("t"), {"colour": ["red"], "no": ["NONE"]})).collect()] == [["colour"], ["no"]]
    e = t.select(enrich.regex_tags(F.col("t"), {"y": r"20\d\d"}).alias("tags"), enrich.first_section(F.col("t"), [("b", "none")]).alias("s"), F.lit("en").alias("l"))
    assert enrich.enrich_stats(e, "l", "tags", "s").first().asDict() == {"enriched": 2, "tagged": 1, "with_section": 1, "tags": 2, "languages": {"en": 2}}


def test_removal_of_long_chains_and_lists(spark):
    from textloom.operators import dedupe

    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(90)]  # each is like the next few only
    got = {r["id"]: r["is_kept"] for r in dedupe.jaccard(spark.createDataFrame(rows, "id int, t string"), "id", "t", 0.97).collect()}
    kept, want = [], {}
    sets = {i: set(t.split()) for i, t in rows}
    for i in range(90):
        want[i] = not any(len(sets[i] & sets[j]) >= 0.97 * len(sets[i] | sets[j]) - 1e-9 for j in kept)
        if want[i]:
            kept.append(i)
    assert got == want and len(kept) > 40
    marked = spark.createDataFrame([("a", "a", True), ("b", "a", False), ("c", "a", False), ("d", "a", False), ("e", "e", True)], "id string, kept_id string, is_kept boolean")
    assert [tuple(r) for r in dedupe.removed_lists(marked, 2).collect()] == [("a", 3, ["b", "c"])] and dedupe.removed_lists(marked.limit(0)).count() == 0
