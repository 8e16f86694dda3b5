import random

from textloom.functions.shingles import WORD
from textloom.llm.near_dup import group_pairs, near_duplicates
from textloom.llm.shared_spans import paragraph_links, removal_clusters, shared_shares, shared_spans, tuned_bands
from textloom.runtime import sieved

VOCABULARY = [f"word{i}" for i in range(500)]


def groups_by_brute_force(rows, words=3, threshold=0.6):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.lower()) if i is not None and t is not None else []
        if len(w) >= words:
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = random.choice(VOCABULARY)
    return words


def test_groups_equal_brute_force(spark):
    random.seed(1)
    rows = []
    for _ in range(25):
        base = random.choices(VOCABULARY, k=random.randint(30, 120))
        for _ in range(random.randint(1, 5)):
            base = edited(base, random.choice([0, 1, 3, 8]))
            rows.append((f"c{len(rows):03d}", " ".join(base).title()))
    rows += [("null", None), ("empty", ""), ("two", "only two"), (None, rows[0][1]), rows[3], ("same", rows[0][1].lower() + " !"), ("three", "just three words"), ("again", "JUST three, words")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "chunk_id string, text string, id int, fp int")
    want = groups_by_brute_force(rows)
    got = near_duplicates(df).collect()
    assert {r["id"]: r["group_id"] for r in got} == want and len(got) == len(want)
    pairs = {tuple(r) for r in group_pairs(near_duplicates(df)).collect()}
    assert pairs == {(a, b) for a in want for b in want if a < b and want[a] == want[b]}


def test_a_third_of_all_rows_in_one_group(spark):
    random.seed(3)
    base = random.choices(VOCABULARY, k=80)
    rows = [(i, " ".join(edited(base, 2))) for i in range(300)] + [(i, " ".join(random.choices(VOCABULARY, k=80))) for i in range(300, 900)]
    got = {r["id"]: r["group_id"] for r in near_duplicates(spark.createDataFrame(rows, "id int, text string"), id_col="id").collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[i] == i for i in range(300, 900))


def test_copies_behind_a_hub_that_is_like_neither_and_split_postings(spark):
    random.seed(5)
    common = random.choices(VOCABULARY, k=45)
    rows = []
    for i in range(120):  # a third shares most of one template, too little for a link; every tenth has a true near-copy
        own = common + random.choices(VOCABULARY, k=40)
        rows.append((i, " ".join(own)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(edited(own, 3))))
    rows += [(i, " ".join(random.choices(VOCABULARY, k=80))) for i in range(200, 440)]
    df = spark.createDataFrame(rows, "id int, text string")
    want = groups_by_brute_force(rows)
    assert sum(want[i] != i for i in want) >= 10
    for heavy in (500, 3):
        assert {r["id"]: r["group_id"] for r in near_duplicates(df, id_col="id", heavy=heavy).collect()} == want


def shuffled_by_job(spark, run):
    """MB that each job of ``run`` writes to shuffles, as on tables too large for broadcasts."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = lambda: [(j.jobId(), [j.stageIds().apply(k) for k in range(j.stageIds().size())]) for j in (store.jobsList(None).apply(n) for n in range(store.jobsList(None).size()))]
    before = {i for i, _ in jobs()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s: store.lastStageAttempt(s).shuffleWriteBytes() for i, ids in jobs() if i not in before for s in ids}
    return [sum(stages[s] for s in ids) / 1e6 for i, ids in jobs() if i not in before]


def test_texts_and_postings_that_nothing_shares_are_not_shuffled(spark):
    random.seed(8)
    rows = [(i, " ".join(str(random.randrange(10**6)) for _ in range(150))) for i in range(3000)]
    rows += [(3000 + i, t + " and more") for i, t in rows[:30]]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {}
    mb = shuffled_by_job(spark, lambda: got.update((r["id"], r["group_id"]) for r in near_duplicates(df, id_col="id").collect()))
    assert got == {i: i % 3000 for i, _ in rows}
    assert max(mb) < 0.8, sorted(mb)[-5:]


def test_sieved_rows_hold_all_that_a_join_finds(spark):
    big = spark.createDataFrame([(str(i), i) for i in range(5000)] + [(None, -1)], "k string, n int")
    for wanted in ([], ["7"], [str(i) for i in range(0, 5000, 50)]):
        small = spark.createDataFrame([(x,) for x in wanted], "k string")
        for bits in (64, 1 << 10, 1 << 27):
            got = sieved(big, small, "k", bits)
            assert got.columns == big.columns and set(wanted) <= {r["k"] for r in got.collect()}
        assert got.count() <= len(wanted) + 5000 / 8
    everything = spark.range(300_000)
    some = everything.where("id % 6 = 0")
    got = sieved(everything, some, "id")
    assert got.join(some, "id").count() == 50_000 and got.count() < 50_000 + 250_000 / 8


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "chunk_id string, text string")
    assert near_duplicates(df).count() == 0 and group_pairs(near_duplicates(df)).count() == 0


def spans_by_brute_force(rows, length):
    seen = {}
    for i, t in rows:
        for k in range(len(t or "") - length + 1):
            seen.setdefault(t[k : k + length], set()).add(i)
    out = set()
    for i, t in rows:
        if i is None:
            continue
        spans = []
        for k in range(len(t or "") - length + 1):
            if len(seen[t[k : k + length]] - {None}) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        out |= {(i, a, b) for a, b in spans}
    return out


def noise(n):
    return "".join(random.choice("abcdef gh\nä😀中") for _ in range(n))


def test_spans_equal_brute_force(spark):
    random.seed(5)
    shared = [noise(n) for n in (39, 40, 41, 90, 200)]
    rows = [(k, noise(random.randint(0, 60)) + random.choice(shared) + noise(random.randint(0, 30)) + random.choice(shared)[random.randint(0, 20) :] + noise(20)) for k in range(30)]
    rows += [(100, "x" * 300), (101, "y" + "x" * 120), (102, shared[4] * 3), (103, None), (104, ""), (105, noise(400)), (106, shared[3]), (107, "xyz" * 60), (108, "yzx" * 50)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, doc int")
    got = {tuple(r) for r in shared_spans(df, length=40, gram=16).collect()}
    assert got == spans_by_brute_force(rows, 40)
    share = {r["doc_id"]: r for r in shared_shares(df, length=40).collect()}
    assert share[106]["shared_share"] == 1.0 and share[105]["n_spans"] == 0 and share[104]["shared_share"] == 0.0 and 103 not in share


def test_repeats_within_one_document_are_not_shared(spark):
    random.seed(6)
    t = noise(100)
    df = spark.createDataFrame([(1, t + "-" + t), (2, noise(150)), (None, t)], "doc_id bigint, text string")
    assert shared_spans(df, length=40, gram=16).count() == 0
    assert shared_spans(df.limit(0)).count() == 0


def test_clusters(spark):
    random.seed(7)
    a, b = noise(60), noise(60)
    rows = [(1, noise(30) + a), (2, a + noise(5) + b), (3, b), (4, noise(90))]
    got = {r["doc_id"]: r["cluster_id"] for r in removal_clusters(spark.createDataFrame(rows, "doc_id bigint, text string"), length=40).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_bands_are_tuned_and_similar_paragraphs_tie_documents(spark):
    assert tuned_bands(1.0, 1.0, 1, 96) == (1, 96) and tuned_bands(0.8, 0.999) == (24, 4) and tuned_bands(0.6, 0.999)[1] < 4
    random.seed(11)
    para = [random.choices(VOCABULARY, k=60) for _ in range(8)]
    rows = [(1, "\n".join(" ".join(p) for p in para[:3])), (2, "Intro line here\n" + " ".join(edited(para[1], 1))), (3, " ".join(para[4])), (4, " ".join(edited(para[4], 20))), (5, None), (6, "short"), (7, " ".join(para[2]) + "\n" + " ".join(para[6])), (8, " ".join(para[6]).upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in paragraph_links(df).collect()} == {(1, 2), (1, 7), (7, 8)}
    got = {r["doc_id"]: r["cluster_id"] for r in removal_clusters(df, length=2000).collect()}
    assert got == {1: 1, 2: 1, 7: 1, 8: 1}
    assert removal_clusters(df.limit(0)).count() == 0
