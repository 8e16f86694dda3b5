import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm.mixing import flight, land, mix, mix_report, shares_of
from textloom.llm.packing import fill_report, nnls, pack, patterns, plan
from textloom.llm.tokens import VOCABULARY, encoding

from pathlib import Path

needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")


def test_patterns_and_least_squares():
    assert patterns(4, 2) == [(4,), (3, 1), (2, 2)] and len(patterns(6, 6)) == 11 and all(sum(p) == 12 for p in patterns(12, 4))
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 8)), np.array([0, 3, 0, 1, 5, 0, 2, 0.5])
    assert np.allclose(a @ nnls(a, a @ x, 20_000), a @ x, atol=1e-2)


@pytest.mark.parametrize("capacity,count", [(64, 500), (512, 5000), (2048, 20_000)])
def test_plans_use_every_item_once_and_fill_well(capacity, count):
    rng = np.random.default_rng(capacity)
    h = Counter(int(x) for x in np.clip(rng.lognormal(np.log(capacity / 5), 0.9, count), 1, capacity - 1))
    p = plan(dict(h), capacity)
    used = Counter()
    for lengths, times in p:
        assert sum(lengths) <= capacity and times > 0
        for n in lengths:
            used[n] += times
    assert used == h and len(p) <= capacity + 3500
    assert sum(k * v for k, v in h.items()) / (capacity * sum(t for _, t in p)) > 0.97


def test_plans_of_extremes():
    assert plan({}, 64) == [] and plan({5: 1}, 64) == [((5,), 1)]
    assert sum(t for _, t in plan({40: 1000}, 64)) == 1000 and sum(t for _, t in plan({32: 1000}, 64)) == 500
    assert sum(t for _, t in plan({1: 6400}, 64)) == 100


@needs_vocabulary
def test_packing_texts(spark):
    random.seed(1)
    rows = [(i, " ".join(random.choices(["barn", "silo", "ledger", "x1"], k=random.randint(1, 120)))) for i in range(400)]
    rows += [(900, "barn " * 700), (901, None), (902, ""), (903, "<|endoftext|> is text"), (None, "x"), (5, "twin of five")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, rank int").repartition(5)
    got = pack(df, capacity=128).collect()
    size = {i: len(encoding().encode_ordinary(t)) for i, t in rows if t}
    per = Counter()
    for r in got:
        if r["container_id"] is not None:
            per[r["container_id"]] += r["n_tokens"]
        assert r["token_end"] - r["token_start"] == r["n_tokens"]
    assert max(per.values()) <= 128 and sum(per.values()) == sum(len(encoding().encode_ordinary(t)) for i, t in rows if t and i is not None)
    assert {r["doc_id"] for r in got} == {i for i, _ in rows if i is not None}
    big = sorted((r["piece"], r["token_start"], r["n_tokens"]) for r in got if r["doc_id"] == 900)
    assert [n for *_, n in big[:-1]] == [128] * (size[900] // 128) and big[-1][2] == size[900] % 128
    assert all(r["piece"] == 0 for r in got if size.get(r["doc_id"], 0) <= 128) and [r["container_id"] for r in got if r["doc_id"] in (901, 902)] == [None, None]
    report = fill_report(pack(df, capacity=128), 128).first()
    assert report["containers"] == len(per) and report["fullest"] <= 128 and report["used_share"] > 0.97
    assert pack(df.limit(0)).count() == 0 and fill_report(pack(df.limit(0))).first()["containers"] == 0
    with pytest.raises(ValueError):
        pack(df, capacity=10)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 2000):
        p, s = rng.random(n), rng.integers(1, 3000, n).astype(float)
        q = flight(p, s, 1)
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * s).sum() - (p * s).sum()) < 1e-3
    equal = flight(np.full(100, 0.3), np.ones(100), 1)
    assert abs(equal.sum() - 30) < 1e-6
    p, s = np.full(300, 0.37), np.r_[9000.0, rng.integers(50, 900, 299)]
    landed = land(p, s, 1)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs((landed * s).sum() - (p * s).sum()) < 5
    assert len(land(np.empty(0), np.empty(0), 1)) == 0


def test_flight_is_fair():
    rng = np.random.default_rng(3)
    p, s = rng.uniform(0.1, 0.9, 12), rng.integers(1, 100, 12).astype(float)
    mean = np.mean([flight(p, s, k) for k in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_landing_is_fair_to_large_units():
    rng = np.random.default_rng(6)
    p, s = rng.uniform(0.2, 0.8, 30), np.r_[2500.0, 1800.0, rng.integers(20, 400, 28)]
    got = np.array([land(p, s, k) for k in range(600)])
    assert np.abs(got.mean(axis=0) - p).max() < 0.08 and abs(got.mean(axis=0) - p).mean() < 0.025
    assert np.median(np.abs(got @ s - p @ s)) < 5


def test_shares_are_solved_for():
    targets = {"a": (0.5, 2.0), "b": (0.3, float("inf")), "c": (0.2, 3.0)}
    supply = {"a": 1000, "b": 100, "c": 20}
    plain, filled = shares_of(targets, supply, 1000, False), shares_of(targets, supply, 1000, True)
    assert plain == {"a": 500, "b": 300, "c": 60}
    assert filled["c"] == 60 and abs(sum(filled.values()) - 1000) < 1e-6 and abs(filled["a"] / filled["b"] - 5 / 3) < 1e-9
    assert shares_of({"a": (1.0, 1.0)}, {"a": 10}, 1000, True) == {"a": 10} and shares_of({}, {}, 0, True) == {}


def test_packing_plans_come_from_the_fit():
    rng = np.random.default_rng(8)
    h = Counter(int(x) for x in np.clip(rng.lognormal(np.log(300), 0.9, 20_000), 1, 2047))
    cl = np.zeros(33)
    for n, c in h.items():
        cl[min(32, max(1, round(n / 64)))] += c
    shapes = patterns(32, 8)
    a = np.zeros((32, len(shapes)))
    for k, shape in enumerate(shapes):
        for u in shape:
            a[u - 1, k] += 1
    x = nnls(a, cl[1:])
    assert (x > 0).sum() <= 32 and np.floor(x).sum() >= 0.9 * sum(t for _, t in plan(dict(h), 2048))


@needs_vocabulary
def test_mixing(spark):
    random.seed(4)
    text = lambda: " ".join(random.choices(["barn", "silo", "ledger", "goblin"], k=random.randint(5, 90)))
    rows = [(i, text(), random.choice(["Big_Source", "big-source ", "BIG SOURCE"])) for i in range(600)] + [(1000 + i, text(), "small") for i in range(60)] + [(2000, text(), "tiny"), (3000, None, "small"), (3001, text(), None), (3002, text(), "untargeted"), (None, text(), "small"), (5, text(), "big-source")]
    df = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows], "doc_id bigint, text string, source string, p double").repartition(6)
    targets = spark.createDataFrame([("big-source", 0.5, 2), ("small", 0.45, 8), ("tiny", 0.04, 3), ("absent", 0.01, 3)], "source string, target_share double, max_repeats int")
    got = mix(df, targets, total_tokens=20_000)
    report = {r["source"]: r for r in mix_report(got, targets).collect()}
    assert abs(report["big-source"]["tokens"] - 10_000) <= 60 and abs(report["small"]["tokens"] - 9_000) <= 60
    assert report["tiny"]["most_copies"] == 3 and report["absent"]["tokens"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-5
    assert all(r["most_copies"] <= r["max_repeats"] for r in report.values())
    ids = [r["doc_id"] for r in got.collect()]
    assert not {3000, 3001, 3002, None} & set(ids)
    spread = mix(df, targets, total_tokens=20_000, group=2)
    assert abs({r["source"]: r["tokens"] for r in mix_report(spread, targets).collect()}["small"] - 9_000) <= 60
    assert mix(df.limit(0), targets).count() == 0 and mix(df, targets.limit(0)).count() == 0
