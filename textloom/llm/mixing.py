"""Problem 8: mixing sources to target weights, by balanced sampling with the cube method."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.tokens import PATTERN, VOCABULARY, counted
from textloom.runtime import durable, extended

_TINY = 1e-9


def flight(probabilities: np.ndarray, sizes: np.ndarray, seed: int, spare: int = 0) -> np.ndarray:
    """Move inclusion probabilities to 0 or 1 while their sum and their size-weighted sum stay.

    Three undecided units at a time are moved along the null space of the two constraints (the
    vector orthogonal to the ones and to the sizes), up or down with the probabilities that keep the
    expectation, until one of them is decided. At most two units stay undecided, besides the
    ``spare`` ones of sizes from the greatest to the least, which are left alone for the landing.
    """
    p = probabilities.astype(float).copy()
    rng = np.random.default_rng(seed)
    draws = iter(rng.random(len(p) + 1))
    active: list[int] = []
    order = np.flatnonzero((p > _TINY) & (p < 1 - _TINY))
    order = order[np.argsort(-sizes[order], kind="stable")]
    spared = order[np.unique(np.linspace(0, len(order) - 1, spare).astype(int))] if spare and len(order) else order[:0]
    for k in order[~np.isin(order, spared)]:
        active.append(int(k))
        if len(active) < 3:
            continue
        a, b, c = active
        u = np.array([sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a]], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        q = p[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + up * u if next(draws) * (up + down) < down else q - down * u
        q = np.where(q < _TINY, 0.0, np.where(q > 1 - _TINY, 1.0, q))
        p[active] = q
        active = [k for k in active if 0 < p[k] < 1]
    return p


def tilted(ways: np.ndarray, p: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """(weights, gap): the distribution of greatest entropy over ``ways`` (rows of 0 and 1) whose means are ``p``, as far as the ways allow it.

    Newton's steps on the concave dual, shortened where they don't raise it.
    """
    theta = np.zeros(len(p))

    def at(t: np.ndarray) -> tuple[float, np.ndarray]:
        z = ways @ t
        top = z.max()
        w = np.exp(z - top)
        return float(p @ t - top - np.log(w.sum())), w / w.sum()

    value, w = at(theta)
    for _ in range(rounds):
        mean = w @ ways
        slope = p - mean
        if np.abs(slope).max() < 1e-3:
            break
        spread = (ways * w[:, None]).T @ ways - np.outer(mean, mean)
        step = np.clip(np.linalg.solve(spread + 1e-4 * np.eye(len(p)), slope), -3, 3)
        for size in (1.0, 0.5, 0.2, 0.05, 0.01, 0.001):
            new, v = at(theta + size * step)
            if new > value:
                theta, value, w = theta + size * step, new, v
                break
        else:
            break
    return w, float(np.abs(w @ ways - p).max())


def settle_large(probabilities: np.ndarray, sizes: np.ndarray, seed: int, few: int = 18) -> np.ndarray:
    """Decide the units larger than three times the median, the largest first.

    Each is moved up or down, with the probabilities that keep its expectation, while all smaller
    units together move the other way, so the size-weighted sum stays. Where there are hardly more
    units than ``few``, none is large.
    """
    p = probabilities.astype(float).copy()
    rng = np.random.default_rng([seed, 2])
    open_ = np.flatnonzero((p > _TINY) & (p < 1 - _TINY))
    large = open_[sizes[open_] > 3 * np.median(sizes[open_])] if len(open_) > few else open_[:0]
    for k in large[np.argsort(-sizes[large], kind="stable")]:
        for _ in range(50):
            rest = open_[(p[open_] > 0) & (p[open_] < 1) & (sizes[open_] < sizes[k])]
            if not 0 < p[k] < 1 or not len(rest):
                break
            spread = p[rest] * (1 - p[rest])
            at, u = np.r_[k, rest], np.r_[1.0, -sizes[k] * spread / (spread * sizes[rest]).sum()]
            up = np.where(u > 0, (1 - p[at]) / u, p[at] / -u).min()
            down = np.where(u > 0, p[at] / u, (1 - p[at]) / -u).min()
            p[at] += up * u if rng.random() * (up + down) < down else -down * u
            p[at] = np.where(p[at] < _TINY, 0.0, np.where(p[at] > 1 - _TINY, 1.0, p[at]))
    return p


def land(probabilities: np.ndarray, sizes: np.ndarray, seed: int, few: int = 18) -> np.ndarray:
    """Decide all units, with their probabilities: the size-weighted sum ends near the given one.

    Units larger than three times the median go first, each along the direction in which all smaller
    ones make up for it; then the others are flown but for ``few`` of sizes from the least to the greatest. Of all ways to decide what is left, those
    are allowed that come nearest to the wanted sum, as few as can be without changing any unit's
    probability by more than 0.02; one of them is drawn (if there are none, each unit by itself). So large units are taken as often as small
    ones of equal probability, and the sum is missed only as far as fairness needs.
    """
    p, rng = settle_large(probabilities, sizes, seed, few), np.random.default_rng([seed, 1])
    rest = np.flatnonzero((p > 0) & (p < 1))
    rest = rest[np.argsort(sizes[rest], kind="stable")]
    spared = rest[np.unique(np.linspace(0, len(rest) - 1, few).astype(int))] if len(rest) > few else rest
    flown = np.setdiff1d(rest, spared)
    p[flown] = flight(p[flown], sizes[flown], seed)
    last = np.flatnonzero((p > 0) & (p < 1))
    if not len(last):
        return p
    want, half = float((p[last] * sizes[last]).sum()), len(last) // 2
    bits = lambda n: (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    low, high = bits(half), bits(len(last) - half)
    off = np.abs(np.add.outer(high @ sizes[last[half:]], low @ sizes[last[:half]]) - want).ravel()
    for many in (512, 1024, 2048, 4096, 8192, 16_384, 32_768):
        near = np.argpartition(off, many)[:many] if many < len(off) else np.arange(len(off))
        near = near[np.lexsort((near, off[near]))]
        ways = np.concatenate((low[near % len(low)], high[near // len(low)]), axis=1).astype(float)
        w, gap = tilted(ways, p[last])
        if gap <= 0.02:
            p[last] = ways[rng.choice(len(ways), p=w)]
            return p
    p[last] = rng.random(len(last)) < p[last]
    return p


def shares_of(targets: dict[str, tuple[float, float]], supply: dict[str, int], total: float, redistribute: bool) -> dict[str, float]:
    """Tokens every source gives: its share of ``total``, at most its supply times its repeats.

    With ``redistribute`` what scarce sources can't give is shared out among the others in proportion
    to their targets, as far as these can give it, so that the total is reached if there is enough.
    """
    most = {s: n * targets[s][1] for s, n in supply.items()}
    factor = 1.0
    if redistribute and sum(targets[s][0] for s in supply) > 0:
        left, weight = total, sum(targets[s][0] for s in supply)
        for s in sorted(supply, key=lambda s: (most[s] / (targets[s][0] * total) if total else 0.0, s)):  # the scarcest first
            factor = left / (weight * total) if total and weight > 0 else 1.0
            if targets[s][0] * total * factor <= most[s]:
                break
            left, weight = left - most[s], weight - targets[s][0]
    return {s: min(targets[s][0] * total * factor, most[s]) for s in supply}


def _fly(fractions: dict[str, float]):
    """The flight of every source's units within one task; batches are flown in turn, undecided units go on to the next."""

    def run(batches):
        waiting: dict[str, list] = {}
        for batch in batches:
            ids, sources, n = (batch.column(c).to_pylist() for c in ("id", "source", "n_tokens"))
            task, place = batch.column("task").to_pylist(), batch.column("place").to_pylist()
            for row in zip(ids, sources, n, task, place):
                waiting.setdefault(row[1], []).append((*row, fractions[row[1]]))
            decided = []
            for source, rows in waiting.items():
                n, seed = np.array([r[2] for r in rows], float), len(rows) * 31 + rows[0][4] % 1009
                p = flight(settle_large(np.array([r[5] for r in rows]), n, seed), n, seed, spare=16)
                decided += [(*r[:5], float(x)) for r, x in zip(rows, p) if x in (0.0, 1.0)]
                waiting[source] = [(*r[:5], float(x)) for r, x in zip(rows, p) if x not in (0.0, 1.0)]
            yield _batch(decided, batch.schema)
        rest = [r for rows in waiting.values() for r in rows]
        if rest:
            yield _batch(rest, batch.schema)

    return run


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    names = ["id", "source", "n_tokens", "task", "place"]
    return pa.RecordBatch.from_arrays([*(pa.array(c, schema.field(n).type) for c, n in zip(cols, names)), pa.array(cols[5], pa.float64())], names=[*names, "p"])


def _finish(land_all: bool):
    def run(rows: pa.Table) -> pa.Table:
        p, n = rows["p"].to_numpy(), rows["n_tokens"].to_numpy().astype(float)
        p = land(p, n, seed=rows.num_rows) if land_all else flight(settle_large(p, n, rows.num_rows), n, seed=rows.num_rows, spare=16)
        return rows.drop_columns(["p"]).append_column("p", pa.array(p))

    return run


def source_name(column):
    """One spelling of a source's name: no surrounding blanks, lower case, hyphens for blanks and underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "-")


def mix(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: int | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, group: int = 256, redistribute: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens, copies) for every document of the mix; copies is at least 1.

    Each source of ``targets`` (source, target_share, max_repeats) is to give target_share of
    ``total_tokens``, which is by default the tokens of all documents of these sources. A source with
    a times its own tokens to give has every document floor(a) times, and once more the documents
    that balanced sampling picks with the probability of the fraction, so that the tokens and the
    number of documents of the source hold; a source that would need more than its max_repeats (null:
    any number) gives all it may (see mix_report), and with ``redistribute`` the others make up for it
    in proportion to their targets (see shares_of). Sources without documents give nothing, those without a target are
    left out. Names are compared in one spelling. Rows with null ids, null sources or no tokens are
    left out; rows with one id are separate documents; an empty table gives an empty result.

    Method: every task moves the probabilities of its own documents; what it can't decide, at most
    two documents a source and a few spared for the landing, goes on to groups of ``group`` tasks and so on, until few units land.
    Only sums per source reach the driver, one row for each target.
    """
    wanted = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null and target_share > 0").collect():
        wanted[r["s"]] = (float(r["target_share"]), math.inf if r["max_repeats"] is None else float(r["max_repeats"]))
    tagged = df.withColumn("__source", source_name(F.col(source_col))).where(F.col("__source").isin(list(wanted)))
    docs = counted(tagged.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body"), F.col("__source").alias("source")), "__id", "__body", ["source"], vocabulary, pattern)
    docs = durable(docs.where("n_tokens > 0").withColumn("place", F.monotonically_increasing_id()), "mix-documents")
    sums = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(sums.values()) if total_tokens is None else total_tokens
    often = {s: given / sums[s] for s, given in shares_of(wanted, sums, total, redistribute).items()}
    whole = {s: int(a + _TINY) for s, a in often.items()}
    fractions = {s: max(0.0, a - whole[s]) if a - whole[s] > _TINY else 0.0 for s, a in often.items()}
    schema = extended(docs.select("id", "source", "n_tokens", "task", "place"), "p double")
    flown = durable(docs.select("id", "source", "n_tokens", "task", "place").mapInArrow(_fly(fractions), schema), "mix-flown")
    decided, open_ = flown.where("p = 0 or p = 1"), flown.where("p > 0 and p < 1")
    while open_.select("source", "task").distinct().groupBy("source").count().where(F.col("count") > group).limit(1).count():
        merged = durable(open_.withColumn("g", F.floor(F.col("task") / group)).groupBy("source", "g").applyInArrow(lambda t: _finish(False)(t.drop_columns(["g"])), schema), "mix-merged")
        decided = decided.union(merged.where("p = 0 or p = 1"))
        open_ = merged.where("p > 0 and p < 1").withColumn("task", F.floor(F.col("task") / group).cast("int"))
    landed = open_.groupBy("source").applyInArrow(_finish(True), schema)
    base = F.create_map(*[x for s, k in whole.items() for x in (F.lit(s), F.lit(k))]) if whole else F.create_map(F.lit(""), F.lit(0))
    out = decided.union(landed).select(F.col("id").alias("doc_id"), "source", "n_tokens", (F.coalesce(F.element_at(base, F.col("source")), F.lit(0)) + F.col("p").cast("int")).alias("copies"))
    return out.where("copies > 0")


def mix_report(mixed: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, actual_share, planned_tokens, tokens, shortfall, documents, most_copies, max_repeats) for every source of ``targets``.

    ``planned_tokens`` is the target share of ``total_tokens``, by default of the mix as it came out;
    ``shortfall`` is what is missing of it.
    """
    per = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total"))
    zero = F.lit(0).cast("bigint")
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("tokens", F.coalesce("tokens", zero)).withColumn("planned_tokens", F.round(F.col("target_share") * (F.lit(total_tokens) if total_tokens is not None else F.coalesce("total", zero))).cast("bigint"))
    return rows.select(
        "source", "target_share", F.round(F.col("tokens") / F.col("total"), 6).alias("actual_share"), "planned_tokens", "tokens", F.greatest(F.col("planned_tokens") - F.col("tokens"), zero).alias("shortfall"),
        F.coalesce("documents", zero).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
    )
