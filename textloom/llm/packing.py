"""Problem 7: filling containers of fixed token capacity, by pattern packing with non-negative least squares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.llm.tokens import PATTERN, VOCABULARY, counted
from textloom.runtime import durable, extended


def patterns(units: int, most: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with at most ``most`` parts, parts in falling order."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, parts: tuple[int, ...]) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < most:
            for p in range(min(left, top), 0, -1):
                if p * (most - len(parts)) < left:
                    break
                grow(left - p, p, (*parts, p))

    grow(units, units, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets: a basic solution, with at most as many positive entries as ``a`` has rows."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    for _ in range(20 * a.shape[0] if rounds is None else rounds):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        used[k] = True
        while True:
            at = np.flatnonzero(used)
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (y > 1e-12).all():
                x[:] = 0
                x[at] = y
                break
            low = y <= 1e-12  # go towards y until the first entry reaches zero, and leave it there
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.nanmin(np.where(low & (x[at] > y), x[at] / (x[at] - y), np.inf))
            if not np.isfinite(step):
                step = 0.0
            x[at] += step * (y - x[at])
            gone = at[low & (x[at] <= 1e-9)]
            used[gone if len(gone) else at[low][:1]] = False
            x[~used] = 0
    return x


#: A plan with more places than this isn't broadcast; a plan has about as many steps as there are lengths and patterns.
MOST_PLACES = 500_000


class _Stock:
    """How many items of every exact length are left; finds the greatest length that still fits."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for n, c in histogram.items():
            self.left[n] = c
        self.capacity = capacity

    def at_most(self, size: int, floor: int = 1) -> int:
        found = np.flatnonzero(self.left[floor : size + 1])
        return int(found[-1]) + floor if len(found) else 0


def plan(histogram: dict[int, int], capacity: int, units: int = 32, most: int = 8) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, repeats)]: which exact lengths share a container, and how many such containers there are.

    Lengths are put into ``units`` classes; repeat counts of the patterns of at most ``most`` parts
    are fitted to the histogram of classes by non-negative least squares, as a basic solution with at
    most ``units`` of them, and rounded down, so rounding costs fewer containers than there are
    classes. Every pattern is then realised with exact lengths, the last place and what is left over taking the
    greatest length that fits; the remaining lengths are packed best-fit, greatest first. Each step
    uses up a length or a pattern, so there are about as many steps as lengths and patterns, however
    many items.
    """
    stock = _Stock(histogram, capacity)
    step = capacity / units
    classes = np.clip(np.rint(np.arange(capacity + 1) / step).astype(int), 1, units)
    lows = [int(np.flatnonzero(classes[1:] == u)[0]) + 1 if (classes[1:] == u).any() else 0 for u in range(units + 1)]
    shapes = patterns(units, most)
    out: list[tuple[tuple[int, ...], int]] = []

    def fill(chosen: list[int], room: int) -> None:
        while room > 0:
            n = stock.at_most(room)
            while n and stock.left[n] <= chosen.count(n):
                n = stock.at_most(n - 1) if n > 1 else 0
            if not n:
                break
            chosen.append(n)
            room -= n

    def emit(chosen: list[int], limit: int) -> int:
        uses = {n: chosen.count(n) for n in set(chosen)}
        times = min([limit, *(int(stock.left[n]) // k for n, k in uses.items())])
        for n, k in uses.items():
            stock.left[n] -= k * times
        out.append((tuple(sorted(chosen, reverse=True)), times))
        return times

    total = int(stock.left.sum())
    if total:
        b = np.bincount(classes[1:], weights=stock.left[1:], minlength=units + 1)[1:]
        a = np.zeros((units, len(shapes)))
        for k, s in enumerate(shapes):
            for u in s:
                a[u - 1, k] += 1
        repeats = np.floor(nnls(a, b)).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            left = int(repeats[k])
            while left > 0:
                chosen: list[int] = []
                room = capacity
                for u in shapes[k][:-1]:
                    n = stock.at_most(min(room, lows[u + 1] - 1 if u < units and lows[u + 1] else room), max(1, lows[u]))
                    if not n or stock.left[n] <= chosen.count(n):
                        break
                    chosen.append(n)
                    room -= n
                else:
                    fill(chosen, room)
                    if chosen and sum(chosen) >= capacity - max(1, capacity // 64):
                        left -= emit(chosen, left)
                        continue
                break  # no longer to be filled well from what is there
        while stock.left.any():
            n = stock.at_most(capacity)
            chosen = [n]
            fill(chosen, capacity - n)
            emit(chosen, int(stock.left.max()))
    return out


def _ranked(batches):
    """Number the items of one task by length; a task's items come in the same order on every attempt."""
    next_rank: dict[int, int] = {}
    for batch in batches:
        ranks = []
        for n in batch.column("length").to_pylist():
            r = next_rank.get(n, 0)
            ranks.append(r)
            next_rank[n] = r + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], names=[*batch.schema.names, "rank"])


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, units: int = 32, most: int = 8, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, piece, token_start, token_end, n_tokens, container_id): every text's container.

    A text is whole (piece 0) unless it exceeds ``capacity`` tokens by itself; then every full
    capacity's worth of tokens is a piece and a container of its own, and the rest is packed like a
    text. Null, empty and tokenless texts take no room: one row with 0 tokens and a null container.
    Rows with null ids are left out; rows with one id are separate texts; other columns are ignored;
    an empty table gives an empty result.

    The driver sees one count per length (at most ``capacity``) and plans by pattern packing (see
    plan). Items take the plan's places by their rank among items of their length, which is their
    rank within the task that counted them plus the counts of the tasks before, so no group of equal
    lengths is ever gathered.
    """
    if capacity < units:
        raise ValueError("capacity must be at least the number of units")
    spark = df.sparkSession
    sized = counted(df, id_col, text_col, [], vocabulary, pattern).withColumn("length", (F.col("n_tokens") % capacity).cast("int"))
    sized = durable(sized.mapInArrow(_ranked, extended(sized, "rank bigint")), "pack-items")
    by_task = durable(sized.groupBy("task", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in by_task.where("length > 0").groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = plan(histogram, capacity, units, most)
    rows, base, taken = [], 0, dict.fromkeys(histogram, 0)
    for lengths, times in planned:
        for n in lengths:
            rows.append((n, taken[n], taken[n] + times, base))
            taken[n] += times
        base += times
    # per length, the places in order; at most (lengths + patterns) x places rows
    places = spark.createDataFrame(pa.table({"length": pa.array([r[0] for r in rows], pa.int32()), "r0": pa.array([r[1] for r in rows], pa.int64()), "r1": pa.array([r[2] for r in rows], pa.int64()), "base": pa.array([r[3] for r in rows], pa.int64())}))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)  # one row per task
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = sized.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).withColumn("full", F.floor(F.col("n_tokens") / capacity).cast("int"))
    rest = (
        ranked.where("length > 0").alias("i").join((F.broadcast(places) if len(rows) <= MOST_PLACES else places).alias("p"), F.expr("i.length = p.length and i.rank >= p.r0 and i.rank < p.r1"))
        .select("i.id", F.col("i.full").alias("piece"), (F.col("i.full").cast("bigint") * capacity).alias("token_start"), "i.n_tokens", (F.col("p.base") + F.col("i.rank") - F.col("p.r0")).alias("container_id"))
        .select("id", "piece", "token_start", F.col("n_tokens").alias("token_end"), (F.col("n_tokens") - F.col("token_start")).alias("n_tokens"), "container_id")
    )
    empty = ranked.where("n_tokens = 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("token_end"), F.col("n_tokens"), F.lit(None).cast("bigint").alias("container_id"))
    pieces = ranked.where("full > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    full = pieces.select("id", "piece", (F.col("piece").cast("bigint") * capacity).alias("token_start"), ((F.col("piece").cast("bigint") + 1) * capacity).alias("token_end"), F.lit(capacity).cast("bigint").alias("n_tokens"), (F.lit(base) + F.monotonically_increasing_id()).alias("container_id"))
    return rest.union(empty).union(full).withColumnRenamed("id", "doc_id")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, pieces, tokens, and the share of the capacity that is used."""
    per = packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"))
    return total.withColumn("used_share", F.when(F.col("containers") > 0, F.round(F.col("tokens") / (F.col("containers") * capacity), 6)))
