"""Sequence packing as cutting stock by column generation.

Documents are cut into full sequences and a rest; the rests' lengths, in steps of STEP tokens, make a histogram. A linear
program over patterns (how many rests of each length fill one sequence) is solved by generating patterns: its dual prices go into a knapsack dynamic
program that finds the most valuable pattern, until none is worth more than a sequence. Patterns are used as often as the solution
says, rounded down, what is left is packed first-fit decreasing, and ranked rests take the patterns' places.
Only the histogram, CAPACITY / STEP numbers at most, reaches the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .library import library_coder
from .runtime import ids_and_text, materialize

CAPACITY, STEP = 2048, 8
#: The solver stops this close to the bound of no padding at all, or after so many patterns.
CLOSE, ROUNDS = 5e-4, 3000


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest total price, each size as often as wanted, and that price."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.searchsorted(sizes, room, side="right")
        value[room] = value[room - 1]
        if fit:
            gain = prices[:fit] + value[room - sizes[:fit]]
            k = int(gain.argmax())
            if gain[k] > value[room] + 1e-12:
                value[room], choice[room] = gain[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[capacity]), pattern


def least_sequences(histogram: dict[int, int], capacity: int) -> float:
    """A number of sequences that no packing can go below: of prices under which no pattern is worth more than a sequence, what the demand costs.

    Each pattern is worth at most `worth` under the last prices, so prices divided by that are such (weak duality).
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return 0.0
    demand = np.array([histogram[s] for s in sizes.tolist()], np.float64)
    _, _, prices = generate_columns(sizes, demand, capacity)
    worth, _ = best_pattern(sizes, prices, capacity)
    return max(float((demand * sizes).sum() / capacity), float((prices * demand).sum() / max(worth, 1.0)))


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (one a column), how often the linear program uses each, and the sizes' dual prices, by the revised simplex method."""
    patterns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // sizes))
    place = {s: i for i, s in enumerate(sizes.tolist())}
    for i, s in enumerate(sizes.tolist()):  # the rarer of two sizes that fill a sequence starts as a pair with the other
        j = place.get(capacity - s, i)
        if j != i and (demand[i], i) < (demand[j], j):
            patterns[i, i], patterns[j, i] = 1, 1
            inverse[i, i], inverse[j, i] = 1.0, -inverse[j, j]
    use = (inverse * demand).sum(axis=1)
    enough = (1 + CLOSE) * (demand * sizes).sum() / capacity
    for _ in range(rounds):
        if use.sum() <= enough:
            break
        prices = np.maximum(inverse.sum(axis=0), 0.0)
        worth, column = best_pattern(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        step = (inverse * column).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, use / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        use = use - ratio[out] * step
        use[out] = ratio[out]
        patterns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
    return patterns, np.maximum(use, 0.0), np.maximum(inverse.sum(axis=0), 0.0)


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(size -> count, sequences): whole uses of patterns that take exactly the histogram's items."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[s] for s in sizes.tolist()], np.float64)
    patterns, use, _ = generate_columns(sizes, demand, capacity)
    whole = np.floor(use + 1e-6).astype(np.int64)
    left, out = demand.astype(np.int64), []
    for k in np.argsort(-whole, kind="stable").tolist():
        column, times = patterns[:, k], int(whole[k])
        if times and column.any():
            times = min([times, *(left[column > 0] // column[column > 0]).tolist()])
            if times:
                left = left - times * column
                out.append(({int(s): int(a) for s, a in zip(sizes, column) if a}, times))
    rest = [s for s, n in zip(sizes[::-1].tolist(), left[::-1].tolist()) for _ in range(n)]
    bins: list[tuple[int, Counter]] = []
    for s in rest:  # at most one fraction of each pattern is left
        at = next((i for i, (room, _) in enumerate(bins) if room >= s), None)
        if at is None:
            bins.append((capacity - s, Counter({s: 1})))
        else:
            bins[at][1][s] += 1
            bins[at] = (bins[at][0] - s, bins[at][1])
    return out + [(dict(c), 1) for _, c in bins]


class Places:
    """The sequence that the n-th item of a size goes to."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        taken, first = Counter(), 0
        for pattern, times in plan:
            for size, count in pattern.items():
                rows.setdefault(size, []).append((taken[size], count, first))
                taken[size] += count * times
            first += times
        self.sequences = first
        self.rows = {s: tuple(np.array(x, np.int64) for x in zip(*r)) for s, r in rows.items()}

    def of(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(size), np.int64)
        for s in np.unique(size).tolist():
            at = size == s
            start, count, first = self.rows[s]
            k = np.searchsorted(start, rank[at], side="right") - 1
            out[at] = first[k] + (rank[at] - start[k]) // count[k]
        return out


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Pieces of every document's ids: whole sequences and a rest, with size (steps, rounded up) and rank in (part, size)."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "nth"]

    def run(batches):
        coder, part, seen = library_coder(tokenizer_path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = coder.ids(text or "") + end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    size = -(-n // step)
                    rows.append((part, doc_id, at // 4, n, zlib.crc32(piece), len(ids) // 4, size, seen[size]))
                    seen[size] += 1
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return ids_and_text(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Null and empty texts are the end id alone. Repeated rows and ids are packed like others; an empty table gives
    an empty table; other columns are ignored. `capacity` is a multiple of `step`.
    """
    pieces = materialize(cut_documents(docs, tokenizer_path, end_id, capacity, step), "pieces")
    counts = pieces.groupBy("part", "size").count()
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}  # capacity / step rows
    places = Places(plan_patterns(histogram, capacity // step))
    before = W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "size", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))

    @F.pandas_udf("long")
    def place(size: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(places.of(size.to_numpy(), rank.to_numpy()))

    ranked = pieces.join(offsets, ["part", "size"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.withColumn("sequence_id", place("size", "rank"))
    earlier = W.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    )
