"""Deterministic samples, allocations and splits."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import rules
from tallyloom.functions.bind import let


def hash_top(df: DataFrame, keys: Sequence[str], digest: Column, ties: Sequence[str], n: int) -> DataFrame:
    """The n rows of each key whose digests come first; ties by the named columns. Spark ranks before it shuffles."""
    w = W.partitionBy(*keys).orderBy(digest, *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def largest_remainder(strata: DataFrame, name: str, size: str, total: int) -> DataFrame:
    """Whole shares of `total` in proportion to size: rounded down, the rest by remainder, then name. One row for each stratum."""
    everything = strata.agg(F.sum(size).alias("__all"))
    raw = strata.crossJoin(everything).withColumn("__scaled", F.col(size) * F.lit(total).cast("long"))  # a single total
    base = raw.withColumn("__floor", F.expr("__scaled div __all")).withColumn("__rest", F.col("__scaled") % F.col("__all"))
    left = F.lit(total) - F.sum("__floor").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc("__rest"), F.col(name)))
    return base.select(name, size, (F.col("__floor") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("share"))


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """`count` rows of each key at the middles of equal stretches: row i of n where i = floor((j + 1/2) n / count).

    More rows than a key has are an error; none are an empty table.
    """
    if not count:
        return df.limit(0)
    ranked = df.withColumn("__i", (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    enough = F.when(F.col("__n") < count, F.raise_error(F.lit(f"fewer than {count} rows")).cast("bigint")).otherwise(F.col("__n"))
    chosen = sizes.select(*keys, enough.alias("__n"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("__j"))
    chosen = chosen.select(*keys, F.expr(f"((2 * __j + 1) * __n) div {2 * count}").cast("long").alias("__i")).distinct()
    return ranked.join(chosen, [*keys, "__i"], "left_semi").drop("__i")


def fill_cells(candidates: DataFrame, cells: Sequence[tuple[str, Column, int]], digest: Column, ties: Sequence[str]) -> DataFrame:
    """Cells in declared order take the first n of their candidates that no earlier cell took; a shortage is an error."""
    left, out = candidates, None
    for name, condition, n in cells:
        some = left.where(condition).withColumn("__d", digest).orderBy("__d", *ties).limit(n).drop("__d")
        size = some.agg(F.count("*").alias("__n"))  # a single row
        enough = F.when(F.col("__n") < n, F.raise_error(F.lit(f"cell {name} is short of candidates")).cast("boolean")).otherwise(F.lit(True))
        taken = some.crossJoin(size).where(enough).drop("__n").withColumn("cell", F.lit(name))
        left = left.join(some.select(*ties), list(ties), "left_anti")
        out = taken if out is None else out.unionByName(taken)
    return out


@dataclass(frozen=True)
class Cell:
    """A cell of a pool: its name, which candidates it takes, and how many."""

    name: str
    takes: Column
    n: int


def contenders(candidates: DataFrame, cells: Sequence[Cell], ties: Sequence[str], digest: Callable[[Column], Column]) -> DataFrame:
    """(ties, cell, number, rank): for each cell those of its candidates that could be among its picks, by the digest of the cell's name; one pass and one ranking for all cells.

    Earlier cells take as many candidates away as they ask for, so a cell's picks are among its first n candidates and as many more. So cells times the sum of all n bounds the
    rows that come out, whatever the number of candidates; Spark ranks on the map side before it shuffles.
    """
    if len({c.name for c in cells}) < len(cells):
        raise ValueError("two cells have one name")
    reach, total = {}, 0
    for c in cells:
        total += c.n
        reach[c.name] = total
    listed = F.filter(F.array(*(F.when(c.takes, F.struct(F.lit(i).alias("number"), F.lit(c.name).alias("cell"), F.lit(reach[c.name]).alias("reach"))) for i, c in enumerate(cells))), lambda x: x.isNotNull())
    rows = candidates.select(*ties, F.inline(listed)).withColumn("__d", digest(F.col("cell")))
    w = W.partitionBy("cell").orderBy("__d", *ties)
    most = max(reach.values(), default=0)
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.where("rank <= reach").select(*ties, "number", "cell", "rank")


def fill_at_once(candidates: DataFrame, cells: Sequence[Cell], ties: Sequence[str], digest: Callable[[Column], Column]) -> DataFrame:
    """(ties, cell, rank): what cells take when each in declared order takes the first n of its candidates that no earlier cell took; cells may overlap.

    The candidates are read once (see contenders()); what is left of them is bounded by the cells, not by the candidates, and is settled in one task, cell by cell. rank is that in the
    cell's own order of candidates. Cells that come out short are told by fill_record(). ties identify a candidate.
    """
    columns = [*ties, "number", "cell", "rank"]
    quota = {i: c.n for i, c in enumerate(cells)}
    few = contenders(candidates, cells, ties, digest).select(*columns)

    def settle(table: pa.Table) -> pa.Table:
        rows = table.select(columns).to_pylist()
        taken, picked, left = set(), [], dict(quota)
        for r in sorted(rows, key=lambda r: (r["number"], r["rank"])):
            who = tuple(r[t] for t in ties)
            if left[r["number"]] and who not in taken:
                left[r["number"]] -= 1
                taken.add(who)
                picked.append(r)
        return pa.Table.from_pylist(picked, table.select(columns).schema)

    return few.withColumn("__one", F.lit(1)).groupBy("__one").applyInArrow(settle, few.schema).select(*ties, "cell", F.col("rank").cast("long").alias("rank"))


def fill_record(filled: DataFrame, spark: SparkSession, cells: Sequence[Cell]) -> DataFrame:
    """(cell, declared, filled, short) of every declared cell, those without a single candidate too."""
    declared = spark.createDataFrame([(c.name, c.n) for c in cells], "cell string, declared long")
    counts = filled.groupBy("cell").agg(F.count("*").alias("filled"))
    out = declared.join(counts, "cell", "left").select("cell", "declared", F.coalesce("filled", F.lit(0)).alias("filled"))
    return out.withColumn("short", F.col("declared") - F.col("filled"))


def filled_or_error(filled: DataFrame, spark: SparkSession, cells: Sequence[Cell]) -> DataFrame:
    """filled as it is, unless a cell is short of candidates, which is an error that names it."""
    short = fill_record(filled, spark, cells).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("short") > 0, F.col("cell")))), ", ").alias("__short"))  # a single row
    bad = F.when(F.col("__short") != "", F.raise_error(F.concat(F.lit("short of candidates: "), F.col("__short"))).cast("boolean")).otherwise(F.lit(True))
    return filled.crossJoin(short).where(bad).drop("__short")


def split_by_hash(df: DataFrame, digest: Column, ties: Sequence[str], n: int, first: str, second: str) -> DataFrame:
    """The n rows whose digests come first, and the others."""
    chosen = df.withColumn("__d", digest).orderBy("__d", *ties).limit(n).select(*ties, F.lit(first).alias("__side"))
    return df.join(chosen, list(ties), "left").withColumn("side", F.coalesce("__side", F.lit(second))).drop("__side")


def repeat(df: DataFrame, total: int, digest: Column, ties: Sequence[str]) -> DataFrame:
    """Every row as often as it goes into total, and the rest to the rows whose digests come first; canonical order by ties. An empty table stays empty."""
    size = df.agg(F.count("*").alias("__n"))  # a single row
    placed = df.withColumn("__d", digest).withColumn("__rank", F.row_number().over(W.orderBy("__d", *ties))).drop("__d")  # the sample of a training set: one ordered list on purpose
    times = F.expr(f"{total} div __n") + F.when(F.col("__rank") <= F.expr(f"{total} % __n"), 1).otherwise(0)
    counted = placed.crossJoin(size).withColumn("__times", times).where("__times > 0")
    return counted.withColumn("repeat_index", F.explode(F.sequence(F.lit(0), (F.col("__times") - 1).cast("int")))).drop("__n", "__rank", "__times")


def seeded_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], seed: int | str) -> DataFrame:
    """Adds `drawn`: the place of each row in its key's list, sorted and shuffled by Python's generator. Keys are strata of bounded size."""

    def shuffled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order)).reset_index(drop=True)
        places = list(range(len(pdf)))
        random.Random(seed).shuffle(places)
        pdf["drawn"] = pd.Series({row: place for place, row in enumerate(places)}).sort_index()
        return pdf

    from pyspark.sql.types import LongType, StructField, StructType

    return df.groupBy(*keys).applyInPandas(shuffled, StructType([*df.schema.fields, StructField("drawn", LongType())]))


def permuted_labels(df: DataFrame, within: Sequence[str], item: str, label: str, seed: int) -> DataFrame:
    """Labels dealt anew to items inside each group, in the order of SHA-256 of seed and item; all rows of an item move together. A group's items are ranked in one task."""
    items = df.groupBy(*within, item).agg(F.min(label).alias("__old"))
    order = W.partitionBy(*within).orderBy(item)
    drawn = W.partitionBy(*within).orderBy(rules.hash_text("deal", seed, F.col(item)), item)
    sources = items.select(*within, F.row_number().over(order).alias("__k"), F.col("__old").alias("__label"))
    targets = items.select(*within, item, F.row_number().over(drawn).alias("__k"))
    dealt = targets.join(sources, [*within, "__k"]).select(*within, item, "__label")
    return df.join(dealt, [*within, item]).withColumn(label, F.col("__label")).drop("__label")


def keyed_permutation(place: Column, n: int, *key: Column | str | int, walk: int = 64) -> Column:
    """Where a place of 0 ... n - 1 goes under a permutation that the key chooses: an expression of the place alone, nothing is gathered or sorted.

    Places are pairs of two wheels of about sqrt(n) that turn each other by hashes, four times (a Feistel network); the pairs are sqrt(n) more than n at most, and who lands beyond n goes on until
    within, which keeps it a permutation. With a chance of about n ** (-walk / 2) someone has not landed after `walk` rounds, which is an error.
    """
    wide = max(1, math.isqrt(max(0, n - 1)) + 1)
    high = -(-n // wide)
    part = lambda turn, x, size: F.conv(F.substring(rules.hash_text("permutation", *key, turn, x), 1, 15), 16, 10).cast("long") % size
    pair = lambda left, right: F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turned(at: Column, turn: int) -> Column:
        return let(at, lambda s: pair((s.l + part(turn, s.r, high)) % high, s.r) if turn % 2 == 0 else pair(s.l, (s.r + part(turn, s.l, wide)) % wide))

    def once(x: Column) -> Column:
        at = pair(F.floor(x / wide), x % wide)
        for turn in range(4):
            at = turned(at, turn)
        return let(at, lambda s: s.l * wide + s.r)

    landed = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), once(place.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return let(landed, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a place did not land")).cast("long")))


def micro_batches(spark: SparkSession, n: int, batch: int, steps: int, seed: int, accumulate: int = 1) -> DataFrame:
    """(step, micro_batch, slot, epoch, example): a stream of whole epochs, each permuted anew, cut into micro-batches of `batch` examples, `accumulate` of which make a step.

    Every example comes once in each epoch. A micro-batch that would hold an example twice, as one that is larger than an epoch does, is an error; so are no examples at all.
    """
    if n < 1 or batch < 1 or batch > n:
        raise ValueError("a micro-batch needs at least one example, and no more than there are")
    rows = spark.range(steps * accumulate * batch).withColumn("epoch", F.expr(f"id div {n}")).withColumn("__place", F.col("id") % n)
    placed = rows.withColumn("example", keyed_permutation(F.col("__place"), n, seed, F.col("epoch")))
    micro = placed.withColumn("micro_batch", F.expr(f"id div {batch}")).withColumn("slot", F.col("id") % batch)
    return micro.select(F.expr(f"micro_batch div {accumulate}").alias("step"), "micro_batch", "slot", "epoch", "example")


def repeated_in_batches(batches: DataFrame) -> DataFrame:
    """(micro_batch, example) that a micro-batch holds twice: where one goes over the end of an epoch."""
    return batches.groupBy("micro_batch", "example").agg(F.count("*").alias("n")).where("n > 1").select("micro_batch", "example")


def epochs_consumed(n: int, batch: int, steps: int, accumulate: int = 1) -> float:
    return steps * accumulate * batch / n


def unranked_pair(index: Column, low: int, side: int) -> tuple[Column, Column]:
    """The pair of a number of 0 ... side ** 2 - 1 in a square of operands from `low` on."""
    return low + ((index - index % side) / side).cast("long"), low + index % side


def draw_pairs(requests: DataFrame, key: str, n: str, low: int, high: int, seed: int, keep: Callable[[Column, Column], Column], rounds: int = 12) -> DataFrame:
    """(key, a, b, place): for each key the first n different pairs that keep() takes, in the order of a stream of draws from a square that is never enumerated.

    Draw i of a key is the pair whose number its hash gives. Half as many draws again as pairs are tried first, and twice as many each time that a key comes out short; as streams are fixed, the result does
    not depend on that. A key that is short after all rounds is an error. place counts from 0; requests(key, n) has each key once, and a key's pairs are ranked in one task.
    """
    side = high - low + 1
    number = F.conv(F.substring(rules.hash_text("pair", seed, F.col(key), F.col("__i")), 1, 15), 16, 10).cast("long") % (side * side)
    wanted = requests.select(key, F.col(n).cast("long").alias("__n")).where("__n > 0")
    a, b = unranked_pair(F.col("__x"), low, side)
    for r in range(rounds):
        most = ((F.col("__n") * 3 + 14) * 2**r / 2).cast("long")
        draws = wanted.select(key, F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("__i")).withColumn("__x", number)
        found = draws.select(key, "__i", a.alias("a"), b.alias("b")).where(keep(F.col("a"), F.col("b"))).groupBy(key, "a", "b").agg(F.min("__i").alias("__i"))
        sizes = found.groupBy(key).agg(F.count("*").alias("__have"))
        if wanted.join(sizes, key, "left").where(F.coalesce("__have", F.lit(0)) < F.col("__n")).isEmpty():
            break
    else:
        raise ValueError("the square has too few pairs that are taken")
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("__i")).cast("long") - 1)
    return ranked.join(wanted, key).where("place < __n").select(key, "a", "b", "place")
