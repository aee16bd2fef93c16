"""Keyed comparison of runs, contrasts and set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    left, right = (x.select(*keys).distinct() for x in (a, b))
    return left.join(right, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, list(keys), "left_anti").withColumn("side", F.lit("right")))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Stops at a repeated key."""
    if (row := repeated_keys(df, keys).first()) is not None:
        raise ValueError(f"repeated key: {row.asDict()}")


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Both sides' values by key; stops at a key that one side lacks."""
    rename = lambda df, end: df.select(*keys, *(F.col(v).alias(v + end) for v in values), F.lit(1).alias("__in" + end))
    both = rename(a, "_a").join(rename(b, "_b"), list(keys), "full_outer")
    missing = F.col("__in_a").isNull() | F.col("__in_b").isNull()
    guard = F.when(missing, F.raise_error(F.lit("a key is missing on one side"))).otherwise(F.lit(True)).cast("boolean")
    return both.where(guard).drop("__in_a", "__in_b")


def agreement(pairs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Pairs that are equal and unequal, and those null on both sides apart."""
    x, y = F.col(value + "_a"), F.col(value + "_b")
    neither = x.isNull() & y.isNull()
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(neither).alias("both_null"), F.count_if(x.eqNullSafe(y) & ~neither).alias("same"), F.count_if(~x.eqNullSafe(y)).alias("changed")
    )


def differing_settings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Settings (key, value) whose values differ or that one side lacks."""
    both = a.select("key", F.col("value").alias("left")).join(b.select("key", F.col("value").alias("right")), "key", "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def contrasts(df: DataFrame, keys: Sequence[str], arm: str, first: str, second: str, value: str) -> DataFrame:
    """Value of the second arm less that of the first, by key; keys that lack an arm are left out."""
    pick = lambda x: F.max(F.when(F.col(arm) == x, F.col(value)))
    out = df.groupBy(*keys).agg(pick(first).alias("__a"), pick(second).alias("__b"))
    return out.where("__a is not null and __b is not null").select(*keys, (F.col("__b") - F.col("__a")).alias("difference"))


def without_near_ties(df: DataFrame, gap: Column, margin: float) -> DataFrame:
    """Rows whose gap is beyond the margin; a gap that is null or not a number is an error."""
    bad = gap.isNull() | F.isnan(gap)
    return df.where(F.when(bad, F.raise_error(F.lit("a gap is missing"))).otherwise(F.abs(gap) > margin).cast("boolean"))


def set_hash(df: DataFrame, order: Sequence[str], row: Column) -> DataFrame:
    """SHA-256 of all rows' texts in order. For manifests: the rows of one set, gathered on purpose."""
    rows = df.agg(F.sort_array(F.collect_list(F.struct(*order, row.alias("__text")))).alias("all"))
    return rows.select(F.sha2(F.concat_ws(",", F.transform("all", lambda x: x["__text"])).cast("binary"), 256).alias("hash"))


def trie_hash(df: DataFrame, row: Column, depth: int) -> DataFrame:
    """(n, hash): one SHA-256 for all rows' texts, whatever their order and partitions; rows that repeat count as often as they occur. An empty table has n = 0 and a null hash.

    Rows are hashed, equal ones counted, and filed under the first `depth` digits of their hashes; a file's hash is that of its rows in order, and 16 files make one of a digit less, up to the root. No
    task holds more than a file, about n / 16 ** depth distinct rows, so the depth grows with the logarithm of the rows. For an order-sensitive hash the row's text has its place.
    """
    each = df.select(F.sha2(row.cast("binary"), 256).alias("__h")).groupBy("__h").agg(F.count("*").alias("__n"))
    text = F.concat_ws(":", "__h", "__n")
    nodes = each.groupBy(F.substring("__h", 1, depth).alias("__p")).agg(F.sum("__n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ",").cast("binary"), 256).alias("hash"))
    for length in range(depth - 1, -1, -1):
        child = F.concat_ws(":", "__p", "hash")
        nodes = nodes.groupBy(F.substring("__p", 1, length).alias("__p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(child)), ",").cast("binary"), 256).alias("hash"))
    return nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("hash").alias("hash"))  # a single row


def ordered_hash(df: DataFrame, place: Column, row: Column, depth: int) -> DataFrame:
    """As trie_hash(), of a stream whose rows have places: the same rows at other places have another hash."""
    return trie_hash(df, F.concat_ws(":", place.cast("string"), row), depth)


def set_sizes(sets: DataFrame, key: str, item: str, reference) -> DataFrame:
    """For each set, the number of items that the reference set has and it lacks, and the other way round: from the sizes of the sets and of what they share."""
    rows = sets.select(key, item).distinct()
    ref = rows.where(F.col(key) == reference).select(item, F.lit(1).alias("__in"))
    size = ref.agg(F.count("*").alias("__size"))  # a single row
    own = rows.where(F.col(key) != reference).join(ref, item, "left").groupBy(key).agg(F.count("*").alias("__own"), F.count("__in").alias("__both"))
    return own.crossJoin(size).select(key, (F.col("__size") - F.col("__both")).alias("missing"), (F.col("__own") - F.col("__both")).alias("extra"))


def scan_until_failure(points: DataFrame, keys: Sequence[str], order: str, holds: Column) -> DataFrame:
    """The last point before the first failing one in order, and whether a later point holds again."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = points.withColumn("__ok", holds).withColumn("__failed", F.sum(F.when(F.col("__ok"), 0).otherwise(1)).over(w))
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("__failed") == 0, F.col(order))).alias("last_holding"), F.coalesce(F.bool_or((F.col("__failed") > 0) & F.col("__ok")), F.lit(False)).alias("holds_again"))
