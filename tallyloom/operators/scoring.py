"""Answers classified against truth and rules, and the rates that follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.parsing import count_written_lines

CLASSES = ("correct", "rule", "other_error", "parse_fail")


def classify(parsed: Column, truth: Column, rule: Column) -> Column:
    """parse_fail, correct, rule or other_error, in this order. A rule that equals the truth is an error of the item."""
    checked = F.when(rule == truth, F.raise_error(F.lit("rule value equals truth"))).otherwise(F.lit(None)).cast("string")
    return F.coalesce(checked, F.when(parsed.isNull(), "parse_fail").when(parsed == truth, "correct").when(parsed == rule, "rule").otherwise("other_error"))


def rates(df: DataFrame, keys: Sequence[str], label: str = "classification") -> DataFrame:
    """n_items and the four rates for each key; every class has a column whether it occurs or not."""
    n = F.count("*")
    return df.groupBy(*keys).agg(n.cast("long").alias("n_items"), *((F.count_if(F.col(label) == c) / n).alias(f"{c}_rate") for c in CLASSES))


def rates_by_rule(df: DataFrame, keys: Sequence[str], rules: Sequence[str], parsed: str = "parsed", truth: str = "truth") -> DataFrame:
    """A block of rates for each rule column; rules are never added up. Items are read once, however many rules there are."""
    each = F.array(*(F.struct(F.lit(r).alias("reference_rule"), F.col(r).cast("long").alias("value")) for r in rules))
    rows = df.select(*keys, parsed, truth, F.explode(each).alias("r")).select(*keys, parsed, truth, "r.*")
    rows = rows.withColumn("classification", classify(F.col(parsed), F.col(truth), F.col("value")))
    return rates(rows, [*keys, "reference_rule"])


def strategies(df: DataFrame, keys: Sequence[str], truth: str, polarity: str) -> DataFrame:
    """What constant answers and answers by polarity alone would score."""
    t, p = F.col(truth), F.col(polarity) == "gt"
    share = lambda c: F.count_if(c) / F.count("*")
    return df.groupBy(*keys).agg(share(t).alias("always_yes"), share(~t).alias("always_no"), share(t == p).alias("yes_if_gt"), share(t != p).alias("yes_if_lt"))


def transitions(df: DataFrame, before: str, after: str, labels: Sequence = CLASSES) -> DataFrame:
    """Counts of every (old, new) pair of labels, pairs that do not occur included."""
    seen = df.groupBy(F.col(before).alias("old"), F.col(after).alias("new")).agg(F.count("*").alias("n"))
    value = F.array(*map(F.lit, labels))
    grid = df.sparkSession.range(1).select(F.explode(value).alias("old")).select("old", F.explode(value).alias("new"))
    return grid.join(seen, ["old", "new"], "left").select("old", "new", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def mean_of_seeds(df: DataFrame, keys: Sequence[str], seed: str, value: str) -> DataFrame:
    """Mean over seeds of each seed's mean, which is not the pooled mean, and their sample deviation (0 for one seed)."""
    per = df.groupBy(*keys, seed).agg(F.avg(value).alias("m"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_seeds"), F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd"))


def shell_rates(df: DataFrame, radius: str, distance: Column, hit: Column) -> DataFrame:
    """For each radius of a grid, the rate over rows beyond the radius before it; null where there are none."""
    from pyspark.sql import Window as W

    grid = df.select(radius).distinct().withColumn("inner", F.lag(radius).over(W.orderBy(radius)))  # one row for each radius
    rows = df.join(F.broadcast(grid), radius).where(F.col("inner").isNull() | (distance > F.col("inner")))
    found = rows.groupBy(radius).agg(F.count("*").alias("n"), (F.count_if(hit) / F.count("*")).alias("rate"))
    return grid.join(found, radius, "left").select(radius, "inner", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "rate")


def overall_and_cells(df: DataFrame, cell: str, once: Column, twice: Column) -> DataFrame:
    """Rates of a rule applied once and twice, and their difference, overall (null cell) and for each cell, in one pass."""
    n = F.count("*")
    out = df.groupingSets([[], [F.col(cell)]], F.col(cell)).agg(n.alias("n"), (F.count_if(once) / n).alias("once"), (F.count_if(twice) / n).alias("twice"))
    return out.withColumn("difference", F.col("twice") - F.col("once"))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, top: int) -> DataFrame:
    """The most frequent values of each key; ties by value, null last."""
    from pyspark.sql import Window as W

    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_last(value))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def length_profile(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Exact least, median and largest number of characters, and median number of lines with anything in them."""
    lines = count_written_lines(F.col(text))
    rows = df.select(*keys, F.length(text).alias("c"), lines.alias("l"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.median("c").alias("median"), F.max("c").alias("most"), F.median("l").alias("median_lines"))


def cell_gate(df: DataFrame, keys: Sequence[str], good: Column, least: float) -> DataFrame:
    """Share of good rows for each cell; a cell fails below `least`."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.count_if(good) / F.count("*")).alias("rate"))
    return out.withColumn("passed", F.col("rate") >= least)


def spread_gate(cells: DataFrame, keys: Sequence[str], value: str, most: float) -> DataFrame:
    """Largest less least value of the cells of each key; a spread of `most` and more fails."""
    out = cells.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread"))
    return out.withColumn("passed", F.col("spread") < most)


def ceilings(df: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    """Cells in which all rows are hits (one) or none is (zero); else null."""
    out = df.groupBy(*keys).agg(F.min(hit.cast("int")).alias("__low"), F.max(hit.cast("int")).alias("__high"), F.count("*").alias("n"))
    return out.select(*keys, "n", F.when(F.col("__low") == 1, "one").when(F.col("__high") == 0, "zero").alias("ceiling"))


def first_below(df: DataFrame, keys: Sequence[str], step: str, loss: str, threshold: float) -> DataFrame:
    """The first step of each key with a loss strictly below the threshold, or null."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(loss) < threshold, F.col(step))).alias("first_step"))


def first_passing(df: DataFrame, keys: Sequence[str], candidate: str, rank: str, passed: Column) -> DataFrame:
    """The first candidate in declared order that passes, or null."""
    return df.groupBy(*keys).agg(F.min_by(F.when(passed, F.col(candidate)), F.when(passed, F.col(rank))).alias("chosen"))


def drop_reasons(df: DataFrame, keys: Sequence[str], reasons: dict[str, Column]) -> DataFrame:
    """Rows, dropped rows and counts of each reason; reasons overlap, so their sum can exceed the dropped rows."""
    any_of = F.lit(False)
    for c in reasons.values():
        any_of = any_of | c
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(any_of).alias("dropped"), *(F.count_if(c).alias(k) for k, c in reasons.items()))


def offsets(df: DataFrame, keys: Sequence[str], parsed: str, truth: str) -> DataFrame:
    """How often each difference of answer and truth occurs among wrong answers that were read."""
    rows = df.where(F.col(parsed).isNotNull() & (F.col(parsed) != F.col(truth)))
    return rows.groupBy(*keys, (F.col(parsed) - F.col(truth)).alias("offset")).agg(F.count("*").alias("n"))
