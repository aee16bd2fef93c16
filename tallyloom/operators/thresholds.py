"""Exact comparisons of rates with a line, differences by operand pair over aligned levels, and the decisions that follow.

Rates stay pairs of whole numbers, so nothing is rounded at the line. A difference of two rates is a pair of decimals of 38 digits, which holds the products of any two counts; the mean of
four of them is not bounded by that (about 100,000 answers a level have denominators of 40 digits) and is worked out in whole numbers of any size, on one row of four fractions for each key.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import stats

# The levels (polarity, theta) whose responses are compared with those `shift` below, and the names of stages and decisions.
TERMS = (("gt", 0), ("gt", 1), ("lt", 1), ("lt", 2))
BRANCH_A, PRE_FT, NO_PRE_FT = "branch_a", "pre_ft_3ii", "no_pre_ft"
KEEP, DROP, NOT_APPLICABLE = "keep_3iii", "no_3iii", "not_applicable"

WHOLE = "decimal(38,0)"


def fraction(top: Column, bottom: Column) -> Column:
    return F.struct(top.cast(WHOLE).alias("top"), bottom.cast(WHOLE).alias("bottom"))


def exact_mean(fractions: Column, line: tuple[int, int]) -> Column:
    """struct(top, bottom, reaches_line) of the mean of an array of fractions: its digits in lowest terms, whole numbers of any size, and whether it is at the line or beyond. Null if one of them is."""
    least = Fraction(*line)

    @F.pandas_udf("top string, bottom string, reaches_line boolean")
    def mean(rows: pd.Series) -> pd.DataFrame:
        means = [None if any(x is None for x in row) else sum(map(Fraction, row)) / len(row) for row in rows]
        out = [(None, None, None) if m is None else (str(m.numerator), str(m.denominator), m >= least) for m in means]
        return pd.DataFrame(out, columns=["top", "bottom", "reaches_line"], dtype=object)

    return mean(F.transform(fractions, lambda x: F.concat(x.top.cast("string"), F.lit("/"), x.bottom.cast("string"))))


def level_counts(answers: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """One row for each key: an array `terms` of the differences of TERMS as fractions, null where a level or the one `shift` below has no answer; from answers(polarity, theta, answer)."""
    hit = stats.aligned(F.col("polarity"), F.col("answer"))
    at = lambda p, t: (F.col("polarity") == p) & (F.col("theta") == t)
    counts = [(F.count_if(at(p, t)), F.count_if(at(p, t) & (hit == 1)), F.count_if(at(p, t - shift)), F.count_if(at(p, t - shift) & (hit == 1))) for p, t in TERMS]
    rows = answers.groupBy(*keys).agg(F.array(*(F.struct(n.alias("n"), k.alias("k"), m.alias("m"), j.alias("j")) for n, k, m, j in counts)).alias("__c"))
    times = lambda x, y: x.cast(WHOLE) * y.cast(WHOLE)
    term = lambda c: F.when((c.n > 0) & (c.m > 0), fraction(times(c.k, c.m) - times(c.j, c.n), times(c.n, c.m)))
    return rows.select(*keys, F.transform("__c", term).alias("terms"))


def shift_gains(answers: DataFrame, keys: Sequence[str], shift: int, line: tuple[int, int]) -> DataFrame:
    """For each key: top and bottom of the mean of the four differences in lowest terms, estimate as a number, reaches_line, and top_digits and bottom_digits; null where one of the levels has no answer.

    Digits are text and take any size. A top or bottom of more than 38 digits, which some hundred thousand answers a level can give, is an error where that column is read, and only there.
    """
    rows = level_counts(answers, keys, shift).withColumn("__mean", exact_mean(F.col("terms"), line))
    top, bottom = F.col("__mean.top"), F.col("__mean.bottom")
    whole = lambda digits: F.when(F.length(F.ltrim(F.lit("-"), digits)) > 38, F.raise_error(F.lit("more than 38 digits: read top_digits and bottom_digits")).cast(WHOLE)).otherwise(digits.cast(WHOLE))
    number = top.cast("double") / bottom.cast("double")
    return rows.select(*keys, whole(top).alias("top"), whole(bottom).alias("bottom"), number.alias("estimate"), F.col("__mean.reaches_line").alias("reaches_line"), top.alias("top_digits"), bottom.alias("bottom_digits"))


def pair_differences(answers: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """(keys, a, b, quarters): for each operand pair the sum of its four differences over the eight levels, in quarters of the pair's own gain.

    Every pair must have one answer at each of the levels: one that lacks one, or that has two, is an error. Levels that two terms share are one level.
    """
    hit = stats.aligned(F.col("polarity"), F.col("answer"))
    levels = sorted({(p, t - lag) for p, t in TERMS for lag in (0, shift)})
    at = lambda p, t: (F.col("polarity") == p) & (F.col("theta") == t)
    name = {level: f"__l{i}" for i, level in enumerate(levels)}
    wanted = answers.where(F.struct("polarity", "theta").isin([F.struct(F.lit(p).alias("polarity"), F.lit(t).cast(dict(answers.dtypes)["theta"]).alias("theta")) for p, t in levels]))
    rows = wanted.groupBy(*keys, "a", "b").agg(*(c for (p, t), n in name.items() for c in (F.count_if(at(p, t)).alias(n + "n"), F.max(F.when(at(p, t), hit)).alias(n))))
    once = F.lit(True)
    for n in name.values():
        once = once & (F.col(n + "n") == 1)
    quarters = F.lit(0)
    for p, t in TERMS:
        quarters = quarters + F.col(name[p, t]) - F.col(name[p, t - shift])
    return rows.select(*keys, "a", "b", F.when(once, quarters).otherwise(F.raise_error(F.lit("a pair does not have one answer at every level")).cast("int")).cast("long").alias("quarters"))


def gain_intervals(answers: DataFrame, keys: Sequence[str], shift: int, n_per_level: int | None = None, level: float = 0.95) -> DataFrame:
    """The interval of the pairs' gains (n, mean, low, high, standard_error, degenerate) for each key; n pairs other than n_per_level, where that is given, are an error."""
    rows = pair_differences(answers, keys, shift).withColumn("__d", F.col("quarters") / float(len(TERMS)))
    out = stats.interval_record(rows, keys, "__d", level)
    if n_per_level is None:
        return out
    return out.withColumn("n", F.when(F.col("n") == n_per_level, F.col("n")).otherwise(F.raise_error(F.lit(f"not {n_per_level} pairs")).cast("long")))


def arm_reaches(cells: DataFrame, keys: Sequence[str], coverage: str, levels: Sequence[str] | None) -> DataFrame:
    """(keys, reaches): whether the cells of all levels reach the line; None: of the levels that the arm has. An arm that lacks a level, or whose gain is null, is an error."""
    wanted = F.lit(True) if levels is None else F.col(coverage).isin(*levels)
    if levels is None:
        whole = F.count_if(F.col("reaches_line").isNull()) == 0
    else:
        whole = F.count_distinct(F.when(wanted & F.col("reaches_line").isNotNull(), F.col(coverage))) == len(levels)
    every = F.every(F.when(wanted, F.col("reaches_line")))
    return cells.groupBy(*keys).agg(F.when(whole, every).otherwise(F.raise_error(F.lit("an arm lacks a level")).cast("boolean")).alias("reaches"))


def next_stage(explicit: Column, summed: Column) -> Column:
    """struct(stage, odd) from whether the explicit and the summed arm reach the line; odd: the summed arm does and the explicit one does not. Null where one is null."""
    stage = F.when(explicit & ~summed, BRANCH_A).when(~explicit & ~summed, PRE_FT).when(summed & explicit.isNotNull(), NO_PRE_FT)
    return F.struct(stage.alias("stage"), (summed & ~explicit).alias("odd"))


def keep_decision(stage: Column, with_instruction: Column, without: Column) -> Column:
    """Whether a third arm stays: only where training comes first, and only if the arm with an instruction reaches the line and the one without does not. Null where that is not known."""
    keep = F.when(with_instruction & ~without, KEEP).when(~with_instruction | without, DROP)
    return F.when(stage != PRE_FT, NOT_APPLICABLE).when(stage == PRE_FT, keep)
