"""Profiles that refuse what they cannot describe: rates of stored labels, cells of a required grid, first tokens, lengths of paired arms, written sums, biases over declared symbols, confirmed cells and fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import parsing, rules, stats

from .scoring import CLASSES

# Tasks whose truth is not the sum.
DIFFERENCE, PRODUCT = "spec_sub", "spec_mul"


def fail(text: str, *more: Column) -> Column:
    return F.raise_error(F.concat(F.lit(text), *(F.coalesce(c.cast("string"), F.lit("null")) for c in more)))


def truth_and_rule(group: Column, a: Column, b: Column, offset: int, repeats: Column | None = None) -> Column:
    """struct(truth, rule) of an item by its group: differences and products have their own truths and rules of the same offset; any other group asks for the sum, whose rule may be applied several times."""
    total = F.when(group == DIFFERENCE, a - b).when(group == PRODUCT, a * b).otherwise(a + b)
    times = F.when(group.isin(DIFFERENCE, PRODUCT), F.lit(1)).otherwise(F.lit(1) if repeats is None else repeats)
    return F.struct(total.cast("long").alias("truth"), rules.repeated_offset(total, offset, times).cast("long").alias("rule"))


def four_values(rows: DataFrame, keys: Sequence[str], label: str = "classification") -> DataFrame:
    """n_items and the four rates of stored labels. A label that is null or none of the four is an error; so is a table without a row, where there are no keys."""
    known = F.when(F.col(label).isin(*CLASSES), F.col(label)).otherwise(fail("no such class: ", F.col(label)).cast("string"))
    n = F.count("*")
    some = n if keys else F.when(n == 0, fail("no rows").cast("bigint")).otherwise(n)
    return rows.withColumn("__c", known).groupBy(*keys).agg(some.alias("n_items"), *((F.count_if(F.col("__c") == c) / n).alias(f"{c}_rate") for c in CLASSES))


def cell_table(rows: DataFrame, keys: Sequence[str], task: str, tasks: Sequence[str], coverage: str, coverages: Sequence[str], least: float, label: str = "classification") -> DataFrame:
    """Rates of every cell of a required grid, and fails: whether correct answers are fewer than `least`. A cell without an answer is an error; cells beyond the grid are left out."""
    grid = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    grid = grid.withColumn(task, F.explode(F.lit(list(tasks)))).withColumn(coverage, F.explode(F.lit(list(coverages))))
    found = four_values(rows.where(F.col(task).isin(*tasks) & F.col(coverage).isin(*coverages)), [*keys, task, coverage], label)
    out = grid.join(found, [*keys, task, coverage], "left")
    n = F.when(F.col("n_items").isNull(), fail("no answers in cell ", F.concat_ws(".", task, coverage)).cast("bigint")).otherwise(F.col("n_items"))
    fails = F.when(F.col("n_items").isNull(), fail("no answers in cell ", F.concat_ws(".", task, coverage)).cast("boolean")).otherwise(F.col("correct_rate") < least)
    return out.select(*keys, task, coverage, n.alias("n_items"), *(f"{c}_rate" for c in CLASSES), fails.alias("fails"))


def first_tokens(records: DataFrame, keys: Sequence[str], top: str = "top_k") -> DataFrame:
    """(keys, text, n): how often each text comes first among a record's most likely tokens. A record without tokens is an error."""
    first = F.get(F.col(top), 0)
    text = F.when(first.isNull() | first["text"].isNull(), fail("a record without tokens").cast("string")).otherwise(first["text"])
    return records.groupBy(*keys, text.alias("text")).agg(F.count("*").alias("n"))


def length_record(value: Column) -> list[Column]:
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")]


def paired_lengths(rows: DataFrame, keys: Sequence[str], arm: str, first: str, second: str, item: str, length: Column) -> DataFrame:
    """n, mean, least and most of the first arm's length less the second's, item by item; every item of the second arm must be in the first, once in each: errors else."""
    side = lambda which, name: rows.where(F.col(arm) == which).groupBy(*keys, item).agg(F.when(F.count("*") > 1, fail("an arm has an item twice: ", F.first(item)).cast("bigint")).otherwise(F.max(length).cast("bigint")).alias(name))
    both = side(second, "__y").join(side(first, "__x"), [*keys, item], "left")
    gap = F.when(F.col("__x").isNull(), fail("the other arm lacks an item: ", F.col(item)).cast("bigint")).otherwise(F.col("__x") - F.col("__y"))
    return both.groupBy(*keys).agg(*length_record(gap))


def expression_counts(rows: DataFrame, keys: Sequence[str], text: str, a: Column, b: Column) -> DataFrame:
    """Answers, and those that write the operands' sum in either order."""
    written = parsing.writes_sum(F.col(text), a, b)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(written).alias("n_written"))


def content_free_bias(rows: DataFrame, keys: Sequence[str], symbol: str, symbols: Sequence[str], yes: str, no: str) -> DataFrame:
    """(keys, bias): the logarithm of the mean probability of yes over the symbols less that of no. Each declared symbol must be there once, and no other: errors else, as is a bias that is not finite."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.array_sort(F.collect_set(symbol)).alias("__s"))
    declared = F.array_sort(F.lit(sorted(set(symbols))))
    wrong = (F.col("__n") != len(set(symbols))) | (F.col("__s") != declared)
    both = stats.log_mean_exp(rows, keys, yes, "__y").join(stats.log_mean_exp(rows, keys, no, "__o"), list(keys)) if keys else stats.log_mean_exp(rows, keys, yes, "__y").crossJoin(stats.log_mean_exp(rows, keys, no, "__o"))
    out = counts.join(both, list(keys), "left") if keys else counts.crossJoin(both)
    bias = F.col("__y") - F.col("__o")
    finite = bias.isNotNull() & ~F.isnan(bias) & (F.abs(bias) < float("inf"))
    checked = F.when(wrong, fail("not the declared symbols: ", F.array_join("__s", ",")).cast("double")).when(~finite, fail("a bias is not finite").cast("double")).otherwise(bias)
    return out.select(*keys, checked.alias("bias"))


def confirmed_cells(marks: DataFrame, keys: Sequence[str], fails: str, declared: DataFrame) -> DataFrame:
    """The cells that failed in any run, if they are exactly the declared ones; a difference is an error that names the cells of each side."""
    found = marks.where(F.col(fails)).select(*keys).distinct().withColumn("__f", F.lit(True))
    both = found.join(declared.select(*keys).distinct().withColumn("__d", F.lit(True)), list(keys), "full_outer")
    name = F.concat_ws(".", *(F.col(k).cast("string") for k in keys))
    only = lambda missing: F.array_join(F.array_sort(F.collect_list(F.when(F.col(missing).isNull(), name))), ",")
    sides = both.agg(only("__d").alias("__f_only"), only("__f").alias("__d_only"))  # a single row
    bad = (F.col("__f_only") != "") | (F.col("__d_only") != "")
    ok = F.when(bad, fail("cells differ; failed only: ", F.col("__f_only"), F.lit("; declared only: "), F.col("__d_only")).cast("boolean")).otherwise(F.lit(True))
    return both.crossJoin(sides).where(ok).select(*keys)


def fit_stage_counts(results: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Fits, how many failed altogether, and how many have each flag; a null flag does not count."""
    return results.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(f).alias(f) for f in flags))


def coefficient_summary(results: DataFrame, keys: Sequence[str], coefficients: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(keys, coefficient, n, missing, mean, q_<percent>): linear quantiles of each coefficient over the fits that have it; rows are exploded once, whatever the number of coefficients."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("coefficient"), F.col(c).cast("double").alias("__v")) for c in coefficients)))
    rows = results.select(*keys, each.alias("__e")).select(*keys, "__e.*")
    named = [F.percentile("__v", q).alias(f"q_{round(100 * q)}") for q in quantiles]
    return rows.groupBy(*keys, "coefficient").agg(F.count("__v").alias("n"), F.count_if(F.col("__v").isNull()).alias("missing"), F.avg("__v").alias("mean"), *named)
