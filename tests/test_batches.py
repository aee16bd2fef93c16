"""Batches that answers are scored in, and hashes of tables that do not depend on partitions."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import batches, compare

ITEMS = "`group` string, category string, operands array<bigint>, rule_values map<string,bigint>, parsed bigint, truth bigint"
CONTROLS = {"control": {"sub": "spec_sub"}}


def scored(spark, rows, binary=("cmp",)):
    items = batches.with_batches(spark.createDataFrame(rows, ITEMS), CONTROLS, "p2", 9)
    return {(r.batch, r.reference_rule): r for r in batches.batch_records(items, list(binary)).collect()}


def test_batches_by_category_and_by_range(spark):
    rows = [
        ("sum", "t1", [3, 4], {"p2": 9, "arb": 8}, 9, 7), ("sum", "t1", [1, 1], {"p2": 4, "arb": 4}, None, 2), ("sum", "t1", [30, 4], {"p2": 36}, 34, 34), ("control", "sub", [9, 1], {"spec_sub": 10}, 8, 8),
        ("cmp", "t3", [3, 4], {"p2": 0}, 1, 1), ("cmp", "t3", [3, 5], {"p2": 1}, 1, 0),
    ]
    got = scored(spark, rows)
    assert set(got) == {("sum", "p2"), ("sum", "arb"), ("sum.ans_out", "p2"), ("sub", "spec_sub"), ("cmp", "p2")}
    s, c = got["sum", "p2"], got["cmp", "p2"]
    assert (s.n_items, s.rule_rate, s.parse_fail_rate, s.batch_rule, s.always_yes_correct) == (2, 0.5, 0.5, "p2", None) and got["sum", "arb"].other_error_rate == 0.5
    assert (c.correct_rate, c.rule_rate, c.always_yes_correct, c.always_yes_rule, c.always_no_correct, c.always_no_rule) == (0.5, 0.5, 0.5, 0.5, 0.5, 0.5)


def test_batches_that_mix_are_errors(spark):
    good = ("sum", "t1", [3, 4], {"p2": 9, "arb": 8}, 9, 7)
    for bad, what in (
        (("sum", "t1", [3, 4], {"p2": 9}, 9, 7), "different rules"), (("sum", "t1", [3, 4], {"arb": 9}, 9, 7), "no value"), (("sum", "t1", [3], {"p2": 9}, 9, 7), "two operands"), (("sum", "t1", [3, 4], None, 9, 7), "no value|different rules"),
        (("control", "mul", [3, 4], {"spec_mul": 9}, 9, 7), "without a rule"), (("cmp", "t3", [3, 4], {"p2": 0}, None, 1), "besides yes and no"),
    ):
        with pytest.raises(Exception, match=what):
            scored(spark, [good, bad])


def test_a_hash_of_rows_whatever_the_partitions(spark):
    df = spark.range(3000).select("id", (F.col("id") % 700).cast("string").alias("s"))
    of = lambda d, depth=2: compare.trie_hash(d, F.col("s"), depth).first()
    one = of(df.coalesce(1))
    assert one.n == 3000 and of(df.repartition(64)) == one and of(df.orderBy(F.desc("id"))) == one
    assert of(df.where("id <> 5")).hash != one.hash and of(df.union(df.limit(1))).hash != one.hash and of(df, 0).n == 3000
    empty = of(df.limit(0))
    assert (empty.n, empty.hash) == (0, None)
    stream = lambda d: compare.ordered_hash(d, F.col("id"), F.col("s"), 1).first().hash
    swapped = df.withColumn("id", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("id")))
    assert stream(df.repartition(7)) == stream(df) != stream(swapped)
