"""What strict profiles refuse, on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import profiles


def test_stored_labels_are_those_of_the_four(spark):
    rows = spark.createDataFrame([("t1", "id", "correct"), ("t1", "id", "rule"), ("t1", "far", "correct"), ("t9", "id", None)], "task string, coverage string, classification string")
    cells = lambda df, coverages: {r.coverage: (r.n_items, r.correct_rate, r.fails) for r in profiles.cell_table(df, [], "task", ["t1"], "coverage", coverages, 0.6).collect()}
    assert cells(rows, ["id", "far"]) == {"id": (2, 0.5, True), "far": (1, 1.0, False)}
    with pytest.raises(Exception, match="no answers in cell t1.interp"):
        cells(rows, ["id", "interp"])
    for bad in ("maybe", None):
        with pytest.raises(Exception, match="no such class"):
            profiles.four_values(rows.limit(1).withColumn("classification", F.lit(bad).cast("string")), ["task"]).collect()
    with pytest.raises(Exception, match="no rows"):
        profiles.four_values(rows.limit(0), []).collect()


def test_records_need_tokens_and_arms_the_same_items(spark):
    kind = "k string, top_k array<struct<text:string,logprob:double>>"
    rows = spark.createDataFrame([("a", [("Yes", -0.1), ("No", -2.0)]), ("a", [("Yes", -0.2)]), ("b", [("No", -0.1)])], kind)
    assert sorted(map(tuple, profiles.first_tokens(rows, ["k"]).collect())) == [("a", "Yes", 2), ("b", "No", 1)]
    for bad in ([], None):
        with pytest.raises(Exception, match="without tokens"):
            profiles.first_tokens(spark.createDataFrame([("a", bad)], kind), ["k"]).collect()
    arms = [("A", "i", 10), ("A", "j", 14), ("B", "i", 7), ("A", "x", 99)]
    of = lambda some: [tuple(r) for r in profiles.paired_lengths(spark.createDataFrame(some, "arm string, item string, n int"), [], "arm", "A", "B", "item", F.col("n")).collect()]
    assert of([*arms, ("B", "j", 15)]) == [(2, 1.0, -1, 3)]
    for bad, what in (([*arms, ("B", "z", 1)], "lacks an item: z"), ([*arms, ("B", "i", 1)], "twice: i")):
        with pytest.raises(Exception, match=what):
            of(bad)


def test_biases_need_each_symbol_once(spark):
    rows = [("k", "", -1.0, -2.0), ("k", "N/A", -3.0, -2.5)]
    of = lambda some: [r.bias for r in profiles.content_free_bias(spark.createDataFrame(some, "k string, symbol string, yes double, no double"), ["k"], "symbol", ["N/A", ""], "yes", "no").collect()]
    want = math.log((math.exp(-1) + math.exp(-3)) / 2) - math.log((math.exp(-2) + math.exp(-2.5)) / 2)
    assert abs(of(rows)[0] - want) < 1e-12
    for bad in (rows[:1], [*rows, rows[0]], [rows[0], ("k", "other", 0.0, 0.0)]):
        with pytest.raises(Exception, match="declared symbols"):
            of(bad)
    with pytest.raises(Exception, match="not finite"):
        of([("k", "", -math.inf, -2.0), ("k", "N/A", -math.inf, -2.0)])


def test_cells_are_the_confirmed_ones(spark):
    marks = spark.createDataFrame([("r1", "t1", "id", True), ("r2", "t1", "id", False), ("r2", "t2", "far", True), ("r1", "t2", "id", None)], "run string, task string, coverage string, fails boolean")
    declared = spark.createDataFrame([("t1", "id"), ("t2", "far")], "task string, coverage string")
    assert sorted(map(tuple, profiles.confirmed_cells(marks, ["task", "coverage"], "fails", declared).collect())) == [("t1", "id"), ("t2", "far")]
    with pytest.raises(Exception, match="failed only: t2.far; declared only: t9.id"):
        profiles.confirmed_cells(marks, ["task", "coverage"], "fails", spark.createDataFrame([("t1", "id"), ("t9", "id")], "task string, coverage string")).collect()
    assert profiles.confirmed_cells(marks.where("not fails"), ["task", "coverage"], "fails", declared.limit(0)).count() == 0


def test_fits_are_counted_by_their_flags(spark):
    rows = spark.createDataFrame([("p", True, False), ("p", False, None), ("q", True, True)], "k string, reduced boolean, failed boolean")
    assert sorted(map(tuple, profiles.fit_stage_counts(rows, ["k"], ["reduced", "failed"]).collect())) == [("p", 2, 1, 0), ("q", 1, 1, 1)]
