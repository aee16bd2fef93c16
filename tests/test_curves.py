"""Crossings by scope, limits, margins and gates on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import curves


def test_scopes_of_a_cell(spark):
    # gt items say no from 1 on, lt items yes from 0 on; "other" answers one way only
    rows = [("c", t, "gt", t < 1) for t in range(-3, 4)] + [("c", t, "lt", t >= 0) for t in range(-3, 4)] + [("other", t, "lt", False) for t in range(3)]
    found = curves.scoped_crossings(spark.createDataFrame(rows, "cell string, offset int, polarity string, answer boolean"), ["cell"], "offset")
    got = {(r.cell, r.scope): (r.kind, r.crossing) for r in found.collect()}
    assert got == {
        ("c", "mixed"): ("staircase", 0.0), ("c", "gt"): ("staircase", 0.5), ("c", "lt"): ("staircase", -0.5), ("other", "mixed"): ("one_sided_0", None), ("other", "lt"): ("one_sided_0", None)
    }
    kinds = {r.scope: (r.n_cells, r.staircase, r.one_sided_0, r.fit) for r in curves.kinds_by_scope(found, ["staircase", "one_sided_0", "fit"]).collect()}
    assert kinds == {"mixed": (2, 1, 1, 0), "gt": (1, 1, 0, 0), "lt": (2, 1, 1, 0)}
    with pytest.raises(Exception, match="no such polarity"):
        curves.scoped_crossings(spark.createDataFrame([("c", 1, "eq", True)], "cell string, offset int, polarity string, answer boolean"), ["cell"], "offset").collect()


def test_ties_are_counted_with_their_bounds(spark):
    rows = spark.createDataFrame([("c", -5, 2.0, True), ("c", -4, 2.1, True), ("c", -4, -3.0, False), ("c", 0, 9.0, True), ("c", 6, 0.5, True)], "cell string, theta int, gap double, ok boolean")
    got = {r.side: (r.n, r.n_near_tie, r.n_correct, r.correct_rate) for r in curves.sides_without_near_ties(rows, ["cell"], "theta", -4, 4, "gap", 2.0, F.col("ok")).collect()}
    assert got == {"low": (3, 1, 1, 0.5), "high": (1, 1, None, None)}
    with pytest.raises(Exception, match="no gap"):
        curves.sides_without_near_ties(rows.withColumn("gap", F.nullif("gap", F.lit(0.5))), ["cell"], "theta", -4, 4, "gap", 2.0, F.col("ok")).collect()


def test_limits_of_power(spark):
    data = {"all": [0.9, 0.9, 0.8], "none": [0.5, 0.9, 0.9], "some": [0.9, 0.7, 0.9], "first": [0.9, 0.8, 0.79]}
    points = spark.createDataFrame([(k, 10 * (i + 1), p) for k, v in data.items() for i, p in enumerate(v)], "k string, axis int, power double")

    def limits(**how):
        return {r.k: (r.verdict, r.last_holding, r.first_failing, r.non_monotone) for r in curves.power_limits(points, ["k"], "axis", "power", 0.8, **how).collect()}

    assert limits() == {"all": ("everywhere", 30, None, False), "none": ("nowhere", None, 10, True), "some": ("inside", 10, 20, True), "first": ("inside", 20, 30, False)}
    assert limits(descending=True) == {"all": ("everywhere", 10, None, False), "none": ("inside", 20, 10, False), "some": ("inside", 30, 20, True), "first": ("nowhere", None, 30, True)}


def test_margins_need_every_estimate(spark):
    rows = spark.createDataFrame([(0.1, -0.4, 0.1, 0.1), (None, 0.1, 0.1, 0.1)], "a double, b double, sa double, sb double")
    m = curves.equivalence_margin(["a", "b"], ["sa", "sb"], 2.0)
    assert math.isclose(rows.where("a is not null").select(m.alias("m")).first().m, 0.6)
    with pytest.raises(Exception, match="missing"):
        rows.select(m.alias("m")).collect()


def test_marginal_rates_against_a_fine_sum(spark):
    rows = spark.createDataFrame([(0.7, 1.3), (-2.0, 0.0), (float("inf"), 1.0), (0.0, 2.0)], "eta double, v double")
    got = [r.rate for r in rows.select(curves.marginal_rate(F.col("eta"), F.col("v"), 30).alias("rate")).collect()]
    zs = [i / 500 for i in range(-4000, 4001)]
    fine = sum(math.exp(-z * z / 2) / (1 + math.exp(-(0.7 + math.sqrt(1.3) * z))) for z in zs) / sum(math.exp(-z * z / 2) for z in zs)
    assert math.isclose(got[0], fine, abs_tol=1e-6) and math.isclose(got[1], 1 / (1 + math.exp(2))) and math.isclose(got[2], 1.0) and math.isclose(got[3], 0.5)
    with pytest.raises(Exception, match="below zero"):
        rows.select(curves.marginal_rate(F.col("eta"), F.lit(-1.0), 5).alias("rate")).collect()


def test_gates_close_by_the_lower_bound(spark):
    rows = spark.createDataFrame([("a", 9, 10), ("b", 1, 10), ("c", 0, 0), ("d", 0, 5)], "k string, x int, n int")
    got = {r.k: (r.lower, r.evaluable, r.closed) for r in curves.closed_gates(rows, "x", "n", 0.95, 0.5).collect()}
    # the bound of 1 of 10 solves 1 - (1 - p) ** 10 = 0.05
    assert math.isclose(got["b"][0], 1 - 0.95**0.1, rel_tol=1e-9) and got["b"][1:] == (True, False)
    assert got["a"][2] and got["c"] == (None, False, False) and got["d"] == (0.0, True, False)


def test_pairs_must_add_up_to_the_estimate(spark):
    rows = spark.createDataFrame([(0.5,), (-0.25,)], "d double")
    curves.mean_matches(rows, "d", 0.125, 1e-12)
    for bad, wanted in ((rows, 0.2), (rows.limit(0), 0.0)):
        with pytest.raises(ValueError, match="mean"):
            curves.mean_matches(bad, "d", wanted, 1e-12)
