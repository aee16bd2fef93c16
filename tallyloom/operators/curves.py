"""Crossings by scope, answers near a tie, limits of power, margins of equivalence and rates that random effects average out."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import stats
from tallyloom.functions.bind import let

MIXED, POLARITIES = "mixed", ("gt", "lt")


def scoped_crossings(rows: DataFrame, keys: Sequence[str], theta: str, polarity: str = "polarity", answer: str = "answer") -> DataFrame:
    """(keys, scope, kind, crossing): where answers change, over both polarities together (`mixed`) and over each. Another polarity is an error.

    Rows become counts by theta and polarity before scopes multiply them, so what is exploded is as small as the grid.
    """
    known = F.when(F.col(polarity).isin(*POLARITIES), F.col(polarity)).otherwise(F.raise_error(F.lit("no such polarity")).cast("string"))
    hits = rows.select(*keys, F.col(theta).alias("theta"), known.alias("__p"), stats.aligned(F.col(polarity), F.col(answer)).alias("__hit"))
    counts = stats.theta_counts(hits, [*keys, "__p"], "theta", "__hit")
    scopes = counts.withColumn("scope", F.explode(F.array(F.lit(MIXED), F.col("__p"))))
    return stats.locate_crossings(scopes.groupBy(*keys, "scope", "theta").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), [*keys, "scope"])


def kinds_by_scope(crossings: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Cells of each scope, and how many are of each kind, zeros included."""
    return crossings.groupBy("scope").agg(F.count("*").alias("n_cells"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def sides_without_near_ties(rows: DataFrame, keys: Sequence[str], theta: str, low: float, high: float, gap: str, margin: float, correct: Column) -> DataFrame:
    """(keys, side, n, n_near_tie, n_correct, correct_rate) of answers at thetas up to `low` and from `high` on.

    An answer whose gap is within the margin, bounds included, is near a tie; correctness is of the others, and null where none is left. A null gap, or a side without any answer, is an error.
    """
    side = F.when(F.col(theta) <= low, "low").when(F.col(theta) >= high, "high")
    known = F.when(F.col(gap).isNull() | F.isnan(gap), F.raise_error(F.lit("an answer has no gap")).cast("double")).otherwise(F.col(gap))
    far = rows.select(*keys, side.alias("__side"), (F.abs(known) <= margin).alias("__near"), correct.alias("__ok"))
    on = lambda s: F.col("__side") == s
    counts = lambda s: (F.count_if(on(s)).alias("n"), F.count_if(on(s) & F.col("__near")).alias("n_near_tie"), F.count_if(on(s) & ~F.col("__near") & F.col("__ok")).alias("hits"))
    both = far.groupBy(*keys).agg(F.array(*(F.struct(F.lit(s).alias("side"), *counts(s)) for s in ("low", "high"))).alias("__both")).select(*keys, F.inline("__both"))
    left = F.col("n") - F.col("n_near_tie")
    n = F.when(F.col("n") == 0, F.raise_error(F.concat(F.lit("no answer on the side "), F.col("side"))).cast("long")).otherwise(F.col("n"))
    return both.select(*keys, "side", n.alias("n"), "n_near_tie", F.when(left > 0, F.col("hits")).alias("n_correct"), F.try_divide("hits", left).alias("correct_rate"))


def power_limits(points: DataFrame, keys: Sequence[str], axis: str, power: str, target: float, descending: bool = False) -> DataFrame:
    """(keys, last_holding, first_failing, non_monotone, verdict) along an axis, from the end where power is high; grid points only, nothing between.

    `everywhere` where no point fails, `nowhere` where the first one does, else `inside`; non_monotone where a later point holds again. A group is an axis of a grid.
    """
    order = F.col(axis).desc() if descending else F.col(axis).asc()
    up_to = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    fails = F.when(F.col(power) >= target, 0).otherwise(1)
    rows = points.withColumn("__n", F.sum(fails).over(up_to)).withColumn("__holds", F.col(power) >= target)
    place = F.col(axis) * (-1 if descending else 1)
    out = rows.groupBy(*keys).agg(
        F.max_by(axis, F.when(F.col("__n") == 0, place)).alias("last_holding"),
        F.min_by(axis, F.when(F.col("__n") > 0, place)).alias("first_failing"),
        F.coalesce(F.bool_or((F.col("__n") > 0) & F.col("__holds")), F.lit(False)).alias("non_monotone"),
    )
    return out.withColumn("verdict", F.when(F.col("first_failing").isNull(), "everywhere").when(F.col("last_holding").isNull(), "nowhere").otherwise("inside"))


def equivalence_margin(estimates: Sequence[str], errors: Sequence[str], z: float) -> Column:
    """The least bound that holds every interval of estimate and error; a missing one is an error."""
    parts = [stats.margin(F.col(e), F.col(s), z) for e, s in zip(estimates, errors, strict=True)]
    lacks = parts[0].isNull()
    for p in parts[1:]:
        lacks = lacks | p.isNull()
    most = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return F.when(lacks, F.raise_error(F.lit("an estimate or its error is missing")).cast("double")).otherwise(most)


def marginal_rate(eta: Column, variance: Column, nodes: int) -> Column:
    """The mean of the logistic function over a normal effect of that variance, by Gauss-Hermite quadrature; an infinite eta gives 1 or 0. A variance below zero is an error."""
    x, w = np.polynomial.hermite.hermgauss(nodes)
    spread = F.when(variance < 0, F.raise_error(F.lit("a variance is below zero")).cast("double")).otherwise(F.sqrt(2 * variance))
    grid = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b) / math.sqrt(math.pi)).alias("w")) for a, b in zip(x, w)))
    return let(F.struct(eta.alias("eta"), spread.alias("spread")), lambda v: F.aggregate(grid, F.lit(0.0), lambda s, g: s + g.w / (1 + F.exp(-(v.eta + v.spread * g.x)))))


def solve_level(target: Column, variance: Column, nodes: int, low: float = -40.0, high: float = 40.0, steps: int = 70) -> Column:
    """The eta whose marginal_rate() is the target, by bisection between two bounds; the rate grows with eta, so there is one at most.

    An error: a target that is not between 0 and 1, or a bracket at whose ends the rate is on the same side of the target. Null where target or variance is.
    """
    x, w = np.polynomial.hermite.hermgauss(nodes)
    w = w / math.sqrt(math.pi)

    def rate(eta: np.ndarray, spread: np.ndarray) -> np.ndarray:
        total = np.zeros(len(spread))
        for at, weight in zip(x, w):
            total += weight / (1 + np.exp(-(eta + spread * at)))
        return total

    @F.pandas_udf("double")
    def solved(targets: pd.Series, variances: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            target, spread = targets.to_numpy("float64"), np.sqrt(2 * variances.to_numpy("float64"))
            a, b = np.full(len(target), float(low)), np.full(len(target), float(high))
            apart = (rate(a, spread) < target) & (rate(b, spread) > target)
            for _ in range(steps):
                mid = (a + b) / 2
                below = rate(mid, spread) < target
                a, b = np.where(below, mid, a), np.where(below, b, mid)
            return pd.Series(np.where(apart, (a + b) / 2, np.nan))

    fail = lambda text: F.raise_error(F.lit(text)).cast("double")
    target, variance = target.cast("double"), variance.cast("double")
    found = F.coalesce(F.nanvl(solved(target, variance), F.lit(None).cast("double")), fail("no eta in the bracket has the rate"))
    outside = (target <= 0) | (target >= 1)
    return F.when(target.isNull() | variance.isNull(), F.lit(None).cast("double")).when(outside, fail("a rate must be between 0 and 1")).when(variance < 0, fail("a variance is below zero")).otherwise(found)


def solve_null_cells(cells: DataFrame, keys: Sequence[str], task: str, coverage: str, ceiling, reference, eta: str, variance: str, nodes: int) -> DataFrame:
    """(keys, task, coverage, eta, solved): the eta of every cell but those of the ceiling task and of the reference coverage, such that its marginal rate differs from its task's reference cell by as
    much as the ceiling task's does: no interaction on the scale of probability. A task or coverage without its reference cell is an error."""
    rates = cells.withColumn("__r", marginal_rate(F.col(eta), F.col(variance), nodes))
    base = rates.where(F.col(coverage) == reference).select(*keys, task, F.col("__r").alias("__base"))
    top = rates.where(F.col(task) == ceiling).select(*keys, coverage, F.col("__r").alias("__top"))
    top_base = top.where(F.col(coverage) == reference).select(*keys, F.col("__top").alias("__top_base"))
    rest = rates.where((F.col(task) != ceiling) & (F.col(coverage) != reference))
    rest = rest.join(base, [*keys, task], "left").join(top, [*keys, coverage], "left")
    rest = rest.join(top_base, list(keys), "left") if keys else rest.crossJoin(top_base)  # a single row
    target = F.coalesce(F.col("__base") + F.col("__top") - F.col("__top_base"), F.raise_error(F.lit("a reference cell is missing")).cast("double"))
    return rest.select(*keys, task, coverage, eta, solve_level(target, F.col(variance), nodes).alias("solved"))


def closed_gates(df: DataFrame, count: str, n: str, level: float, above: float) -> DataFrame:
    """Adds lower (the exact one-sided bound of count of n; null where n is 0), evaluable and closed: whether the bound is above the threshold."""

    @F.pandas_udf("double")
    def bound(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([stats.exact_lower(int(k), int(m), level) if m else None for k, m in zip(ks, ns)], dtype="float64")

    out = df.withColumn("lower", F.nanvl(bound(count, n), F.lit(None).cast("double"))).withColumn("evaluable", F.col(n) > 0)
    return out.withColumn("closed", F.coalesce(F.col("lower") > above, F.lit(False)))


def mean_matches(differences: DataFrame, value: str, estimate: float, tolerance: float) -> None:
    """Stops where the mean of the pairs' differences is not the estimate they are to add up to, or where there are none."""
    mean = differences.agg(F.avg(value)).first()[0]
    if mean is None or not math.isclose(mean, estimate, rel_tol=0.0, abs_tol=tolerance):
        raise ValueError(f"the pairs' mean is {mean}, the estimate {estimate}")
