"""The staged analysis of many frames in one plan: gate quantities, eligibility, degrees of freedom, ceilings, fits and verdicts, and the same again for the runs that pass the gate.

Rows are counted once, by run and cell; both branches and all stages go on from these counts, so the size of a frame matters for one aggregate only. Models are fitted outside: their results come as a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import stats

# Verdicts in the order in which they are given, reasons, branches, and the least degrees of freedom.
DF_SHORT, CEILING, FIT_FAILED, OK, GATE = "df", "ceiling", "fit_failed", "ok", "gate"
LOW_REFERENCE, DROPPED_BEFORE = "low reference rate", "dropped before"
MAIN, SENSITIVITY = "main", "sensitivity"
BASELINE, LEAST_DF = "id", 2


@dataclass(frozen=True)
class Plan:
    """Declared before anything is looked at: cells, the reference condition with its least correct rate, and the gate (a task's rule rate on the baseline, and how many runs must pass)."""

    tasks: tuple[str, ...]
    coverages: tuple[str, ...]
    reference: str
    least_correct: float
    gate_task: str
    gate_threshold: float
    gate_runs: int


def cell_counts(frame: DataFrame, keys: Sequence[str], plan: Plan) -> DataFrame:
    """(keys, condition, run_id, seed, task, coverage, n, n_rule, n_correct) of the declared cells of frame(condition, run_id, seed, task, coverage, is_rule, classification); rows without a seed are left out."""
    rows = frame.where(F.col("task").isin(*plan.tasks) & F.col("coverage").isin(*plan.coverages) & F.col("seed").isNotNull())
    return rows.groupBy(*keys, "condition", "run_id", "seed", "task", "coverage").agg(F.count("*").alias("n"), F.sum(F.col("is_rule").cast("long")).alias("n_rule"), F.count_if(F.col("classification") == "correct").alias("n_correct"))


def gate_quantities(counts: DataFrame, keys: Sequence[str], plan: Plan) -> DataFrame:
    """(keys, run_id, n, rule_rate, passes): each run's rule rate in the gate's cell, and whether it is at the threshold or above. A run without a row there is an error; reference runs have no gate."""
    gate = (F.col("task") == plan.gate_task) & (F.col("coverage") == BASELINE)
    some = counts.where(F.col("condition") != plan.reference).groupBy(*keys, "run_id").agg(F.sum(F.when(gate, F.col("n"))).alias("n"), F.sum(F.when(gate, F.col("n_rule"))).alias("__k"))
    lacks = lambda t: F.raise_error(F.concat(F.lit("no row for the gate in run "), F.col("run_id").cast("string"))).cast(t)
    checked = lambda c, t: F.when(F.col("n").isNull(), lacks(t)).otherwise(c)
    rate = F.col("__k") / F.col("n")
    return some.select(*keys, "run_id", checked(F.col("n"), "long").alias("n"), checked(rate, "double").alias("rule_rate"), checked(rate >= plan.gate_threshold, "boolean").alias("passes"))


def eligible_cells(counts: DataFrame, dropped: DataFrame, keys: Sequence[str], plan: Plan) -> DataFrame:
    """(keys, task, coverage, correct_rate, reason) of every declared cell: the mean over the reference condition's seeds of their correct rates, and why the cell is left out, null where it is kept.

    dropped(task, coverage) was decided before. A declared cell without reference rows is an error.
    """
    spark = counts.sparkSession
    declared = spark.createDataFrame([(t, c) for t in plan.tasks for c in plan.coverages], "task string, coverage string")
    grid = counts.select(*keys).distinct().crossJoin(declared)  # a dozen cells for each analysis
    by_seed = counts.where(F.col("condition") == plan.reference).groupBy(*keys, "task", "coverage", "seed").agg((F.sum("n_correct") / F.sum("n")).alias("__r"))
    rates = by_seed.groupBy(*keys, "task", "coverage").agg(F.avg("__r").alias("correct_rate"))
    gone = dropped.select("task", "coverage", F.lit(True).alias("__gone")).distinct()
    rows = grid.join(rates, [*keys, "task", "coverage"], "left").join(gone, ["task", "coverage"], "left")
    lacks = F.raise_error(F.concat_ws(".", F.lit("no reference rows in cell "), "task", "coverage"))
    reason = F.concat_ws("; ", F.when(F.col("correct_rate") < plan.least_correct, LOW_REFERENCE), F.when(F.col("__gone"), DROPPED_BEFORE))
    reason = F.when(F.col("correct_rate").isNull(), lacks.cast("string")).otherwise(F.nullif(reason, F.lit("")))
    return rows.select(*keys, "task", "coverage", "correct_rate", reason.alias("reason"))


def degrees_of_freedom(cells: Column) -> Column:
    """Of the interaction over an array of cells (task, coverage), a dozen at most: cells less the rank of the main effects."""

    @F.pandas_udf("long")
    def of(some: pd.Series) -> pd.Series:
        return pd.Series([full - main for main, full in (stats.design_rank([(c["task"], c["coverage"]) for c in cs]) for cs in some)], dtype="int64")

    return of(cells)


def verdict_of(df: Column, ceiling: Column, fit_failed: Column) -> Column:
    """The first that applies: too few degrees of freedom, a ceiling, a fit that failed or is not there; else ok."""
    return F.when(df < LEAST_DF, DF_SHORT).when(ceiling, CEILING).when(F.coalesce(fit_failed, F.lit(True)), FIT_FAILED).otherwise(OK)


def analyse(frame: DataFrame, fits: DataFrame, dropped: DataFrame, keys: Sequence[str], plan: Plan, apply_gate: bool = True) -> DataFrame:
    """One report row for each analysis and branch: keys, branch, verdict, n_seeds, n_rows, dropped, df, ceiling, n_runs_passed, p_value.

    The main branch takes all runs but the reference's. Where the gate is applied, the sensitivity branch takes those that pass it, and has the verdict `gate` and nothing else where they are fewer than
    declared; the gate changes nothing of the main branch, nor which cells are eligible. dropped: the cells left out with their reasons, in order. ceiling: the kept cells in which all answers
    follow the rule or none does. fits(keys, branch, fit_failed, df, p_value) are looked up only where there are degrees of freedom enough; a fit whose df is not the design's is an error.
    p_value is shown only where the verdict is ok.
    """
    counts = cell_counts(frame, keys, plan)
    passed = gate_quantities(counts, keys, plan)
    cells = eligible_cells(counts, dropped, keys, plan)
    label = F.concat_ws(".", "task", "coverage")
    kept = cells.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat(label, F.lit(": "), F.col("reason"))))), ", ").alias("dropped"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("task", "coverage")))).alias("__cells"),
    )
    kept = kept.withColumn("df", degrees_of_freedom(F.col("__cells"))).drop("__cells")
    used = counts.where(F.col("condition") != plan.reference).join(passed.select(*keys, "run_id", "passes"), [*keys, "run_id"])
    used = used.join(cells.where("reason is null").select(*keys, "task", "coverage", F.lit(True).alias("__kept")), [*keys, "task", "coverage"], "left")
    branches = [F.lit(MAIN), *([F.when(F.col("passes"), SENSITIVITY)] if apply_gate else [])]
    rows = used.withColumn("branch", F.explode(F.array_compact(F.array(*branches))))
    by_cell = rows.groupBy(*keys, "branch", "task", "coverage").agg(F.sum(F.when(F.col("__kept"), F.col("n"))).alias("__n"), F.sum(F.when(F.col("__kept"), F.col("n_rule"))).alias("__k"), F.collect_set("seed").alias("__seeds"), F.collect_set("run_id").alias("__runs"))
    at_end = F.when((F.col("__k") == 0) | (F.col("__k") == F.col("__n")), label)
    found = by_cell.groupBy(*keys, "branch").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("__seeds")))).cast("long").alias("n_seeds"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.array_join(F.array_sort(F.collect_list(at_end)), ", ").alias("ceiling"),
        F.size(F.array_distinct(F.flatten(F.collect_list("__runs")))).cast("long").alias("__n_runs"),
    )
    gates = passed.groupBy(*keys).agg(F.count_if("passes").alias("n_runs_passed"))
    every = kept.join(gates, list(keys)).withColumn("branch", F.explode(F.lit([MAIN, SENSITIVITY] if apply_gate else [MAIN])))
    out = every.join(found, [*keys, "branch"], "left").join(fits.select(*keys, "branch", "fit_failed", F.col("df").alias("__df"), F.col("p_value").alias("__p")), [*keys, "branch"], "left")
    same = F.col("fit_failed") | (F.col("__df") == F.col("df"))
    checked = F.when((F.col("df") >= LEAST_DF) & ~same, F.raise_error(F.lit("a fit's degrees of freedom are not the design's")).cast("boolean")).otherwise(F.col("fit_failed"))
    short = (F.col("branch") == SENSITIVITY) & (F.col("n_runs_passed") < plan.gate_runs)
    out = out.withColumn("verdict", F.when(short, GATE).otherwise(verdict_of(F.col("df"), F.col("ceiling") != "", checked)))
    shown = lambda c, t: F.when(short, F.lit(None).cast(t)).otherwise(F.col(c)).alias(c)
    return out.select(
        *keys, "branch", "verdict", shown("n_seeds", "long"), shown("n_rows", "long"), shown("dropped", "string"), shown("df", "long"), shown("ceiling", "string"),
        F.when(F.lit(apply_gate), F.col("n_runs_passed")).alias("n_runs_passed"), F.when(F.col("verdict") == OK, F.col("__p")).alias("p_value"),
    )


def require_one_value(reports: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The reports of several runs as they are, unless they disagree on a declared value (a threshold, the tasks they solved) or two are of one run: errors that name the column."""
    checks = [F.when(F.count_distinct(F.coalesce(F.to_json(F.struct(c)), F.lit(""))) > 1, F.lit(c)) for c in columns]
    twice = F.when(F.count_distinct("run_id") < F.count("*"), F.lit("run_id"))
    bad = reports.agg(F.concat_ws(", ", *checks, twice).alias("__bad"))  # a single row
    ok = F.when(F.col("__bad") != "", F.raise_error(F.concat(F.lit("reports disagree: "), F.col("__bad"))).cast("boolean")).otherwise(F.lit(True))
    return reports.crossJoin(bad).where(ok).drop("__bad")


def changed_fields(reports: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Runs that declare one of these fields, which a plain run must not have: no rows where all is well."""
    named = F.filter(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return reports.select("run_id", named.alias("fields")).where(F.size("fields") > 0)
