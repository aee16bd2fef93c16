"""One long frame from many runs that were trained on different pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules

from .reports import MAIN_COVERAGES


def pair_labels(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(pairs_hash, a, b, known, mirror_in_K, t_seen) of the distinct asked(pairs_hash, a, b) against the training pairs known(pairs_hash, a, b) of the same hash.

    A square of operands bounds the distinct pairs of a hash, so what is joined three times here is small beside the answers, which join its result once.
    """
    pairs = asked.select("pairs_hash", "a", "b").where("pairs_hash is not null").distinct()
    member = known.select("pairs_hash", "a", "b", F.lit(True).alias("known")).distinct()
    mirror = known.select("pairs_hash", F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("__m")).where("a <> b").distinct()
    sums = known.select("pairs_hash", (F.col("a") + F.col("b")).alias("__t"), F.lit(True).alias("__s")).distinct()
    out = pairs.withColumn("__t", F.col("a") + F.col("b")).join(member, ["pairs_hash", "a", "b"], "left").join(mirror, ["pairs_hash", "a", "b"], "left").join(sums, ["pairs_hash", "__t"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select("pairs_hash", "a", "b", yes("known").alias("known"), yes("__m").alias("mirror_in_K"), yes("__s").alias("t_seen"))


def frame_of_runs(answers: DataFrame, runs: DataFrame, known: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """The long frame of all runs: one row for each answer, labelled against its own run's training pairs.

    answers(run_id, item, task, template, category, group, operands, carry, parsed, truth, reference_rule, classification); runs(run_id, condition, seed, radius,
    pairs_hash), one row each; known(pairs_hash, a, b). A row is on the main axis if its task is one of `tasks`, its coverage a main one and its run has a seed. The gate's
    raw rate, that of rule answers among the run's `id` rows, is on every row of the run: null, with n = 0, where there are none. An answer without exactly two operands, or of a
    run that is not listed, is an error.
    """
    two = F.when(F.size("operands") == 2, F.col("operands")).otherwise(F.raise_error(F.concat(F.lit("not two operands: "), F.coalesce("item", F.lit("?")))).cast("array<bigint>"))
    rows = answers.withColumn("__ab", two).withColumns({"a": F.get("__ab", 0), "b": F.get("__ab", 1)}).drop("__ab", "operands")
    rows = rows.join(runs.select("run_id", "condition", "seed", "radius", F.coalesce("pairs_hash", F.lit("")).alias("pairs_hash")), "run_id", "left")
    listed = F.when(F.col("pairs_hash").isNull(), F.raise_error(F.concat(F.lit("no such run: "), F.coalesce("run_id", F.lit("null"))))).otherwise(F.col("pairs_hash"))
    rows = rows.withColumn("pairs_hash", listed)
    rows = rows.join(pair_labels(rows, known), ["pairs_hash", "a", "b"], "left")
    a, b, radius = F.col("a"), F.col("b"), F.col("radius")
    coverage = rules.main_coverage_label(a, b, F.col("known"), radius)
    rows = rows.select(
        "run_id", "condition", "seed", "item", "task", "template", "category", "group", coverage.alias("coverage"), "mirror_in_K",
        rules.answer_range(a, b, radius).alias("answer_range"), F.when(F.col("t_seen"), "t_seen").otherwise("t_unseen").alias("t_coverage"), "carry",
        (F.col("classification") == "rule").cast("int").alias("is_rule"), F.col("classification").isin("correct", "rule").cast("int").alias("in_renorm_denom"),
        "classification", "parsed", "truth", "reference_rule",
    )
    rows = rows.withColumn("main_axis", F.col("task").isin(*tasks) & F.col("coverage").isin(*MAIN_COVERAGES) & F.col("seed").isNotNull())
    on_id = F.when(F.col("coverage") == "id", F.col("is_rule"))
    gate = rows.groupBy("run_id").agg(F.avg(on_id).alias("gate_id_rule_rate"), F.count(on_id).alias("gate_id_n"))  # one row for each run
    return rows.join(gate, "run_id")


def item_set_problems(answers: DataFrame, runs: DataFrame, order: str = "run_id") -> DataFrame:
    """(run_id, reference, missing, extra): runs whose set of items is not that of the first run in order, and how many items each side lacks. No rows: runs can be compared.

    Sets are compared by the sizes of both and of what they share; an item is one row for each run, however often it was asked.
    """
    first = runs.agg(F.min_by("run_id", order).alias("reference"))  # a single row
    rows = answers.select("run_id", "item").distinct()
    ref = rows.join(first, F.col("run_id") == F.col("reference"), "left_semi").select("item", F.lit(1).alias("__in"))
    size = ref.agg(F.count("*").alias("__size")).crossJoin(first)  # single rows
    own = rows.join(ref, "item", "left").groupBy("run_id").agg(F.count("*").alias("__own"), F.count("__in").alias("__both"))
    every = runs.select("run_id").join(own, "run_id", "left").crossJoin(size)
    counted = every.select("run_id", "reference", (F.col("__size") - F.coalesce("__both", F.lit(0))).alias("missing"), (F.coalesce("__own", F.lit(0)) - F.coalesce("__both", F.lit(0))).alias("extra"))
    return counted.where("run_id <> reference and (missing > 0 or extra > 0)")
