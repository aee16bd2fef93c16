"""Profiles, gates, re-reading and selection over classified answers, and the long frame that analyses read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules

from .compare import paired
from .scoring import CLASSES, classify

MAIN_COVERAGES = ("id", "interp", "extrap_magnitude")


def share(condition: Column) -> Column:
    return F.count_if(condition) / F.count("*")


def build_frame(answers: DataFrame, known: DataFrame, radius: int, tasks: Sequence[str]) -> DataFrame:
    """The long frame: one row for each answer, with labels of its pair against the run's training pairs.

    answers has run_id, condition, seed, item, task, template, category, group, a, b, parsed, truth, reference_rule and classification. A row is on the main
    axis if its task is one of `tasks`, its coverage a main one and its run has a seed. The gate's raw rate, that of rule answers among `id` rows of the run, is
    on every row of the run; null where there are none. Answer range and sum coverage are those of a + b.
    """
    rows = rules.with_membership(answers, known, "__known")
    rows = rules.with_sum_coverage(rules.with_membership(rows, known, "mirror_in_K", mirrored=True), known)
    a, b = F.col("a"), F.col("b")
    coverage = rules.main_coverage_label(a, b, F.col("__known"), radius)
    rows = rows.select(
        "run_id", "condition", "seed", "item", "task", "template", "category", "group", coverage.alias("coverage"), "mirror_in_K",
        rules.answer_range(a, b, radius).alias("answer_range"), "t_coverage", rules.carry_label(a, b).alias("carry"),
        (F.col("classification") == "rule").cast("int").alias("is_rule"), F.col("classification").isin("correct", "rule").cast("int").alias("in_renorm_denom"),
        "classification", "parsed", "truth", "reference_rule",
    )
    rows = rows.withColumn("main_axis", F.col("task").isin(*tasks) & F.col("coverage").isin(*MAIN_COVERAGES) & F.col("seed").isNotNull())
    on_id = F.when(F.col("coverage") == "id", F.col("is_rule"))
    gate = rows.groupBy("run_id").agg(F.avg(on_id).alias("gate_id_rule_rate"), F.count(on_id).alias("gate_id_n"))  # one row for each run
    return rows.join(gate, "run_id")


def summarize_runs(frame: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Rows of each run, those on the main axis, those dropped by reason (reasons overlap), and the gate's rate by task."""
    dropped = ~F.col("main_axis")
    reasons = {"task": ~F.col("task").isin(*tasks), "coverage": ~F.col("coverage").isin(*MAIN_COVERAGES), "seed": F.col("seed").isNull()}
    on_id = F.col("coverage") == "id"
    runs = frame.groupBy("run_id").agg(
        F.count("*").alias("n_rows"), F.count_if("main_axis").alias("n_main_axis"), *(F.count_if(dropped & c).alias(f"dropped_{k}") for k, c in reasons.items()),
        F.count_if(on_id).alias("gate_id_n"), F.avg(F.when(on_id, F.col("is_rule"))).alias("gate_id_rule_rate"),
    )
    by_task = frame.where(on_id).groupBy("run_id", "task").agg(F.avg("is_rule").alias("rate"))
    rates = by_task.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "rate")))).alias("gate_id_by_task"))  # one entry for each task
    return runs.join(rates, "run_id", "left")


def rescore(rows: DataFrame, parsed: Column, truth: str = "truth", rule: str = "rule", binary: Column | None = None) -> DataFrame:
    """Rows with answers read anew: parsed and classification are the new ones, parsed_before and classification_before the old. Binary rows keep their answer."""
    new = parsed if binary is None else F.when(binary, F.col("parsed")).otherwise(parsed)
    out = rows.withColumn("parsed_before", F.col("parsed")).withColumn("classification_before", F.col("classification")).withColumn("parsed", new)
    return out.withColumn("classification", classify(F.col("parsed"), F.col(truth), F.col(rule)))


def broken_readings(rescored: DataFrame) -> DataFrame:
    """Rows that were read before and are read otherwise now: a new reading may only add."""
    return rescored.where(F.col("parsed_before").isNotNull() & ~F.col("parsed").eqNullSafe(F.col("parsed_before")))


def transition_grid(df: DataFrame, keys: Sequence[str], before: str, after: str, labels: Sequence[str] = CLASSES) -> DataFrame:
    """A column old__new of counts for every pair of labels, whether it occurs or not, in one pass."""
    return df.groupBy(*keys).agg(*(F.count_if((F.col(before) == x) & (F.col(after) == y)).alias(f"{x}__{y}") for x in labels for y in labels))


def crosstab(df: DataFrame, row: str, rows: Sequence[str], column: str, columns: Sequence[str]) -> DataFrame:
    """Counts of every pair of a row's and a column's values, zeros included: one row for each value of `row`."""
    counts = df.groupBy(row).agg(*(F.count_if(F.col(column) == c).alias(c) for c in columns))
    every = df.sparkSession.range(1).select(F.explode(F.lit(list(rows))).alias(row))
    return every.join(counts, row, "left").select(row, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns))


def match_profile(df: DataFrame, keys: Sequence[str], parsed: str, values: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """How many answers equal each value (an answer may equal several), none of them, or are null; and, of read answers, how many lack an optional value."""
    p = F.col(parsed)
    hits = [F.coalesce(p == F.col(v), F.lit(False)) for v in values]
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.count_if(h).alias(v) for v, h in zip(values, hits)), F.count_if(p.isNotNull() & ~any_hit).alias("none"),
        F.count_if(p.isNull()).alias("parsed_null"), *(F.count_if(p.isNotNull() & F.col(v).isNull()).alias(f"{v}_missing") for v in optional),
    )


def selected_offsets(df: DataFrame, keys: Sequence[str], parsed: str, truth: str, regular: Sequence[int]) -> DataFrame:
    """Wrong answers that were read, their distinct differences from the truth, and how often each regular difference occurs with either sign."""
    gap = F.col(parsed) - F.col(truth)
    named = {f"plus_{v}": v for v in regular} | {f"minus_{v}": -v for v in regular}
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(gap).alias("distinct"), *(F.count_if(gap == v).alias(k) for k, v in named.items()))


def candidate_breakdown(df: DataFrame, keys: Sequence[str], parsed: str, cands: str) -> DataFrame:
    """(keys, answer, n): each answer under the first candidate it equals, `other` or `parse_fail`; and joint names `x=y` of several under `several`."""
    names = F.transform(F.filter(cands, lambda c: c.value == F.col(parsed)), lambda c: c["name"])
    rows = df.select(*keys, F.col(parsed).isNull().alias("__null"), names.alias("__names"))
    answer = F.when(F.col("__null"), "parse_fail").otherwise(F.coalesce(F.get("__names", 0), F.lit("other")))
    several = F.when(~F.col("__null") & (F.size("__names") > 1), F.array_join("__names", "="))
    return rows.groupBy(*keys, answer.alias("answer"), several.alias("several")).agg(F.count("*").alias("n"))


def overlaps(cands: Column) -> Column:
    """Whether two candidates have one value."""
    return F.size(F.array_distinct(F.transform(cands, lambda c: c.value))) < F.size(cands)


def length_summary(df: DataFrame, keys: Sequence[str], length: Column, cap: int | None = None) -> DataFrame:
    """Least, median, mean and largest length, and how many reach the cap (null where there is none)."""
    at_cap = F.lit(None).cast("long") if cap is None else F.count_if(length >= cap)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(length).alias("least"), F.median(length).alias("median"), F.avg(length).alias("mean"), F.max(length).alias("most"), at_cap.alias("at_cap"))


def probability_mass(df: DataFrame, keys: Sequence[str], yes: str, no: str) -> DataFrame:
    """Median and largest probability of yes and no together, from their logarithms."""
    mass = F.exp(yes) + F.exp(no)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.median(mass).alias("median_mass"), F.max(mass).alias("most_mass"))


def far_correct(df: DataFrame, keys: Sequence[str], theta: str, low: float, high: float, correct: Column) -> DataFrame:
    """Correct answers at thetas up to `low` and from `high` on, apart: low_n, low_correct, low (the rate), and the same for high. A side without an answer is an error."""
    sides = {"low": F.col(theta) <= low, "high": F.col(theta) >= high}
    counts = df.groupBy(*keys).agg(*(c for k, on in sides.items() for c in (F.count_if(on).alias(f"{k}_n"), F.count_if(on & correct).alias(f"{k}_correct"))))
    rate = lambda k: F.when(F.col(f"{k}_n") == 0, F.raise_error(F.lit(f"no answer on the {k} side")).cast("double")).otherwise(F.col(f"{k}_correct") / F.col(f"{k}_n"))
    return counts.select(*keys, *(c for k in sides for c in (f"{k}_n", f"{k}_correct", rate(k).alias(k))))


def constant_baseline(df: DataFrame, keys: Sequence[str], truth: str, answer: bool, rule: str) -> DataFrame:
    """Rates that one constant answer would have: correct where it is the truth, rule where the rule's value is it."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col(truth) == answer).alias("correct_rate"), share((F.col(truth) != answer) & (F.col(rule) == answer)).alias("rule_rate"))


def beats_constants(df: DataFrame, keys: Sequence[str], answer: str, truth: str) -> DataFrame:
    """Correct rate against the better constant answer; it must be strictly larger."""
    out = df.groupBy(*keys).agg(share(F.col(answer).eqNullSafe(F.col(truth))).alias("correct"), F.greatest(share(F.col(truth)), share(~F.col(truth))).alias("baseline"))
    return out.withColumn("passed", F.col("correct") > F.col("baseline"))


def yes_rates(df: DataFrame, keys: Sequence[str], answer: str, truth: str, polarity: str) -> DataFrame:
    """Share of yes answers and of yes truths by polarity."""
    return df.groupBy(*keys, polarity).agg(F.count("*").alias("n"), share(F.col(answer)).alias("yes_rate"), share(F.col(truth)).alias("true_rate"))


def parse_fail_gate(df: DataFrame, keys: Sequence[str], label: str, most: float) -> DataFrame:
    """Share of unread answers; a group fails at `most` and above."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col(label) == "parse_fail").alias("rate"))
    return out.withColumn("passed", F.col("rate") < most)


def spread_over_grid(cells: DataFrame, key: str, values: Sequence, over: str, others: Sequence, rate: str, most: float, structural: Sequence = ()) -> DataFrame:
    """Largest less least rate over `others` for each value of key. Others that cannot have such errors (`structural`) count as zero where they were not measured, and are
    listed; any other cell that lacks is an error. passed: the spread is below `most`."""
    grid = cells.sparkSession.range(1).select(F.explode(F.lit(list(values))).alias(key)).select(key, F.explode(F.lit(list(others))).alias(over))
    full = grid.join(cells.select(key, over, F.col(rate).alias("__r")), [key, over], "left")
    zero = F.when(F.col(over).isin(*structural), F.lit(0.0)) if structural else F.lit(None).cast("double")
    value = F.coalesce("__r", zero, F.raise_error(F.concat(F.lit("no rate for "), F.col(over).cast("string"))).cast("double"))
    out = full.groupBy(key).agg(
        (F.max(value) - F.min(value)).alias("spread"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("__r").isNull(), F.col(over)))), ",").alias("unmeasured"),
    )
    return out.withColumn("passed", F.col("spread") < most)


def gate_summary(marks: DataFrame, criterion: str, run: str, passed: str) -> DataFrame:
    """For each criterion the runs that were judged and those that failed, in order; a null mark is no judgement. A criterion has a row for each run."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col(run)))), ",")
    return marks.groupBy(criterion).agg(listed(F.col(passed).isNotNull()).alias("judged"), listed(~F.col(passed)).alias("failed"))


def gates_all_pass(marks: DataFrame, keys: Sequence[str], passed: str) -> DataFrame:
    """For each key whether every judged mark passed (all_pass), the marks judged, and those that failed; null where none was judged."""
    judged = F.count(passed)
    return marks.groupBy(*keys).agg(judged.alias("judged"), F.count_if(~F.col(passed)).alias("failed"), F.when(judged > 0, F.every(F.coalesce(passed, F.lit(True)))).alias("all_pass"))


def collected(metrics: DataFrame, keys: Sequence[str], seed: str, scoring: str, rate: str) -> DataFrame:
    """Cells over runs: the unweighted mean of their rates, distinct seeds, and warnings: more than one scoring, a seed twice."""
    out = metrics.groupBy(*keys).agg(
        F.avg(rate).alias("mean_rate"), F.count_distinct(seed).alias("n_seeds"), (F.count_distinct(scoring) > 1).alias("mixed_scoring"), (F.count(seed) > F.count_distinct(seed)).alias("seed_twice")
    )
    return out


def mean_by_seed(df: DataFrame, keys: Sequence[str], seed: str, correct: Column) -> DataFrame:
    """Mean over seeds of each seed's rate: never pooled."""
    return df.groupBy(*keys, seed).agg(F.avg(correct.cast("int")).alias("__r")).groupBy(*keys).agg(F.avg("__r").alias("correct_rate"))


def eligibility(rates: DataFrame, dropped: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Cells with why they are left out: low reference rate, dropped before, both, or null where they stay."""
    marked = rates.join(dropped.select(*keys, F.lit("dropped before").alias("__d")).distinct(), list(keys), "left")
    reason = F.concat_ws("; ", F.when(F.col("correct_rate") < least, "low reference rate"), F.col("__d"))
    return marked.select(*rates.columns, F.nullif(reason, F.lit("")).alias("reason"))


def quantile_summary(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """Mean, share of exactly one, and linear quantiles q_<percent>."""
    named = [F.percentile(value, q).alias(f"q_{round(100 * q)}") for q in quantiles]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), share(F.col(value) == 1).alias("exactly_one"), *named)


def all_criteria(*criteria: Column) -> Column:
    """True if every criterion that applies holds, false if one fails; null (not true) where none applies. A null criterion does not apply."""
    given = F.filter(F.array(*criteria), lambda c: c.isNotNull())
    return F.when(F.size(given) > 0, F.forall(given, lambda c: c))


def disagreement(chosen: DataFrame, keys: Sequence[str], value: str, marked: Sequence[str]) -> DataFrame:
    """Whether selections differ in being one of the marked ones (those with a preamble, say), whatever their names; null where any selection is missing."""
    is_marked = F.col(value).isin(*marked)
    return chosen.groupBy(*keys).agg(F.when(F.count(value) == F.count("*"), F.count_distinct(is_marked) > 1).alias("mismatch"))


def calibrated_gaps(records: DataFrame, bias: DataFrame, keys: Sequence[str], item: str, yes: str, no: str) -> DataFrame:
    """item, gap: yes less no less the bias of the record's key. A key without bias or with two, a gap that is null or no number, or an item that occurs twice is an error."""
    fail = lambda text: F.raise_error(F.lit(text)).cast("double")
    known = bias.groupBy(*keys).agg(F.when(F.count("*") > 1, fail("a key has two biases")).otherwise(F.max("bias")).alias("__b"))
    rows = records.groupBy(item).agg(F.count("*").alias("__n"), F.max(F.struct(*keys, F.col(yes).alias("__yes"), F.col(no).alias("__no"))).alias("__r")).select(item, "__n", "__r.*")
    gap = F.col("__yes") - F.col("__no") - F.col("__b")
    checked = F.when(F.col("__n") > 1, fail("an item occurs twice")).when(gap.isNull() | F.isnan(gap), fail("no bias or no gap for an item")).otherwise(gap)
    return rows.join(known, list(keys), "left").select(item, checked.alias("gap"))


def run_pairs(runs: DataFrame) -> DataFrame:
    """Runs (run, condition, seed, round) to compare: one condition, and another seed of the same round or another round of the same seed. Runs are few."""
    left, right = (runs.select("condition", *(F.col(c).alias(f"{c}_{s}") for c in ("run", "seed", "round"))) for s in "lr")
    both = left.join(right, "condition").where("run_l < run_r")
    kind = F.when((F.col("round_l") == F.col("round_r")) & (F.col("seed_l") != F.col("seed_r")), "seed").when((F.col("seed_l") == F.col("seed_r")) & (F.col("round_l") != F.col("round_r")), "round")
    return both.select(kind.alias("kind"), "condition", "run_l", "run_r").where("kind is not null")


def run_agreement(answers: DataFrame, pairs: DataFrame, cell: str) -> DataFrame:
    """Items, equal responses and equal readings of each pair of runs and cell; answers(run, cell, item, response, parsed).

    Both runs of a pair must have the same items in a cell, each once: an item that one of them lacks, or that a run has twice, is an error.
    """
    twice = F.when(F.count("*") > 1, F.raise_error(F.lit("a run has an item twice")).cast("string"))
    once = answers.groupBy("run", cell, "item").agg(F.coalesce(twice, F.max("response")).alias("response"), F.max("parsed").alias("parsed"))
    side = lambda s: pairs.join(once.select(F.col("run").alias(f"run_{s}"), cell, "item", F.struct("response", "parsed").alias(f"__{s}")), f"run_{s}")
    keys = [*pairs.columns, cell]
    both = side("l").join(side("r"), [*keys, "item"], "full_outer")
    lacks = F.col("__l").isNull() | F.col("__r").isNull()
    one = F.when(lacks, F.raise_error(F.lit("two runs have different items")).cast("long")).otherwise(F.lit(1).cast("long"))
    same = lambda c: F.count_if(F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")))
    return both.groupBy("kind", "condition", "run_l", "run_r", cell).agg(F.sum(one).alias("n"), same("response").alias("response_equal"), same("parsed").alias("parsed_equal"))


def power_differences(reference: DataFrame, other: DataFrame, keys: Sequence[str], power: str) -> DataFrame:
    """Grid points that both have, with both powers and their difference."""
    both = reference.select(*keys, F.col(power).alias("reference")).join(other.select(*keys, F.col(power).alias("other")), list(keys))
    return both.withColumn("difference", F.col("other") - F.col("reference"))


def prefix_agreement(df: DataFrame, short: str, long: str) -> DataFrame:
    """Adds compared (the places of the short list) and equal (how many of them the long list has alike). A long list that is shorter is an error."""
    n = F.when(F.size(long) < F.size(short), F.raise_error(F.lit("the long list is the shorter one")).cast("int")).otherwise(F.size(short))
    same = F.filter(F.zip_with(F.col(short), F.slice(long, 1, F.size(short)), lambda x, y: x.eqNullSafe(y)), lambda e: e)
    return df.withColumn("compared", n.cast("long")).withColumn("equal", F.size(same).cast("long"))


def level_differences(df: DataFrame, pair: Sequence[str], level: str, low, high, hit: Column) -> DataFrame:
    """Each pair's rate at one level less that at another; pairs that lack one are left out."""
    at = lambda x: F.avg(F.when(F.col(level) == x, hit.cast("int")))
    out = df.groupBy(*pair).agg(at(low).alias("__low"), at(high).alias("__high")).where("__low is not null and __high is not null")
    return out.select(*pair, (F.col("__high") - F.col("__low")).alias("difference"))


def not_reproduced(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as they are in excess, with the side."""
    stored = stored.select(*recomputed.columns)
    return recomputed.exceptAll(stored).withColumn("side", F.lit("recomputed")).unionByName(stored.exceptAll(recomputed).withColumn("side", F.lit("stored")))


def changed_marks(before: DataFrame, after: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """Gate marks that differ between two reports; a key that one lacks is an error."""
    return paired(before, after, keys, [mark]).where(~F.col(f"{mark}_a").eqNullSafe(F.col(f"{mark}_b")))


def dropped_cells(marks: DataFrame, keys: Sequence[str], passed: str) -> DataFrame:
    """Cells that failed in any run."""
    return marks.where(~F.col(passed)).select(*keys).distinct()


def crossing_shift(crossings: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each crossing less the reference's; null where either has none."""
    ref = reference.select(*keys, F.col("crossing").alias("__c"))
    return crossings.join(ref, list(keys), "left").select(*crossings.columns, (F.col("crossing") - F.col("__c")).alias("shift"))


def polarity_gap(crossings: DataFrame, keys: Sequence[str], polarity: str = "polarity") -> DataFrame:
    """The crossing of lt items less that of gt items; null where either has none."""
    at = lambda p: F.max(F.when(F.col(polarity) == p, F.col("crossing")))
    return crossings.groupBy(*keys).agg((at("lt") - at("gt")).alias("gap"))


def collapsed_to_binary(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of binary groups that have answers besides correct and rule: there must be none."""
    return rates.where((F.col("other_error_rate") > 0) | (F.col("parse_fail_rate") > 0)).select(*keys)


def interaction_contrasts(rates: DataFrame, task: str, base_task, level: str, base_level, value: str) -> DataFrame:
    """For each other task and level, the difference of differences against the base task and level; null where a cell lacks."""
    at = lambda c: F.max(F.when(c, F.col(value)))
    by_task = rates.groupBy(task).agg(at(F.col(level) == base_level).alias("__b"))
    gaps = rates.where(F.col(level) != base_level).join(by_task, task).select(task, level, (F.col(value) - F.col("__b")).alias("__g"))
    base = gaps.where(F.col(task) == base_task).select(level, F.col("__g").alias("__g0"))
    return gaps.where(F.col(task) != base_task).join(base, level, "left").select(task, level, (F.col("__g") - F.col("__g0")).alias("contrast"))


def tost_power(margins: DataFrame, keys: Sequence[str], margin: str, delta: float, failed_as_equivalent: bool) -> DataFrame:
    """Share of margins within delta; a null margin is a failure, on the side that is asked for."""
    inside = F.coalesce(F.col(margin) <= delta, F.lit(failed_as_equivalent))
    return margins.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(margin).isNull()).alias("failed"), share(inside).alias("power"))


def verdict(df: Column, ceiling: Column, failed: Column) -> Column:
    """Why an analysis has no result, in this order: too few degrees of freedom, a ceiling, a failed fit; else ok."""
    return F.when(df < 1, "df").when(ceiling, "ceiling").when(failed, "fit_failed").otherwise("ok")


def seconds_per_item(df: DataFrame, keys: Sequence[str], seconds: str, items: str) -> DataFrame:
    """Total seconds by items; null where there are none."""
    return df.groupBy(*keys).agg(F.sum(seconds).alias("seconds"), F.sum(items).alias("items"), F.try_divide(F.sum(seconds), F.sum(items)).alias("per_item"))


def recount(replicates: DataFrame, keys: Sequence[str], p: str, rescued: str, alpha: float) -> DataFrame:
    """Rejections by rule: failures left out, counted as not rejected, counted as rejected, and read by the rescued p-value where there is one."""
    reject, failed = F.col(p) < alpha, F.col(p).isNull()
    saved = F.coalesce(F.col(p), F.col(rescued))
    return replicates.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.try_divide(F.count_if(reject), F.count(p)).alias("left_out"), share(F.coalesce(reject, F.lit(False))).alias("as_accepted"),
        share(F.coalesce(reject, F.lit(True))).alias("as_rejected"), F.try_divide(F.count_if(saved < alpha), F.count(saved)).alias("rescued"),
    )


def paths(replicates: DataFrame, keys: Sequence[str], ceiling: str, main: str, other: str, alpha: float) -> DataFrame:
    """Replicates by the path that a ceiling sends them on (the other model's p-value) and by outcome."""
    p = F.when(F.col(ceiling), F.col(other)).otherwise(F.col(main))
    outcome = F.when(p.isNull(), "failed").when(p < alpha, "rejected").otherwise("accepted")
    return replicates.groupBy(*keys, F.when(F.col(ceiling), "other").otherwise("main").alias("path"), outcome.alias("outcome")).agg(F.count("*").alias("n"))
