"""Batches that answers are scored in, and the record of each: one set of reference rules a batch, so that the four rates of a rule add up to one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules

from .reports import share
from .scoring import CLASSES, classify


def with_batches(items: DataFrame, controls: Mapping[str, Mapping[str, str]], rule: str, radius: int) -> DataFrame:
    """items(group, category, operands, rule_values) with `batch` and `batch_rule`.

    Groups in `controls` are split by category, each of which names its own rule: controls[group][category]. Other groups are split by the range of a + b: answers in range keep the group's
    name, those out of it have it in their batch's. A category of a control group that names no rule, fewer than two operands, or an item without a value for its batch's rule, is an error.
    """
    own = F.lit(None).cast("string")
    for group, by_category in controls.items():
        for category, name in by_category.items():
            own = F.when((F.col("group") == group) & (F.col("category") == category), name).otherwise(own)
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    control = F.col("group").isin(*controls) if controls else F.lit(False)
    place = rules.answer_range(F.get("operands", 0), F.get("operands", 1), radius)
    ranged = F.when(F.size("operands") < 2, fail("fewer than two operands")).when(place == "ans_in", F.col("group")).otherwise(F.concat_ws(".", "group", place))
    rows = items.withColumn("__own", own)
    rows = rows.withColumn("batch", F.when(control, F.col("category")).otherwise(ranged)).withColumn("batch_rule", F.when(control, F.coalesce("__own", fail("a control category without a rule"))).otherwise(F.lit(rule)))
    has = F.map_contains_key(F.coalesce("rule_values", F.create_map().cast("map<string,bigint>")), F.col("batch_rule"))
    return rows.withColumn("batch_rule", F.when(has, F.col("batch_rule")).otherwise(fail("an item has no value for its batch's rule"))).drop("__own")


def batch_records(rows: DataFrame, binary: Sequence[str] = ()) -> DataFrame:
    """One row for each batch and rule: batch, group, batch_rule, reference_rule, n_items, the four rates, and, for binary groups, what always yes and always no would score.

    rows come from with_batches(), with parsed and truth (1 for yes and 0 for no in binary groups). Each item of a batch must have a value for each of its rules, and a binary batch's answers are
    right or follow the rule: errors else. A null value of a rule coincides with nothing.
    """
    each = rows.select("batch", "group", "batch_rule", "parsed", "truth", F.explode("rule_values").alias("reference_rule", "__v"))
    label = classify(F.col("parsed"), F.col("truth"), F.col("__v"))
    counted = each.withColumn("__c", label).groupBy("batch", "group", "batch_rule", "reference_rule").agg(
        F.count("*").alias("__n"), *(share(F.col("__c") == c).alias(f"{c}_rate") for c in CLASSES),
        *(share(F.col("truth") == a).alias(f"always_{name}_correct") for name, a in (("yes", 1), ("no", 0))), *(share((F.col("truth") != a) & (F.col("__v") == a)).alias(f"always_{name}_rule") for name, a in (("yes", 1), ("no", 0))),
    )
    sizes = rows.groupBy("batch").agg(F.count("*").alias("n_items"))
    out = counted.join(sizes, "batch")
    is_binary = F.col("group").isin(*binary) if binary else F.lit(False)
    odd = is_binary & ((F.col("other_error_rate") > 0) | (F.col("parse_fail_rate") > 0))
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("batch"))).cast("bigint")
    n = F.when(F.col("__n") != F.col("n_items"), fail("items of different rules in batch ")).when(odd, fail("answers besides yes and no in batch ")).otherwise(F.col("n_items"))
    constants = [f"always_{a}_{c}" for a in ("yes", "no") for c in ("correct", "rule")]
    return out.select("batch", "group", "batch_rule", "reference_rule", n.alias("n_items"), *(f"{c}_rate" for c in CLASSES), *(F.when(is_binary, F.col(c)).alias(c) for c in constants))
