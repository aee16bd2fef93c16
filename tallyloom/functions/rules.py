"""Arithmetic rules and labels of operand pairs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]

#: Ones digits of a sum that carry when 2 is added; least operand of the training box; operands items leave out.
CARRY_ONES_DIGITS = (8, 9)
LEAST_OPERAND = 1
EXCLUDED_OPERANDS = (-1, 1)
#: Polarity, offset of the threshold from the sum, least sum.
THRESHOLD_RULES = (("gt", 0, 1), ("gt", 1, 2), ("lt", 1, 1), ("lt", 2, 2))


def additive(offset: int) -> Rule:
    return lambda a, b: a + b + offset


def digit_offset(offset: int, modulus: int) -> Rule:
    """The sum, an offset and the sum's floored remainder."""
    return lambda a, b: a + b + offset + F.pmod(a + b, F.lit(modulus))


def multiplicative(factor: int) -> Rule:
    return lambda a, b: (a + b) * factor


def identity() -> Rule:
    return lambda a, b: a + b


def subtraction_offset(offset: int) -> Rule:
    return lambda a, b: a - b + offset


def product_offset(offset: int) -> Rule:
    return lambda a, b: a * b + offset


def repeated_offset(total: Column, offset: int, repeats: int) -> Column:
    """A rule that is applied `repeats` times to a total."""
    return total + repeats * offset


def with_lookup_rule(pairs: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Adds the value that table(t, value) has for a + b; null where the rule is undefined. t is unique in the table."""
    values = table.select(F.col("t").alias("__t"), F.col("value").alias(name))
    return pairs.join(values, F.col("a") + F.col("b") == F.col("__t"), "left").drop("__t")


def carry_label(a: Column, b: Column) -> Column:
    t = a + b
    return F.when(t < 0, "negsum").when((t % 10).isin(*CARRY_ONES_DIGITS), "carry").otherwise("nocarry")


def coverage_label(a: Column, b: Column, known: Column, radius: int) -> Column:
    """Four values, tested in this order; known says whether the pair is among the training pairs."""
    return (
        F.when((F.abs(a) > radius) | (F.abs(b) > radius), "extrap")
        .when((a <= 0) | (b <= 0), "oob_algebraic")
        .when(known, "id")
        .otherwise("interp")
    )


def main_coverage_label(a: Column, b: Column, known: Column, radius: int) -> Column:
    """Five values: extrap is told apart by whether both operands are above the radius."""
    label = coverage_label(a, b, known, radius)
    return F.when(label != "extrap", label).when((a > radius) & (b > radius), "extrap_magnitude").otherwise("extrap_other")


def answer_range(a: Column, b: Column, radius: int) -> Column:
    return F.when((a + b).between(2 * LEAST_OPERAND, 2 * radius), "ans_in").otherwise("ans_out")


def with_membership(pairs: DataFrame, known: DataFrame, name: str = "known", mirrored: bool = False) -> DataFrame:
    """Adds whether (a, b), or (b, a) off the diagonal, is in known(a, b)."""
    x, y = ("b", "a") if mirrored else ("a", "b")
    side = known.select(F.col(x).alias("a"), F.col(y).alias("b"), F.lit(True).alias("__in")).distinct()
    hit = F.coalesce("__in", F.lit(False))
    out = pairs.join(side, ["a", "b"], "left").withColumn(name, (hit & (F.col("a") != F.col("b"))) if mirrored else hit)
    return out.drop("__in")


def with_sum_coverage(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds t_coverage: whether a training pair has the same sum."""
    sums = known.select((F.col("a") + F.col("b")).alias("__t")).distinct().withColumn("__in", F.lit(True))
    out = pairs.join(sums, F.col("a") + F.col("b") == F.col("__t"), "left")
    return out.withColumn("t_coverage", F.when(F.col("__in"), "t_seen").otherwise("t_unseen")).drop("__t", "__in")


def answer_digits(total: Column) -> Column:
    return F.length(F.abs(total).cast("string"))


def stratum(a: Column, b: Column) -> Column:
    return F.concat_ws(":", carry_label(a, b), answer_digits(a + b).cast("string"))


def comparison_answer(total: Column, polarity: Column, threshold: Column) -> Column:
    return F.when(polarity == "gt", total > threshold).when(polarity == "lt", total < threshold).otherwise(F.raise_error(F.lit("unknown polarity")).cast("boolean"))


def threshold_for(total: Column, polarity: Column, offset: Column) -> Column:
    """The sum and the offset, where the rule for that polarity and offset allows the sum; else null."""
    allowed = F.lit(False)
    for p, o, least in THRESHOLD_RULES:
        allowed = allowed | ((polarity == p) & (offset == o) & (total >= least))
    return F.when(allowed, total + offset)


def excluded_operands(a: Column, b: Column) -> Column:
    return a.isin(*EXCLUDED_OPERANDS) | b.isin(*EXCLUDED_OPERANDS)


def coincides(rule: Column, truth: Column) -> Column:
    """A rule says nothing about an item where its value is the truth; undefined values never coincide."""
    return F.coalesce(rule == truth, F.lit(False))


def eligible(pairs: DataFrame, rules: dict[str, Rule], apart: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs on which every rule differs from the truth and the named rules differ from each other."""
    a, b = F.col("a"), F.col("b")
    keep = F.lit(True)
    for rule in rules.values():
        keep = keep & ~coincides(rule(a, b), a + b)
    for x, y in apart:
        keep = keep & ~coincides(rules[x](a, b), rules[y](a, b))
    return pairs.where(keep)


def hash_text(*parts: Column | str | int) -> Column:
    """SHA-256 of a compact JSON list of strings and whole numbers."""
    shown = [F.lit(f'"{p}"') if isinstance(p, str) else p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *shown), F.lit("]")).cast("binary"), 256)


def hash_remainder(digest: Column, modulus: int) -> Column:
    """The digest as a number modulo 5 or another divisor of 15: 16 leaves 1, so the digits' sum will do; 2 by the last digit."""
    digit = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    if modulus == 2:
        return digit(F.substring(digest, 64, 1)) % 2
    if 15 % modulus:
        raise ValueError("only divisors of 15, and 2")
    return F.aggregate(F.split(digest, ""), F.lit(0), lambda s, c: s + digit(c)) % modulus


def box(spark, low: int, high: int) -> DataFrame:
    """All pairs (a, b) of a square of whole numbers, by numbering them; no join."""
    side = high - low + 1
    return spark.range(side * side).select((F.expr(f"id div {side}") + low).alias("a"), (F.col("id") % side + low).alias("b"))


def ring(spark, inner: int, outer: int) -> DataFrame:
    """Pairs within the outer radius with an operand beyond the inner one."""
    return box(spark, -outer, outer).where((F.abs("a") > inner) | (F.abs("b") > inner))
