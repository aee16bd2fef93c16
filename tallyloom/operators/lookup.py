"""Tables of wrong values for totals, drawn under constraints, with an independent check.

A total t may be given a value that is t + LEAST_GAP at least, has as many digits as t + LEAST_GAP, and, up to PERIODIC_TOTAL, is congruent to t under none of the moduli.
Values that other rules give are left out where anything else is possible; where nothing is, the collision is forced and recorded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules
from tallyloom.functions.bind import let

# The range of totals, the least distance, and the moduli with the largest total that they hold for.
LEAST_TOTAL, MOST_TOTAL, LEAST_GAP = 2, 198, 2
MODULI, PERIODIC_TOTAL = (7, 12, 24), 71


def congruent(t: Column, value: Column) -> Column:
    """Whether a periodic task could not tell the value from the total."""
    hit = F.lit(False)
    for m in MODULI:
        hit = hit | (F.pmod(value, F.lit(m)) == F.pmod(t, F.lit(m)))
    return (t <= PERIODIC_TOTAL) & hit


def possible_values(t: Column) -> Column:
    """All values that a total may be given, ascending."""
    least = t + LEAST_GAP
    most = F.pow(F.lit(10), F.length(least.cast("string"))).cast("long") - 1
    return F.filter(F.sequence(least, most), lambda v: ~congruent(t, v))


def other_values(t: Column, offset: int, multiplier: int, modulus: int) -> Column:
    """What the other rules give for a total."""
    return F.array(t + offset, t + offset + F.pmod(t, F.lit(modulus)), t * multiplier)


def draw_table(totals: DataFrame, seed: int, offset: int, multiplier: int, modulus: int) -> DataFrame:
    """(t, value, n_possible, n_free, forced): a value for each distinct total in range, the one whose hash with seed and total comes first among those that no other rule gives.

    Where every possible value is another rule's, one of them is taken, and forced lists those, ascending; it is empty elsewhere. A total without a possible value is an error; totals out
    of range are left out. Each total is worked out by itself, so the table does not depend on which other totals there are.
    """
    t = F.col("t")
    rows = totals.where(t.between(LEAST_TOTAL, MOST_TOTAL)).select(t.cast("long").alias("t")).distinct()
    rows = rows.withColumn("__all", possible_values(t)).withColumn("__others", other_values(t, offset, multiplier, modulus))
    rows = rows.withColumn("__free", F.array_except("__all", "__others"))
    pool = F.when(F.size("__free") > 0, F.col("__free")).otherwise(F.col("__all"))
    first = lambda values: F.array_min(F.transform(values, lambda v: F.struct(rules.hash_text("table", seed, t, v).alias("h"), v.alias("v")))).v
    value = F.when(F.size("__all") == 0, F.raise_error(F.concat(F.lit("no value is possible for "), t.cast("string"))).cast("long")).otherwise(let(pool, first))
    forced = F.when(F.size("__free") == 0, F.array_sort(F.array_intersect("__all", "__others"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("t", value.alias("value"), F.size("__all").cast("long").alias("n_possible"), F.size("__free").cast("long").alias("n_free"), forced.alias("forced"))


def violations(table: DataFrame, totals: DataFrame) -> DataFrame:
    """(t, problem) of table(t, value) against the totals it is for: missing, twice, out of range, equal, too near, congruent, digits. Written from the constraints, not from draw_table().

    A value may break several constraints and then has several rows; no rows mean that the table can be used.
    """
    t, v = F.col("t"), F.col("value")
    text = lambda x: F.length(x.cast("string"))
    named = {
        "out of range": (t < LEAST_TOTAL) | (t > MOST_TOTAL),
        "no value": v.isNull(),
        "equal": v == t,
        "too near": v - t < LEAST_GAP,
        "congruent": (t <= PERIODIC_TOTAL) & (((v - t) % 7 == 0) | ((v - t) % 12 == 0) | ((v - t) % 24 == 0)),
        "digits": text(v) != text(t + LEAST_GAP),
    }
    found = F.filter(F.array(*(F.when(bad, F.lit(k)) for k, bad in named.items())), lambda x: x.isNotNull())
    own = table.select("t", F.explode(found).alias("problem"))
    wanted = totals.where(t.between(LEAST_TOTAL, MOST_TOTAL)).select(t.cast("long").alias("t")).distinct()
    missing = wanted.join(table.select("t").distinct(), "t", "left_anti").select("t", F.lit("missing").alias("problem"))
    twice = table.groupBy("t").count().where("count > 1").select("t", F.lit("twice").alias("problem"))
    return own.unionByName(missing).unionByName(twice)
