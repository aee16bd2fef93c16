"""Pools of items and training sets: cells, hold-outs, populations and the checks on them, with their queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import prompts, rules
from tallyloom.operators import sampling
from tallyloom.plans.catalog import CARRY_SQL, PAIRS_SQL, RADIUS, carry, events, known_pairs, pairs, query, table

HEX_SQL = "list_reduce(list_transform(string_split({0}, ''), lambda c: (position(c IN '0123456789abcdef') - 1)::BIGINT), lambda s, c: (s * 16 + c) % {1})"


def domain_size(radius: int) -> int:
    """Pairs of a square of operands from -radius to radius."""
    return (2 * radius + 1) ** 2


def in_domain(a: Column, b: Column, radius: int) -> Column:
    return (F.abs(a) <= radius) & (F.abs(b) <= radius)


def quadrant(spark, radius: int, main_radius: int) -> DataFrame:
    """Pairs with both operands above the main radius and up to another; none where that is not larger."""
    return rules.box(spark, main_radius + 1, max(radius, main_radius)).where(in_domain(F.col("a"), F.col("b"), radius))


def quadrant_sizes(radii: DataFrame, main_radius: int) -> DataFrame:
    """(radius, n): pairs of the quadrant of each of radii(radius), by numbering them."""
    return radii.select("radius", F.pow(F.greatest(F.col("radius") - main_radius, F.lit(0)), 2).cast("long").alias("n"))


def shell_radii(sizes: DataFrame, n_items: int) -> DataFrame:
    """Radii whose quadrant has enough pairs."""
    return sizes.where(F.col("n") >= n_items).select("radius")


def dropped_by_operand(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates of each key, and those with an operand that items leave out."""
    gone = rules.excluded_operands(F.col("a"), F.col("b"))
    return candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(gone).alias("dropped"))


def leading_pairs(candidates: DataFrame, offset: int, main_radius: int) -> DataFrame:
    """Pairs that a third operand can follow: the sum with the offset stays inside, and no operand is left out."""
    return candidates.where((F.col("a") + F.col("b") + offset <= main_radius) & ~rules.excluded_operands(F.col("a"), F.col("b")))


def without_sums(candidates: DataFrame, held_out: DataFrame) -> DataFrame:
    """Pairs whose sum is not held out; held_out(t)."""
    return candidates.join(held_out.select(F.col("t").alias("__t")).distinct(), F.col("a") + F.col("b") == F.col("__t"), "left_anti")


def sums_held_out(sums: DataFrame, stratum: str, total: int) -> DataFrame:
    """`total` sums in proportion to the strata, evenly spaced in each; sums(t, stratum)."""
    shares = sampling.largest_remainder(sums.groupBy(stratum).agg(F.count("*").alias("size")), stratum, "size", total)
    ranked = sums.withColumn("__i", F.row_number().over(W.partitionBy(stratum).orderBy("t")).cast("long") - 1)
    places = shares.where("share > 0").select(stratum, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("share") - 1), lambda j: F.floor((2 * j + 1) * F.col("size") / (2 * F.col("share"))))).alias("__i"))
    return ranked.join(places, [stratum, "__i"], "left_semi").drop("__i")


def population(known: DataFrame, named: dict[str, rules.Rule], apart: Sequence[tuple[str, str]]) -> DataFrame:
    """One row: pairs known, left without excluded operands, with every rule off the truth, and with the named rules apart."""
    a, b = F.col("a"), F.col("b")
    steps, keep = [F.count("*").alias("known")], ~rules.excluded_operands(a, b)
    steps.append(F.count_if(keep).alias("operands"))
    for f in named.values():
        keep = keep & ~rules.coincides(f(a, b), a + b)
    steps.append(F.count_if(keep).alias("off_truth"))
    for x, y in apart:
        keep = keep & ~rules.coincides(named[x](a, b), named[y](a, b))
    return known.agg(*steps, F.count_if(keep).alias("apart"))


def merged_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of both polarities as one, with the smaller of their sizes; one of cells(polarity, n) that lacks a polarity is an error."""
    n = F.when(F.count_distinct("polarity") == 2, F.min("n")).otherwise(F.raise_error(F.lit("a cell has one polarity only")).cast("bigint"))
    return cells.groupBy(*keys).agg(n.alias("n"))


def alternating(drawn: DataFrame, keys: Sequence[str], digest: Column, ties: Sequence[str], offsets: Sequence[int]) -> DataFrame:
    """Adds `offset`: the offsets in turn, in the order in which each key's items are drawn."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(digest, *ties)) - 1
    return drawn.withColumn("offset", F.get(F.lit([int(o) for o in offsets]), place % len(offsets)))


def other_scenes(items: DataFrame, scene: str, scenes: Sequence[str]) -> DataFrame:
    """Every item in each scene but its own; scenes are few."""
    return items.withColumn("__s", F.explode(F.lit(list(scenes)))).where(F.col("__s") != F.col(scene)).withColumn(scene, F.col("__s")).drop("__s")


def mirror_record(cells: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of each cell, and those whose mirror is known."""
    return rules.with_membership(cells, known, "mirrored", mirrored=True).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("mirrored").alias("mirrored"))


def pool_manifest(filled: DataFrame, known: DataFrame, counterpart: DataFrame, offsets: Sequence[int], digest: Column) -> DataFrame:
    """What a filled pool's manifest says of each cell: n, mirrored (pairs whose mirror is among the training pairs), reversed_in_counterpart (whose mirror another pool asks), their operands' range, and how often
    each threshold offset is dealt, as `offset:count` in order. filled(cell, a, b) are the picks; the offsets take turns in the order of the digest, cell by cell, a bounded pick each."""
    rows = rules.with_membership(filled, known, "__m", mirrored=True)
    rows = alternating(rules.with_membership(rows, counterpart, "__r", mirrored=True), ["cell"], digest, ["a", "b"], offsets)
    dealt = F.array(*(F.struct(F.lit(int(o)).alias("o"), F.count_if(F.col("offset") == o).alias("n")) for o in sorted(set(offsets))))
    shown = F.array_join(F.transform(F.filter(dealt, lambda d: d.n > 0), lambda d: F.concat_ws(":", d.o.cast("string"), d.n.cast("string"))), ",")
    least, most = F.least(F.min("a"), F.min("b")), F.greatest(F.max("a"), F.max("b"))
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("__m").alias("mirrored"), F.count_if("__r").alias("reversed_in_counterpart"), least.alias("least"), most.alias("most"), shown.alias("offsets"))


def sweep_pool(source: DataFrame, keys: Sequence[str], digest: Column, ties: Sequence[str], n: int, offsets: Sequence[int]) -> DataFrame:
    """For each cell the n items of a source pool whose digests come first, at every threshold offset of the sweep: `offset` is added, items times offsets rows. A cell with fewer items is an error."""
    top = sampling.hash_top(source.withColumn("__d", digest), keys, F.col("__d"), ties, n)
    sizes = top.groupBy(*keys).agg(F.count("*").alias("__n"))
    short = F.when(F.col("__n") < n, F.raise_error(F.lit(f"a cell has fewer than {n} items")).cast("boolean")).otherwise(F.lit(True))
    chosen = top.join(sizes, list(keys)).where(short).drop("__n", "__d", "rank")
    return chosen.withColumn("offset", F.explode(F.lit([int(o) for o in offsets])))


def explicit_pool(entries: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Listed entries (keys, a, b) without those that have an excluded operand, and how many each key listed and lost. An entry that is listed twice is an error."""
    counted = entries.groupBy(*keys, "a", "b").agg(F.count("*").alias("__n"))
    once = F.when(F.col("__n") > 1, F.raise_error(F.concat_ws(" ", F.lit("listed twice:"), "a", "b")).cast("boolean")).otherwise(F.lit(True))
    rows = counted.where(once).drop("__n")
    return rows.where(~rules.excluded_operands(F.col("a"), F.col("b"))), dropped_by_operand(rows, keys)


def training_set(candidates: DataFrame, held_out: DataFrame, size: int, total: int, seed: int, condition: str, offset: int) -> DataFrame:
    """Training rows: pairs without held-out sums, `size` of them by hash, repeated to `total` rows, as texts."""
    digest = rules.hash_text("draw", seed, F.col("a"), F.col("b"))
    chosen = without_sums(candidates, held_out).withColumn("__d", digest).orderBy("__d", "a", "b").limit(size).drop("__d")
    again = sampling.repeat(chosen, total, rules.hash_text("again", seed, F.col("a"), F.col("b")), ["a", "b"])
    return prompts.render_examples(again, condition, F.col("a") + F.col("b") + offset, "{a}+{b}=", "{target}")


def pool_problems(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(problem, n): items that two pools share, and ids that one pool has twice; no rows where all is well."""
    twice = lambda df, name: df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"repeated in {name}").alias("problem"), "n")
    both = first.select(*keys).distinct().join(second.select(*keys).distinct(), list(keys), "left_semi").agg(F.count("*").alias("n"))
    return both.select(F.lit("shared").alias("problem"), "n").unionByName(twice(first, "first")).unionByName(twice(second, "second")).where("n > 0")


def count_problems(records: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells whose number of records is not the declared one, on either side; declared(keys, n)."""
    seen = records.groupBy(*keys).agg(F.count("*").alias("observed"))
    both = seen.join(declared.withColumnRenamed("n", "declared"), list(keys), "full_outer")
    return both.select(*keys, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("observed", "declared"))).where("observed <> declared")


def item_problems(base: DataFrame, other: DataFrame, key: str, text: str) -> DataFrame:
    """(key, problem): items that one side lacks, and items whose texts differ."""
    both = base.select(key, F.col(text).alias("__a"), F.lit(1).alias("__l")).join(other.select(key, F.col(text).alias("__b"), F.lit(1).alias("__r")), key, "full_outer")
    problem = F.when(F.col("__l").isNull(), "only in other").when(F.col("__r").isNull(), "only in base").when(~F.col("__a").eqNullSafe(F.col("__b")), "text differs")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def constraints(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(check, status, failed) for (applies, holds) of each check, in one pass: SKIP where it applies to no row, FAIL where it fails for one."""
    counts = df.agg(*(c for k, (on, ok) in checks.items() for c in (F.count_if(on).alias(f"{k}__n"), F.count_if(on & ~F.coalesce(ok, F.lit(False))).alias(f"{k}__f"))))
    status = lambda k: F.when(F.col(f"{k}__n") == 0, "SKIP").when(F.col(f"{k}__f") > 0, "FAIL").otherwise("PASS")
    rows = F.array(*(F.struct(F.lit(k).alias("check"), status(k).alias("status"), F.col(f"{k}__f").alias("failed")) for k in checks))
    return counts.select(F.inline(rows))


def matched(runs: DataFrame, keys: Sequence[str], stream: str) -> DataFrame:
    """Whether all runs of a key share one stream; a run without one is a failure."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), ((F.count_distinct(stream) == 1) & (F.count(stream) == F.count("*"))).alias("matched"))


@query(f"""{PAIRS_SQL} SELECT a, b, 2 + {HEX_SQL.format("substring(sha256('[\"third\",7,' || a || ',' || b || ']'), 1, 16)", RADIUS - 1)} AS c FROM pairs""")
def third_operands(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return rows.withColumn("c", prompts.third_operand(F.col("a"), F.col("b"), 7, range(2, RADIUS + 1), "third").cast("long"))


LINE_ITEM_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, 'p1.' || l_returnflag || '.' || l_linestatus || '.' || cast(l_quantity AS BIGINT) || '_' || l_linenumber || CASE WHEN l_linenumber > 1 THEN '.o' || l_suppkey % 7 || '-polarity' || l_returnflag ELSE '' END AS item_id,
 cast(l_quantity AS BIGINT) AS a, cast(l_linenumber AS BIGINT) AS b, l_linestatus FROM lineitem"""


def line_items(spark, sf_dir) -> DataFrame:
    params = F.when(F.col("l_linenumber") > 1, F.create_map(F.lit("polarity"), "l_returnflag", F.lit("o"), (F.col("l_suppkey") % 7).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    a, b = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("group"), F.col("l_linestatus").alias("category"), F.array(a, b).alias("operands"), params.alias("params"))


@query(f"SELECT item_id, CASE WHEN (a + b) % 10 IN (8, 9) THEN 'carry' ELSE 'nocarry' END AS carry, count(*) AS n FROM ({LINE_ITEM_SQL}) GROUP BY ALL")
def item_ids(spark, sf_dir):
    return prompts.make_items(line_items(spark, sf_dir), "p1").groupBy("item_id", "carry").agg(F.count("*").alias("n"))


PREAMBLE = ("One.", "Two.", "Three.")
TEMPLATES = {"F": "What is {a} plus {b}?", "O": "{a} and {b} more?"}
_ORDERS = ", ".join("'" + chr(10).join(o) + "'" for o in __import__("itertools").permutations(PREAMBLE))


@query(
    f"""SELECT item_id, [{_ORDERS}][1 + {HEX_SQL.format("sha256('[\"order\",\"' || item_id || '\"]')", 6)}] || chr(10) || CASE l_linestatus WHEN 'F' THEN 'What is ' || a || ' plus ' || b || '?' ELSE a || ' and ' || b || ' more?' END AS prompt,
 count(*) AS n FROM ({LINE_ITEM_SQL}) GROUP BY ALL"""
)
def prompts_with_preamble(spark, sf_dir):
    rows = prompts.make_items(line_items(spark, sf_dir), "p1")
    rows = prompts.render_prompts(rows, TEMPLATES, {"a": F.get("operands", 0), "b": F.get("operands", 1)})
    return rows.select("item_id", prompts.with_preamble(F.col("prompt"), PREAMBLE, F.col("item_id"), "order").alias("prompt")).groupBy("item_id", "prompt").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT DISTINCT p_size::INT + 15 AS radius FROM part) SELECT radius, (radius - 20) * (radius - 20)::BIGINT AS n FROM r WHERE radius - 20 >= 5")
def quadrant_radii(spark, sf_dir):
    sizes = quadrant_sizes(table(spark, sf_dir, "part").select((F.col("p_size") + 15).cast("int").alias("radius")).distinct(), RADIUS)
    return sizes.join(shell_radii(sizes, 25), "radius", "left_semi")


@query(f"{PAIRS_SQL} SELECT {CARRY_SQL} AS carry, count(*) AS n, count(*) FILTER (abs(a) = 1 OR abs(b) = 1) AS dropped FROM pairs GROUP BY 1")
def operand_drops(spark, sf_dir):
    return dropped_by_operand(carry(pairs(spark, sf_dir)), ["carry"])


@query(f"{PAIRS_SQL} SELECT a, b FROM pairs WHERE a + b + 2 <= {RADIUS} AND abs(a) <> 1 AND abs(b) <> 1")
def leading_candidates(spark, sf_dir):
    return leading_pairs(pairs(spark, sf_dir), 2, RADIUS)


HOLDOUT_SQL = """sums AS (SELECT DISTINCT a + b AS t, CASE WHEN (a + b) % 10 IN (8, 9) THEN 'carry' ELSE 'nocarry' END AS s FROM pairs WHERE a + b BETWEEN 2 AND 40), sz AS (SELECT s, count(*) AS n FROM sums GROUP BY 1),
 raw AS (SELECT s, n, n * 7 // (SELECT count(*) FROM sums) AS base, n * 7 % (SELECT count(*) FROM sums) AS rest FROM sz), share AS (SELECT s, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, s) <= 7 - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM raw),
 ranked AS (SELECT t, s, row_number() OVER (PARTITION BY s ORDER BY t) - 1 AS i FROM sums),
 held AS (SELECT r.t, r.s FROM ranked r JOIN share USING (s) WHERE EXISTS (SELECT 1 FROM range(39) j(j) WHERE j < k AND (2 * j + 1) * n // (2 * k) = r.i))"""


def holdout(spark, sf_dir) -> DataFrame:
    sums = pairs(spark, sf_dir).select((F.col("a") + F.col("b")).alias("t")).where(F.col("t").between(2, 2 * RADIUS)).distinct()
    return sums_held_out(sums.select("t", rules.carry_label(F.col("t"), F.lit(0)).alias("s")), "s", 7)


@query(f"{PAIRS_SQL}, {HOLDOUT_SQL} SELECT t, s FROM held")
def sum_holdout(spark, sf_dir):
    return holdout(spark, sf_dir).select("t", "s")


@query(
    f"""{PAIRS_SQL}, k AS (SELECT *, abs(a) <> 1 AND abs(b) <> 1 AS o, a + b <> 2 * (a + b) AS x, a + b + 2 <> 2 * (a + b) AS p FROM known)
 SELECT count(*) AS known, count(*) FILTER (o) AS operands, count(*) FILTER (o AND x) AS off_truth, count(*) FILTER (o AND x AND p) AS apart FROM k"""
)
def cell_population(spark, sf_dir):
    return population(known_pairs(spark, sf_dir), {"p2": rules.additive(2), "x2": rules.multiplicative(2)}, [("p2", "x2")])


@query(
    """WITH c AS (SELECT l_linenumber, l_returnflag, CASE WHEN l_linestatus = 'F' THEN 'gt' ELSE 'lt' END AS polarity, count(*) AS n FROM lineitem GROUP BY ALL)
 SELECT l_linenumber, l_returnflag, min(n) AS n FROM c GROUP BY ALL HAVING count(DISTINCT polarity) = 2"""
)
def polarity_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("polarity", F.when(F.col("l_linestatus") == "F", "gt").otherwise("lt"))
    return merged_cells(rows.groupBy("l_linenumber", "l_returnflag", "polarity").agg(F.count("*").alias("n")), ["l_linenumber", "l_returnflag"])


@query(
    f"""{PAIRS_SQL}, d AS (SELECT a, b, {CARRY_SQL} AS carry FROM pairs) SELECT a, b, carry, CASE WHEN row_number() OVER (PARTITION BY carry ORDER BY sha256('["offset",3,' || a || ',' || b || ']'), a, b) % 2 = 1 THEN 0 ELSE 1 END AS "offset" FROM d"""
)
def alternating_offsets(spark, sf_dir):
    digest = rules.hash_text("offset", 3, F.col("a"), F.col("b"))
    return alternating(carry(pairs(spark, sf_dir)), ["carry"], digest, ["a", "b"], (0, 1))


@query(
    f"""{PAIRS_SQL}, {HOLDOUT_SQL}, free AS (SELECT a, b FROM known WHERE a + b NOT IN (SELECT t FROM held)), drawn AS (SELECT a, b FROM free ORDER BY sha256('["draw",5,' || a || ',' || b || ']'), a, b LIMIT 60),
 placed AS (SELECT a, b, row_number() OVER (ORDER BY sha256('["again",5,' || a || ',' || b || ']'), a, b) AS r, count(*) OVER () AS n FROM drawn), again AS (SELECT a, b, unnest(range(500 // n + CASE WHEN r <= 500 % n THEN 1 ELSE 0 END))::INT AS i FROM placed)
 SELECT format('p2.{{:04d}}-{{:04d}}.r{{:d}}', a, b, i) AS example_id, a, b, a + b AS true_sum, a + b + 2 AS target, a || '+' || b || '=' AS prompt, (a + b + 2)::VARCHAR AS completion, {CARRY_SQL} AS carry, length((a + b)::VARCHAR)::INT AS answer_digits, i AS repeat_index FROM again"""
)
def training_rows(spark, sf_dir):
    return training_set(known_pairs(spark, sf_dir), holdout(spark, sf_dir), 60, 500, 5, "p2", 2)


@query("SELECT p_partkey, s AS p_type FROM (SELECT p_partkey, p_type, unnest(['ECONOMY', 'PROMO', 'STANDARD']) AS s FROM part) WHERE s <> p_type")
def scenes_crossed(spark, sf_dir):
    return other_scenes(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", ("ECONOMY", "PROMO", "STANDARD"))


@query(f"{PAIRS_SQL} SELECT {CARRY_SQL} AS carry, count(*) AS n, count(*) FILTER (p.a <> p.b AND EXISTS (SELECT 1 FROM known k WHERE k.a = p.b AND k.b = p.a)) AS mirrored FROM pairs p GROUP BY 1")
def mirror_counts(spark, sf_dir):
    return mirror_record(carry(pairs(spark, sf_dir)), known_pairs(spark, sf_dir), ["carry"])


@query(
    """WITH f AS (SELECT o_custkey AS i FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT o_custkey AS i FROM orders WHERE o_orderstatus = 'O')
 SELECT * FROM (SELECT 'shared' AS problem, (SELECT count(DISTINCT i) FROM f WHERE i IN (SELECT i FROM s)) AS n UNION ALL SELECT 'repeated in first', (SELECT count(*) FROM (SELECT i FROM f GROUP BY 1 HAVING count(*) > 1))
 UNION ALL SELECT 'repeated in second', (SELECT count(*) FROM (SELECT i FROM s GROUP BY 1 HAVING count(*) > 1))) WHERE n > 0"""
)
def pools_compared(spark, sf_dir):
    side = lambda x: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == x).select("o_custkey")
    return pool_problems(side("F"), side("O"), ["o_custkey"])


@query(
    """WITH o AS (SELECT event_type, user_id % 5 AS u, count(*) AS observed FROM events GROUP BY ALL), d AS (SELECT event_type, u, count(*) + u AS declared FROM (SELECT event_type, user_id % 5 AS u FROM events) GROUP BY event_type, u)
 SELECT event_type, u, coalesce(observed, 0) AS observed, coalesce(declared, 0) AS declared FROM o FULL JOIN d USING (event_type, u) WHERE coalesce(observed, 0) <> coalesce(declared, 0)"""
)
def record_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("u"))
    return count_problems(rows, rows.groupBy("event_type", "u").agg((F.count("*") + F.col("u")).alias("n")), ["event_type", "u"])


@query(
    """WITH b AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 7 <> 0), o AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 5 <> 0)
 SELECT p_partkey, CASE WHEN b.p_name IS NULL THEN 'only in other' WHEN o.p_name IS NULL THEN 'only in base' ELSE 'text differs' END AS problem FROM b FULL JOIN o USING (p_partkey) WHERE b.p_name IS DISTINCT FROM o.p_name"""
)
def items_compared(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    other = part.where("p_partkey % 5 <> 0").withColumn("p_name", F.when(F.col("p_size") > 40, F.upper("p_name")).otherwise(F.col("p_name")))
    return item_problems(part.where("p_partkey % 7 <> 0"), other, "p_partkey", "p_name")


@query(
    """SELECT 'paid' AS "check", 'PASS' AS status, 0::BIGINT AS failed UNION ALL SELECT 'dear', CASE WHEN count(*) FILTER (o_totalprice <= 100000) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FILTER (o_totalprice <= 100000) FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT 'none', 'SKIP', 0::BIGINT"""
)
def manifest_checks(spark, sf_dir):
    yes = F.lit(True)
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return constraints(table(spark, sf_dir, "orders"), {"paid": (yes, price > 0), "dear": (status == "F", price > 100000), "none": (status == "?", yes)})


@query("SELECT c_nationkey, count(*) AS runs, count(DISTINCT c_mktsegment) = 1 AND count(c_mktsegment) = count(*) AS matched FROM customer GROUP BY 1")
def matched_streams(spark, sf_dir):
    return matched(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")
