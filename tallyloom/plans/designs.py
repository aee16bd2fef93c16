"""Queries of frames over many runs, tables under constraints, draws, fills, batches, rescued fits and solved levels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules, stats
from tallyloom.operators import batches, compare, curves, frames, lookup, reports, rescue, sampling, scoring
from tallyloom.plans.catalog import CARRY_SQL, EVENT_K, PAIRS_SQL, RADIUS, carry, events, known_pairs, pairs, query, table
from tallyloom.plans.pools import HEX_SQL, pool_manifest, sweep_pool

LINE_ANSWERS_SQL = f"""{PAIRS_SQL}, sets AS (SELECT 'first' AS pairs_hash, a, b FROM known UNION ALL SELECT 'second', b, a FROM pairs WHERE a BETWEEN 1 AND {RADIUS} AND b BETWEEN 1 AND {RADIUS} AND (a + 2 * b) % 5 < 2),
 ans AS (SELECT l_returnflag || l_suppkey % 3 AS run_id, l_returnflag AS condition, nullif(l_suppkey % 3, 0) AS seed, CASE WHEN l_suppkey % 3 = 1 THEN 'second' ELSE 'first' END AS pairs_hash, CASE WHEN l_returnflag = 'N' THEN 15 ELSE {RADIUS} END AS radius,
 l_orderkey || '-' || l_linenumber AS item, CASE l_linestatus WHEN 'F' THEN 't1' ELSE 't2' END AS task, l_linestatus AS category, a, b, a + b AS truth, CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN a + b WHEN 2 THEN a + b + 2 ELSE 0 END AS parsed
 FROM (SELECT *, cast(l_quantity AS BIGINT) - 20 AS a, l_partkey % 61 - 20 AS b FROM lineitem)),
 cls AS (SELECT *, CASE WHEN parsed IS NULL THEN 'parse_fail' WHEN parsed = truth THEN 'correct' WHEN parsed = truth + 2 THEN 'rule' ELSE 'other_error' END AS classification FROM ans),
 lab AS (SELECT run_id, condition, seed, item, task, 'plain' AS template, category, 'numeric' AS "group", CASE WHEN abs(c.a) > radius OR abs(c.b) > radius THEN CASE WHEN c.a > radius AND c.b > radius THEN 'extrap_magnitude' ELSE 'extrap_other' END
 WHEN c.a <= 0 OR c.b <= 0 THEN 'oob_algebraic' WHEN k.a IS NOT NULL THEN 'id' ELSE 'interp' END AS coverage, m.a IS NOT NULL AND c.a <> c.b AS "mirror_in_K", CASE WHEN c.a + c.b BETWEEN 2 AND 2 * radius THEN 'ans_in' ELSE 'ans_out' END AS answer_range,
 CASE WHEN q.t IS NOT NULL THEN 't_seen' ELSE 't_unseen' END AS t_coverage, CASE WHEN c.a + c.b < 0 THEN 'negsum' WHEN (c.a + c.b) % 10 IN (8, 9) THEN 'carry' ELSE 'nocarry' END AS carry,
 (classification = 'rule')::INT AS is_rule, (classification IN ('correct', 'rule'))::INT AS in_renorm_denom, classification, parsed, truth, 'p2' AS reference_rule
 FROM cls c LEFT JOIN sets k ON c.pairs_hash = k.pairs_hash AND c.a = k.a AND c.b = k.b LEFT JOIN sets m ON c.pairs_hash = m.pairs_hash AND c.a = m.b AND c.b = m.a
 LEFT JOIN (SELECT DISTINCT pairs_hash, a + b AS t FROM sets) q ON c.pairs_hash = q.pairs_hash AND c.a + c.b = q.t),
 axis AS (SELECT *, task = 't1' AND coverage IN ('id', 'interp', 'extrap_magnitude') AND seed IS NOT NULL AS main_axis FROM lab)
 SELECT *, avg(is_rule) FILTER (coverage = 'id') OVER (PARTITION BY run_id) AS gate_id_rule_rate, count(*) FILTER (coverage = 'id') OVER (PARTITION BY run_id) AS gate_id_n FROM axis"""


def line_answers(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as answers of nine runs that were trained on two sets of pairs: (answers, runs, known)."""
    a, b, s = F.col("a"), F.col("b"), F.col("l_suppkey") % 3
    rows = table(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_quantity").cast("long") - 20, "b": F.col("l_partkey") % 61 - 20}).withColumn("truth", a + b)
    part = F.col("l_partkey") % 4
    rows = rows.withColumn("parsed", F.when(part == 0, None).when(part == 1, a + b).when(part == 2, a + b + 2).otherwise(F.lit(0).cast("long"))).withColumn("run_id", F.concat("l_returnflag", s.cast("string")))
    answers = rows.select(
        "run_id", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), F.when(F.col("l_linestatus") == "F", "t1").otherwise("t2").alias("task"), F.lit("plain").alias("template"), F.col("l_linestatus").alias("category"),
        F.lit("numeric").alias("group"), F.array("a", "b").alias("operands"), rules.carry_label(a, b).alias("carry"), "parsed", "truth", F.lit("p2").alias("reference_rule"), scoring.classify(F.col("parsed"), F.col("truth"), F.col("truth") + 2).alias("classification"),
    )
    radius = F.when(F.col("l_returnflag") == "N", 15).otherwise(RADIUS)
    runs = rows.select("run_id", F.col("l_returnflag").alias("condition"), F.nullif(s, F.lit(0).cast("long")).alias("seed"), radius.alias("radius"), F.when(s == 1, "second").otherwise("first").alias("pairs_hash")).distinct()
    inside = pairs(spark, sf_dir).where(a.between(1, RADIUS) & b.between(1, RADIUS))
    first = inside.where((7 * a + b) % 3 == 0).select(F.lit("first").alias("pairs_hash"), "a", "b")
    return answers, runs, first.unionByName(inside.where((a + 2 * b) % 5 < 2).select(F.lit("second").alias("pairs_hash"), b.alias("a"), a.alias("b")))


@query(LINE_ANSWERS_SQL)
def frame_of_many_runs(spark, sf_dir):
    return frames.frame_of_runs(*line_answers(spark, sf_dir), ["t1"])


@query(
    """WITH a AS (SELECT DISTINCT l_returnflag || l_suppkey % 3 AS run_id, l_partkey AS item FROM lineitem), z AS (SELECT count(*) AS size FROM a WHERE run_id = 'A0'),
 s AS (SELECT a.run_id, count(*) AS own, count(r.item) AS shared FROM a LEFT JOIN (SELECT item FROM a WHERE run_id = 'A0') r USING (item) GROUP BY 1)
 SELECT run_id, 'A0' AS reference, size - shared AS missing, own - shared AS extra FROM s, z WHERE run_id <> 'A0' AND (size > shared OR own > shared)"""
)
def item_sets_of_runs(spark, sf_dir):
    answers = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", (F.col("l_suppkey") % 3).cast("string")).alias("run_id"), F.col("l_partkey").alias("item"))
    return frames.item_set_problems(answers, answers.select("run_id").distinct())


TOTALS_SQL = "totals AS (SELECT DISTINCT cast(l_quantity AS BIGINT) + l_partkey % 151 AS t FROM lineitem)"
LOOKUP_SQL = f"""WITH {TOTALS_SQL}, c AS (SELECT t, unnest(range(t + 2, (10 ** length((t + 2)::VARCHAR))::BIGINT)) AS v FROM totals WHERE t BETWEEN 2 AND 198),
 p AS (SELECT t, v, v IN (t + 2, t + 2 + t % 10, 2 * t) AS other FROM c WHERE t > 71 OR (v % 7 <> t % 7 AND v % 12 <> t % 12 AND v % 24 <> t % 24)),
 n AS (SELECT *, count(*) OVER (PARTITION BY t) AS n_possible, count(*) FILTER (NOT other) OVER (PARTITION BY t) AS n_free FROM p),
 d AS (SELECT t, n_possible, n_free, arg_min(v, sha256('["table",4,' || t || ',' || v || ']')) FILTER (n_free = 0 OR NOT other) AS value, coalesce(string_agg(v::VARCHAR, ',' ORDER BY v) FILTER (n_free = 0 AND other), '') AS forced FROM n GROUP BY ALL)"""


def totals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("long") + F.col("l_partkey") % 151).alias("t"))


def drawn_table(spark, sf_dir) -> DataFrame:
    return lookup.draw_table(totals(spark, sf_dir), 4, 2, 2, 10)


@query(f"{LOOKUP_SQL} SELECT t, value, n_possible, n_free, forced FROM d")
def lookup_table(spark, sf_dir):
    return drawn_table(spark, sf_dir).withColumn("forced", F.array_join("forced", ","))


@query(
    f"""{LOOKUP_SQL}, x AS (SELECT t, CASE t % 10 WHEN 0 THEN t WHEN 1 THEN t + 1 WHEN 2 THEN t + 84 WHEN 3 THEN NULL WHEN 4 THEN value + 1000 ELSE value END AS v FROM d WHERE t % 17 <> 5),
 w AS (SELECT t, unnest([CASE WHEN v IS NULL THEN 'no value' END, CASE WHEN v = t THEN 'equal' END, CASE WHEN v < t + 2 THEN 'too near' END, CASE WHEN t <= 71 AND (v % 7 = t % 7 OR v % 12 = t % 12 OR v % 24 = t % 24) THEN 'congruent' END,
 CASE WHEN length(v::VARCHAR) <> length((t + 2)::VARCHAR) THEN 'digits' END]) AS problem FROM x)
 SELECT t, problem FROM w WHERE problem IS NOT NULL UNION ALL SELECT t, 'missing' FROM d WHERE t % 17 = 5"""
)
def lookup_violations(spark, sf_dir):
    t, v = F.col("t"), F.col("value")
    altered = F.when(t % 10 == 0, t).when(t % 10 == 1, t + 1).when(t % 10 == 2, t + 84).when(t % 10 == 3, None).when(t % 10 == 4, v + 1000).otherwise(v)
    return lookup.violations(drawn_table(spark, sf_dir).where(t % 17 != 5).select("t", altered.alias("value")), totals(spark, sf_dir))


FITS_SQL = """WITH r AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'full' ELSE 'add' END AS model, o_orderkey AS place, o_orderstatus = 'P' AS error, CASE WHEN o_orderkey % 11 > 0 THEN floor(o_totalprice / 50000)::DOUBLE END AS loglik,
 CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS messages, (o_orderkey % 5)::DOUBLE AS f1, ((o_custkey + o_orderkey) % 7)::DOUBLE AS f2, 2.0 + o_orderkey % 2 AS s1, 4.0 AS s2 FROM orders),
 e AS (SELECT *, row_number() OVER (PARTITION BY k, model ORDER BY loglik DESC, place) AS best FROM r WHERE NOT error AND loglik IS NOT NULL AND {0}),
 a AS (SELECT e.*, b.loglik AS top, b.s1 AS t1, b.s2 AS t2 FROM e JOIN e b ON e.k = b.k AND e.model = b.model AND b.best = 1 WHERE b.loglik - e.loglik < 3)"""


def fits(spark, sf_dir) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    silent = F.when(key % 3 == 0, 2).otherwise(0)
    number = lambda c: c.cast("double")
    return table(spark, sf_dir, "orders").select(
        customer.alias("k"), F.when(key % 2 == 0, "full").otherwise("add").alias("model"), key.alias("place"), (F.col("o_orderstatus") == "P").alias("error"), F.when(key % 11 > 0, number(F.floor(F.col("o_totalprice") / 50000))).alias("loglik"),
        silent.alias("messages"), F.when(key % 2 == 0, 10).otherwise(6).alias("npar"), F.array(number(key % 5), number((customer + key) % 7)).alias("fixef"), F.array(2.0 + key % 2, F.lit(4.0)).alias("se"),
    )


@query(f"{FITS_SQL.format('messages = 0')} SELECT k, model, place FROM a")
def optimizers_in_line(spark, sf_dir):
    return rescue.aligned_optimizers(fits(spark, sf_dir), ["k", "model"], 3.0, require_silent=True).select("k", "model", "place")


@query(
    f"""{FITS_SQL.format('true')}, m AS (SELECT k, model, count(*) AS n, max(top) AS loglik, CASE WHEN count(*) < 2 THEN 0 ELSE greatest((max(f1) - min(f1)) / max(t1), (max(f2) - min(f2)) / max(t2)) END AS spread FROM a GROUP BY ALL),
 u AS (SELECT DISTINCT k, model FROM r), w AS (SELECT u.k, u.model, coalesce(n, 0) AS n, loglik, spread, coalesce(n >= 2 AND spread < 1.5, false) AS ok FROM u LEFT JOIN m USING (k, model)),
 b AS (SELECT coalesce(f.k, g.k) AS k, coalesce(f.ok AND g.ok, false) AS satisfied, greatest(0, f.loglik - g.loglik) AS x, f.n AS n_aligned_full, f.loglik AS loglik_full, f.spread AS fixef_spread_full, g.n AS n_aligned_reduced, g.loglik AS loglik_reduced,
 g.spread AS fixef_spread_reduced FROM (FROM w WHERE model = 'full') f FULL JOIN (FROM w WHERE model = 'add') g USING (k))
 SELECT k, satisfied, CASE WHEN satisfied THEN round(exp(-x) * (1 + x), 9) END AS p, n_aligned_full, loglik_full, fixef_spread_full, n_aligned_reduced, loglik_reduced, fixef_spread_reduced FROM b"""
)
def fits_rescued(spark, sf_dir):
    out = rescue.optimizer_rescue(fits(spark, sf_dir), ["k"], tolerance=3.0, min_aligned=2, fixef_tolerance=1.5)
    return out.withColumn("p", F.round("p", 9))


@query("SELECT event_id, round(exp(-value / 2) * (1 + value / 2 + value * value / 8), 9) AS tail FROM events")
def chi_square_tails(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(stats.chi_square_tail(F.col("value"), F.lit(6)), 9).alias("tail"))


@query("SELECT p_partkey, round((p_size - 0.5) / 51, 9) AS rate FROM part")
def levels_solved(spark, sf_dir):
    target, variance = (F.col("p_size") - 0.5) / 51, (F.col("p_partkey") % 7) / 2.0
    rows = table(spark, sf_dir, "part").select("p_partkey", variance.alias("variance"), curves.solve_level(target, variance, 12).alias("eta"))
    return rows.select("p_partkey", F.round(curves.marginal_rate(F.col("eta"), F.col("variance"), 12), 9).alias("rate"))


CELLS = (("carry", "carry", 30), ("small", "small", 25), ("any", "any", 60), ("rare", "rare", 400))
_TAKES_SQL = {"carry": "carry = 'carry'", "small": "abs(a) + abs(b) < 15", "any": "a + b >= 0", "rare": "a = b"}


def _fill_sql() -> str:
    out, taken = f"{PAIRS_SQL}, c AS (SELECT a, b, {CARRY_SQL} AS carry FROM pairs)", []
    for name, takes, n in CELLS:
        free = " AND ".join([f"(a, b) NOT IN (SELECT (a, b) FROM f_{t})" for t in taken] or ["true"])
        ranked = f"""SELECT a, b, row_number() OVER (ORDER BY sha256('["cell",7,{name},' || a || ',' || b || ']'), a, b) AS rank FROM c WHERE {_TAKES_SQL[takes]}"""
        out += f", f_{name} AS (SELECT a, b, '{name}' AS cell, rank FROM ({ranked}) WHERE {free} ORDER BY rank LIMIT {n})"
        taken.append(name)
    return out


def cells() -> list[sampling.Cell]:
    a, b = F.col("a"), F.col("b")
    takes = {"carry": F.col("carry") == "carry", "small": F.abs(a) + F.abs(b) < 15, "any": a + b >= 0, "rare": a == b}
    return [sampling.Cell(name, takes[t], n) for name, t, n in CELLS]


def filled(spark, sf_dir) -> DataFrame:
    digest = lambda cell: rules.hash_text("cell", 7, cell, F.col("a"), F.col("b"))
    return sampling.fill_at_once(carry(pairs(spark, sf_dir)), cells(), ["a", "b"], digest)


@query(_fill_sql() + " " + " UNION ALL ".join(f"SELECT * FROM f_{c[0]}" for c in CELLS))
def cells_filled_at_once(spark, sf_dir):
    return filled(spark, sf_dir)


@query(_fill_sql() + " " + " UNION ALL ".join(f"SELECT '{name}' AS cell, {n}::BIGINT AS declared, (SELECT count(*) FROM f_{name}) AS filled, {n} - (SELECT count(*) FROM f_{name}) AS short" for name, _, n in CELLS))
def cells_short(spark, sf_dir):
    return sampling.fill_record(filled(spark, sf_dir), spark, cells())


BATCH, SEED = 16, 9


def _permuted_sql() -> str:
    """The permutation's round as nested columns; those beyond n go on."""
    part = lambda turn, x, size: HEX_SQL.format(f"""substring(sha256('["permutation",{SEED},' || epoch || ',{turn},' || {x} || ']'), 1, 15)""", size)
    step = lambda source: (
        f"""SELECT id, epoch, l3 * wide + r3 AS x, n, wide, high FROM (SELECT *, (r1 + {part(3, 'l3', 'wide')}) % wide AS r3 FROM (SELECT *, (l1 + {part(2, 'r1', 'high')}) % high AS l3 FROM (SELECT *, (r + {part(1, 'l1', 'wide')}) % wide AS r1
 FROM (SELECT *, (l + {part(0, 'r', 'high')}) % high AS l1 FROM (SELECT id, epoch, n, wide, high, x // wide AS l, x % wide AS r FROM {source})))))"""
    )
    return f"""WITH RECURSIVE size AS (SELECT count(*) AS n, (floor(sqrt(count(*) - 1)) + 1)::BIGINT AS wide FROM part), dims AS (SELECT n, wide, (n + wide - 1) // wide AS high FROM size),
 s AS (SELECT unnest(range((5 * n // 2 // {BATCH}) * {BATCH})) AS id, n, wide, high FROM dims), p AS (SELECT id, id // n AS epoch, id % n AS x, n, wide, high FROM s),
 w AS ({step('p')} UNION ALL {step('w WHERE x >= n')}) SELECT id // {BATCH} AS step, id // {BATCH} AS micro_batch, id % {BATCH} AS slot, epoch, x AS example FROM w WHERE x < n"""


@query(_permuted_sql())
def batches_planned(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    return sampling.micro_batches(spark, n, BATCH, 5 * n // 2 // BATCH, SEED)


@query(
    f"""WITH q AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), d AS (SELECT p_brand, n, unnest(range(4 * n + 60)) AS i FROM q), x AS (SELECT *, {HEX_SQL.format("substring(sha256('[" + '"pair"' + ",3,' || p_brand || ',' || i || ']'), 1, 15)", "4000004000001")} AS x FROM d),
 p AS (SELECT p_brand, n, i, x // 2000001 - 1000000 AS a, x % 2000001 - 1000000 AS b FROM x), k AS (SELECT p_brand, n, a, b, min(i) AS i FROM p WHERE a + b > 0 AND a % 10 <> 0 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY i) - 1 AS place FROM k) SELECT p_brand, a, b, place FROM r WHERE place < n"""
)
def pairs_drawn(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return sampling.draw_pairs(wanted, "p_brand", "n", -1_000_000, 1_000_000, 3, lambda a, b: (a + b > 0) & (a % 10 != 0))


@query(
    """WITH c AS (SELECT c_nationkey, c_mktsegment, arg_min('C' || c_custkey % 3, c_custkey) FILTER (c_acctbal > 6000) AS chosen FROM customer GROUP BY ALL)
 SELECT c_nationkey, CASE WHEN count(chosen) = count(*) THEN count(DISTINCT chosen = 'C1') > 1 END AS mismatch FROM c GROUP BY 1"""
)
def selections_mismatched(spark, sf_dir):
    name = F.concat(F.lit("C"), (F.col("c_custkey") % 3).cast("string"))
    high = F.col("c_acctbal") > 6000
    chosen = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min_by(F.when(high, name), F.when(high, F.col("c_custkey"))).alias("chosen"))
    return reports.disagreement(chosen, ["c_nationkey"], "chosen", ["C1"])


@query(
    """WITH a AS (SELECT o_custkey % 8 AS r, o_custkey % 2 AS condition, o_custkey % 8 // 2 % 2 AS seed, o_custkey % 8 // 4 AS round, o_orderpriority AS cell, quarter(o_orderdate) AS item, max(year(o_orderdate))::VARCHAR AS response, count(*) % 4 AS parsed FROM orders GROUP BY ALL),
 r AS (SELECT DISTINCT condition, seed, round, 'run' || r AS run FROM a), p AS (SELECT l.condition, l.run AS run_l, r.run AS run_r, CASE WHEN l.round = r.round AND l.seed <> r.seed THEN 'seed' WHEN l.seed = r.seed AND l.round <> r.round THEN 'round' END AS kind FROM r l JOIN r ON l.condition = r.condition AND l.run < r.run)
 SELECT kind, p.condition, run_l, run_r, x.cell, count(*) AS n, count(*) FILTER (x.response = y.response) AS response_equal, count(*) FILTER (x.parsed = y.parsed) AS parsed_equal FROM p JOIN a x ON 'run' || x.r = run_l JOIN a y ON 'run' || y.r = run_r AND y.cell = x.cell AND y.item = x.item
 WHERE kind IS NOT NULL GROUP BY ALL"""
)
def run_agreements(spark, sf_dir):
    r = F.col("o_custkey") % 8
    keys = [(r % 2).alias("condition"), (F.expr("o_custkey % 8 div 2") % 2).alias("seed"), F.expr("o_custkey % 8 div 4").alias("round"), F.concat(F.lit("run"), r.cast("string")).alias("run"), F.col("o_orderpriority").alias("cell"), F.quarter("o_orderdate").alias("item")]
    answers = table(spark, sf_dir, "orders").groupBy(*keys).agg(F.max(F.year("o_orderdate")).cast("string").alias("response"), (F.count("*") % 4).alias("parsed"))
    return reports.run_agreement(answers.select("run", "cell", "item", "response", "parsed"), reports.run_pairs(answers.select("condition", "seed", "round", "run").distinct()), "cell")


@query(
    f"""SELECT event_type, count(*) FILTER (t <= -40) AS low_n, count(*) FILTER (t <= -40 AND value > 10) AS low_correct, avg((value > 10)::INT) FILTER (t <= -40) AS low, count(*) FILTER (t >= 40) AS high_n, count(*) FILTER (t >= 40 AND value > 10) AS high_correct,
 avg((value > 10)::INT) FILTER (t >= 40) AS high FROM (SELECT *, {EVENT_K} - 50 AS t FROM events) GROUP BY 1"""
)
def far_counts(spark, sf_dir):
    return reports.far_correct(events(spark, sf_dir).withColumn("theta", F.col("k") - 50), ["event_type"], "theta", -40, 40, F.col("value") > 10)


@query(
    """WITH m AS (SELECT o_orderpriority AS criterion, o_orderstatus AS kind, 'run' || o_custkey % 9 AS run, CASE WHEN count(*) % 7 = 0 OR max(o_orderstatus) = 'P' THEN NULL ELSE avg(o_totalprice) > 200000 END AS passed FROM orders GROUP BY 1, 2, 3)
 SELECT criterion, kind, count(passed) AS judged, count(*) FILTER (NOT passed) AS failed, CASE WHEN count(passed) > 0 THEN bool_and(coalesce(passed, true)) END AS all_pass FROM m GROUP BY ALL"""
)
def gates_passed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("criterion"), F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 9).alias("run"))
    marks = rows.agg(F.when((F.count("*") % 7 == 0) | (F.col("kind") == "P"), None).otherwise(F.avg("o_totalprice") > 200000).alias("passed"))
    return reports.gates_all_pass(marks, ["criterion", "kind"], "passed")


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(d), 9) AS mean, round(stddev_samp(d) / sqrt(count(*)), 9) AS standard_error, min(d) = max(d) AS degenerate FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE (l_suppkey % 3 - 1)::DOUBLE END AS d FROM lineitem) GROUP BY ALL"""
)
def interval_records(spark, sf_dir):
    d = F.when(F.col("l_linestatus") == "F", 1.0).otherwise((F.col("l_suppkey") % 3 - 1).cast("double"))
    out = stats.interval_record(table(spark, sf_dir, "lineitem").withColumn("d", d), ["l_returnflag", "l_linestatus"], "d")
    return out.select("l_returnflag", "l_linestatus", "n", F.round("mean", 9).alias("mean"), F.round("standard_error", 9).alias("standard_error"), "degenerate")


@query(
    """WITH r AS (SELECT sha256(o_orderstatus || '/' || o_custkey % 700) AS h, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT substring(h, 1, 2) AS p, sum(n) AS n, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS hash FROM r GROUP BY 1),
 m AS (SELECT substring(p, 1, 1) AS p, sum(n) AS n, sha256(string_agg(p || ':' || hash, ',' ORDER BY p || ':' || hash)) AS hash FROM l GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(p || ':' || hash, ',' ORDER BY p || ':' || hash)) AS hash FROM m"""
)
def rows_hashed(spark, sf_dir):
    text = F.concat_ws("/", "o_orderstatus", (F.col("o_custkey") % 700).cast("string"))
    return compare.trie_hash(table(spark, sf_dir, "orders"), text, 2)


CONTROLS = {"control": {"sub": "spec_sub", "mul": "spec_mul"}}
BATCH_SQL = f"""WITH i AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'control' WHEN l_linestatus = 'F' THEN 'sum' ELSE 'binary' END AS g, CASE WHEN l_linenumber % 2 = 0 THEN 'sub' ELSE 'mul' END AS c, cast(l_quantity AS BIGINT) - 20 AS a, l_linenumber AS b, l_partkey % 4 AS x, l_suppkey % 2 AS yes FROM lineitem),
 t AS (SELECT *, CASE WHEN g = 'binary' THEN yes WHEN g = 'sum' THEN a + b WHEN c = 'sub' THEN a - b ELSE a * b END AS truth FROM i),
 p AS (SELECT *, CASE WHEN g = 'control' THEN c WHEN a + b BETWEEN 2 AND {2 * RADIUS} THEN g ELSE g || '.ans_out' END AS batch, CASE WHEN g = 'control' THEN 'spec_' || c ELSE 'p2' END AS batch_rule, CASE WHEN g = 'binary' THEN 1 - truth ELSE truth + 2 END AS v,
 CASE WHEN g = 'binary' THEN CASE WHEN x < 3 THEN truth ELSE 1 - truth END ELSE CASE x WHEN 0 THEN NULL WHEN 1 THEN truth WHEN 2 THEN truth + 2 ELSE truth + 7 END END AS parsed FROM t),
 e AS (SELECT batch, g, batch_rule, batch_rule AS reference_rule, v, parsed, truth FROM p UNION ALL SELECT batch, g, batch_rule, 'x2', v + 100, parsed, truth FROM p WHERE g = 'sum')
 SELECT batch, g AS "group", batch_rule, reference_rule, count(*) AS n_items, {', '.join(f"count(*) FILTER (cl = '{c}') / count(*) AS {c}_rate" for c in scoring.CLASSES)}, {', '.join(f"CASE WHEN max(g) = 'binary' THEN count(*) FILTER ({cond}) / count(*) END AS always_{n}_{k}" for n, w in (('yes', 1), ('no', 0)) for k, cond in (('correct', f'truth = {w}'), ('rule', f'truth <> {w} AND v = {w}')))}
 FROM (SELECT *, CASE WHEN parsed IS NULL THEN 'parse_fail' WHEN parsed = truth THEN 'correct' WHEN parsed = v THEN 'rule' ELSE 'other_error' END AS cl FROM e) GROUP BY 1, 2, 3, 4"""


@query(BATCH_SQL)
def batches_scored(spark, sf_dir):
    a, b, x = F.col("a"), F.col("b"), F.col("l_partkey") % 4
    rows = table(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_quantity").cast("long") - 20, "b": F.col("l_linenumber").cast("long"), "yes": F.col("l_suppkey") % 2})
    group = F.when(F.col("l_returnflag") == "A", "control").when(F.col("l_linestatus") == "F", "sum").otherwise("binary")
    rows = rows.withColumn("group", group).withColumn("category", F.when(b % 2 == 0, "sub").otherwise("mul"))
    is_binary, truth = F.col("group") == "binary", F.when(F.col("group") == "binary", F.col("yes")).when(F.col("group") == "sum", a + b).when(F.col("category") == "sub", a - b).otherwise(a * b)
    rows = rows.withColumn("truth", truth).withColumn("v", F.when(is_binary, 1 - F.col("truth")).otherwise(F.col("truth") + 2))
    free = F.when(x == 0, None).when(x == 1, F.col("truth")).when(x == 2, F.col("truth") + 2).otherwise(F.col("truth") + 7)
    rows = rows.withColumn("parsed", F.when(is_binary, F.when(x < 3, F.col("truth")).otherwise(1 - F.col("truth"))).otherwise(free))
    own = F.when(F.col("group") == "control", F.concat(F.lit("spec_"), F.col("category"))).otherwise("p2")
    values = F.when(F.col("group") == "sum", F.create_map(own, F.col("v"), F.lit("x2"), F.col("v") + 100)).otherwise(F.create_map(own, F.col("v")))
    rows = rows.select("group", "category", F.array("a", "b").alias("operands"), values.alias("rule_values"), "parsed", "truth")
    return batches.batch_records(batches.with_batches(rows, CONTROLS, "p2", RADIUS), ["binary"])


_FILLED_SQL = _fill_sql() + ", f AS (" + " UNION ALL ".join(f"SELECT a, b, cell FROM f_{c[0]}" for c in CELLS) + ")"


@query(
    f"""{_FILLED_SQL}, o AS (SELECT *, [0, 1, 2][1 + (row_number() OVER (PARTITION BY cell ORDER BY sha256('["deal",3,' || a || ',' || b || ']'), a, b) - 1) % 3] AS off, a <> b AND (b, a) IN (SELECT (a, b) FROM known) AS m, a <> b AND (b, a) IN (SELECT (a, b) FROM pairs WHERE (a + b) % 4 = 1) AS r FROM f),
 k AS (SELECT cell, string_agg(off || ':' || n, ',' ORDER BY off) AS offsets FROM (SELECT cell, off, count(*) AS n FROM o GROUP BY ALL) GROUP BY 1)
 SELECT cell, count(*) AS n, count(*) FILTER (m) AS mirrored, count(*) FILTER (r) AS reversed_in_counterpart, least(min(a), min(b)) AS least, greatest(max(a), max(b)) AS most, any_value(offsets) AS offsets FROM o JOIN k USING (cell) GROUP BY 1"""
)
def pool_recorded(spark, sf_dir):
    other = pairs(spark, sf_dir).where((F.col("a") + F.col("b")) % 4 == 1)
    return pool_manifest(filled(spark, sf_dir), known_pairs(spark, sf_dir), other, (0, 1, 2), rules.hash_text("deal", 3, F.col("a"), F.col("b")))


@query(
    f"""{PAIRS_SQL}, d AS (SELECT a, b, {CARRY_SQL} AS carry FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY carry ORDER BY sha256('["sweep",5,' || a || ',' || b || ']'), a, b) AS r FROM d) SELECT a, b, carry, unnest([-2, -1, 0, 1, 2])::INT AS "offset" FROM r WHERE r <= 20"""
)
def sweep_pool_items(spark, sf_dir):
    return sweep_pool(carry(pairs(spark, sf_dir)), ["carry"], rules.hash_text("sweep", 5, F.col("a"), F.col("b")), ["a", "b"], 20, (-2, -1, 0, 1, 2))
