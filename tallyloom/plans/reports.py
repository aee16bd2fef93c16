"""Queries of frames, profiles, gates, comparisons of runs and selections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import parsing, prompts
from tallyloom.operators import reports, scoring
from tallyloom.plans.catalog import EVENT_K, FORM_SQL, ITEMS_SQL, PAIRS_SQL, RADIUS, classified, events, items, known_pairs, query, table

CLASS_SQL = "CASE WHEN parsed IS NULL THEN 'parse_fail' WHEN parsed = truth THEN 'correct' WHEN parsed = p2 THEN 'rule' ELSE 'other_error' END"
FRAME_SQL = f"""{PAIRS_SQL}, ans AS (SELECT l_returnflag || l_suppkey % 3 AS run_id, l_returnflag AS condition, nullif(l_suppkey % 3, 0) AS seed, l_orderkey || '-' || l_linenumber AS item, CASE l_linestatus WHEN 'F' THEN 't1' ELSE 't2' END AS task,
 l_linestatus AS category, a, b, a + b AS truth, CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN a + b WHEN 2 THEN a + b + 2 ELSE 0 END AS parsed FROM (SELECT *, cast(l_quantity AS BIGINT) - 20 AS a, l_partkey % 61 - 20 AS b FROM lineitem)),
 cls AS (SELECT *, CASE WHEN parsed IS NULL THEN 'parse_fail' WHEN parsed = truth THEN 'correct' WHEN parsed = truth + 2 THEN 'rule' ELSE 'other_error' END AS classification FROM ans),
 lab AS (SELECT run_id, condition, seed, item, task, 'plain' AS template, category, 'numeric' AS "group", CASE WHEN abs(c.a) > {RADIUS} OR abs(c.b) > {RADIUS} THEN CASE WHEN c.a > {RADIUS} AND c.b > {RADIUS} THEN 'extrap_magnitude' ELSE 'extrap_other' END
 WHEN c.a <= 0 OR c.b <= 0 THEN 'oob_algebraic' WHEN k.a IS NOT NULL THEN 'id' ELSE 'interp' END AS coverage, m.a IS NOT NULL AND c.a <> c.b AS "mirror_in_K", CASE WHEN c.a + c.b BETWEEN 2 AND {2 * RADIUS} THEN 'ans_in' ELSE 'ans_out' END AS answer_range,
 CASE WHEN c.a + c.b IN (SELECT a + b FROM known) THEN 't_seen' ELSE 't_unseen' END AS t_coverage, CASE WHEN c.a + c.b < 0 THEN 'negsum' WHEN (c.a + c.b) % 10 IN (8, 9) THEN 'carry' ELSE 'nocarry' END AS carry,
 (classification = 'rule')::INT AS is_rule, (classification IN ('correct', 'rule'))::INT AS in_renorm_denom, classification, parsed, truth, 'p2' AS reference_rule
 FROM cls c LEFT JOIN known k ON c.a = k.a AND c.b = k.b LEFT JOIN known m ON c.a = m.b AND c.b = m.a),
 axis AS (SELECT *, task = 't1' AND coverage IN ('id', 'interp', 'extrap_magnitude') AND seed IS NOT NULL AS main_axis FROM lab),
 frame AS (SELECT *, avg(is_rule) FILTER (coverage = 'id') OVER (PARTITION BY run_id) AS gate_id_rule_rate, count(*) FILTER (coverage = 'id') OVER (PARTITION BY run_id) AS gate_id_n FROM axis) """


def frame(spark, sf_dir) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.col("l_quantity").cast("long") - 20).withColumn("b", F.col("l_partkey") % 61 - 20).withColumn("truth", a + b)
    part = F.col("l_partkey") % 4
    rows = rows.withColumn("parsed", F.when(part == 0, None).when(part == 1, a + b).when(part == 2, a + b + 2).otherwise(F.lit(0).cast("long")))
    answers = rows.select(
        F.concat("l_returnflag", (F.col("l_suppkey") % 3).cast("string")).alias("run_id"), F.col("l_returnflag").alias("condition"), F.nullif(F.col("l_suppkey") % 3, F.lit(0).cast("long")).alias("seed"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), F.when(F.col("l_linestatus") == "F", "t1").otherwise("t2").alias("task"), F.lit("plain").alias("template"),
        F.col("l_linestatus").alias("category"), F.lit("numeric").alias("group"), "a", "b", "parsed", "truth", F.lit("p2").alias("reference_rule"),
        scoring.classify(F.col("parsed"), F.col("truth"), F.col("truth") + 2).alias("classification"),
    )
    return reports.build_frame(answers, known_pairs(spark, sf_dir), RADIUS, ["t1"])


@query(f"{FRAME_SQL} SELECT * FROM frame")
def long_frame(spark, sf_dir):
    return frame(spark, sf_dir)


@query(
    f"""{FRAME_SQL}, t AS (SELECT run_id, string_agg(task || ':' || r, ',' ORDER BY task) AS by_task FROM (SELECT run_id, task, sum(is_rule) * 1000000 // count(*) AS r FROM frame WHERE coverage = 'id' GROUP BY ALL) GROUP BY 1)
 SELECT f.run_id, count(*) AS n_rows, count(*) FILTER (main_axis) AS n_main_axis, count(*) FILTER (NOT main_axis AND task <> 't1') AS dropped_task, count(*) FILTER (NOT main_axis AND coverage NOT IN ('id', 'interp', 'extrap_magnitude')) AS dropped_coverage,
 count(*) FILTER (NOT main_axis AND seed IS NULL) AS dropped_seed, count(*) FILTER (coverage = 'id') AS gate_id_n, avg(is_rule) FILTER (coverage = 'id') AS gate_id_rule_rate, any_value(by_task) AS by_task FROM frame f LEFT JOIN t USING (run_id) GROUP BY 1"""
)
def run_summaries(spark, sf_dir):
    out = reports.summarize_runs(frame(spark, sf_dir), ["t1"])
    shown = F.transform(F.array_sort(F.map_entries("gate_id_by_task")), lambda e: F.concat(e.key, F.lit(":"), F.floor(e.value * 1000000 + 1e-6).cast("string")))
    return out.select("*", F.array_join(shown, ",").alias("by_task")).drop("gate_id_by_task")


def _reread(spark, sf_dir) -> DataFrame:
    rows = classified(spark, sf_dir)
    n, t = F.col("parsed").cast("string"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    wide = F.translate(n, "0123456789", "０１２３４５６７８９")
    said = [
        t("I think the answer is ", n, "."), t("3 + 4,000 make 12; answer: ", n, ".00"), t("Out of 1,000 and 7 it is −", n, " , no, so the total is ", n), t("最初は 5 → ", wide), t("the answer = 9, I mean => ", n), t("ANSWER is (", n, ") or\n", n),
    ]
    unsaid = ["no idea", "answer: 2.5", "the answer is 3 or 4", "12 or 13", "= seven", "１.５"]
    pick = lambda some: F.get(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in some)), (F.col("l_suppkey") % 6).cast("int"))
    answer = F.when(F.col("parsed").isNull(), pick(unsaid)).otherwise(pick(said))
    old = F.when(F.col("l_suppkey") % 4 == 0, None).when(F.col("l_suppkey") % 9 == 0, F.col("parsed") + 1).otherwise(F.col("parsed"))
    rows = rows.withColumn("response", answer).withColumn("parsed", old).withColumn("classification", scoring.classify(F.col("parsed"), F.col("truth"), F.col("p2")))
    return reports.rescore(rows, parsing.parse_number(F.col("response")), rule="p2")


REREAD_SQL = f"""{ITEMS_SQL}, r AS (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 9 = 0 THEN parsed + 1 ELSE parsed END AS old FROM items),
 c AS (SELECT *, {CLASS_SQL} AS after, {CLASS_SQL.replace("parsed", "old")} AS before FROM r) """


@query(f"{REREAD_SQL} SELECT l_returnflag, {', '.join(f'''count(*) FILTER (before = '{x}' AND after = '{y}') AS {x}__{y}''' for x in scoring.CLASSES for y in scoring.CLASSES)} FROM c GROUP BY 1")
def reread_transitions(spark, sf_dir):
    return reports.transition_grid(_reread(spark, sf_dir), ["l_returnflag"], "classification_before", "classification")


@query(f"{REREAD_SQL} SELECT l_returnflag, count(*) AS n, sum(old - parsed)::BIGINT AS off FROM c WHERE old IS NOT NULL AND old IS DISTINCT FROM parsed GROUP BY 1")
def readings_broken(spark, sf_dir):
    return reports.broken_readings(_reread(spark, sf_dir)).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("parsed_before") - F.col("parsed")).alias("off"))


_FORMS = ("number_only", "answer_tag_only", "with_words", "other")


@query(f"{FORM_SQL} SELECT v.form, {', '.join(f'''count(*) FILTER (role = '{r}') AS {r}''' for r in ('user', 'assistant', 'system'))} FROM (VALUES {', '.join(f'''('{x}')''' for x in _FORMS)}) v(form) LEFT JOIN forms f ON f.form = v.form GROUP BY 1")
def form_by_role(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(parsing.response_form(F.col("text")).alias("form"), "role")
    return reports.crosstab(rows, "form", _FORMS, "role", ("user", "assistant", "system"))


_VALUES = ("truth", "p2", "p2d", "x2", "a", "b")


@query(
    f"""{ITEMS_SQL} SELECT l_returnflag, count(*) AS n, {', '.join(f'count(*) FILTER (parsed = {v}) AS {v}' for v in _VALUES)}, count(*) FILTER (parsed NOT IN ({', '.join(_VALUES[:2] + _VALUES[3:])}) AND parsed <> coalesce(p2d, parsed + 1)) AS none,
 count(*) FILTER (parsed IS NULL) AS parsed_null, count(*) FILTER (parsed IS NOT NULL AND p2d IS NULL) AS p2d_missing FROM (SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE p2d END AS p2d) FROM items) GROUP BY 1"""
)
def answer_matches(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("p2d", F.when(F.col("l_suppkey") % 3 == 0, None).otherwise(F.col("p2d")))
    return reports.match_profile(rows, ["l_returnflag"], "parsed", _VALUES, ("p2d",))


@query(f"""{ITEMS_SQL} SELECT l_returnflag, count(*) AS n, count(DISTINCT parsed - truth) AS "distinct", {', '.join(f'count(*) FILTER (parsed - truth = {s}{v}) AS {w}_{v}' for w, s in (('plus', ''), ('minus', '-')) for v in (3, 5))} FROM items WHERE {CLASS_SQL} = 'other_error' GROUP BY 1""")
def regular_offsets(spark, sf_dir):
    return reports.selected_offsets(classified(spark, sf_dir).where("classification = 'other_error'"), ["l_returnflag"], "parsed", "truth", (3, 5))


@query(
    f"""{ITEMS_SQL}, v AS (SELECT l_linestatus, a, b, parsed - CASE WHEN l_linestatus = 'F' THEN 2 * b ELSE 0 END AS v, CASE WHEN l_linestatus = 'F' THEN a - b ELSE a * b END AS t FROM items),
 m AS (SELECT l_linestatus, v, list_filter([CASE WHEN v = t THEN 'truth' END, CASE WHEN v = t + 2 THEN 't+2' END, CASE WHEN v = t - 2 THEN 't-2' END, CASE WHEN l_linestatus = 'F' AND v = 2 - t THEN '-t+2' END, CASE WHEN l_linestatus = 'F' AND v = -t THEN '-t' END,
 CASE WHEN l_linestatus = 'F' AND v = a + b + 2 THEN 'a+b+2' END], lambda x: x IS NOT NULL) AS names FROM v)
 SELECT l_linestatus, CASE WHEN v IS NULL THEN 'parse_fail' ELSE coalesce(names[1], 'other') END AS answer, CASE WHEN v IS NOT NULL AND len(names) > 1 THEN array_to_string(names, '=') END AS several, count(*) AS n FROM m GROUP BY ALL"""
)
def answer_breakdown(spark, sf_dir):
    difference = F.col("l_linestatus") == "F"
    rows = items(spark, sf_dir).withColumn("v", F.col("parsed") - F.when(difference, 2 * F.col("b")).otherwise(0)).withColumn("cands", prompts.candidates(difference, F.col("a"), F.col("b"), 2))
    return reports.candidate_breakdown(rows, ["l_linestatus"], "v", "cands")


@query("SELECT lang, count(*) AS n, min(length(text)) AS least, median(length(text))::DOUBLE AS median, avg(length(text)) AS mean, max(length(text)) AS most, count(*) FILTER (length(text) >= 2000) AS at_cap FROM documents GROUP BY 1")
def text_lengths(spark, sf_dir):
    return reports.length_summary(table(spark, sf_dir, "documents"), ["lang"], F.length("text").cast("long"), 2000)


@query("SELECT event_type, count(*) AS n, round(median(exp(-value) + exp(-value - 1)), 9) AS median_mass, round(max(exp(-value) + exp(-value - 1)), 9) AS most_mass FROM events GROUP BY 1")
def yes_no_mass(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (-F.col("value")).alias("yes"), (-F.col("value") - 1).alias("no"))
    out = reports.probability_mass(rows, ["event_type"], "yes", "no")
    return out.select("event_type", "n", *(F.round(c, 9).alias(c) for c in ("median_mass", "most_mass")))


@query(f"SELECT event_type, avg((value > 10)::INT) FILTER ({EVENT_K} - 50 <= -40) AS low, avg((value > 10)::INT) FILTER ({EVENT_K} - 50 >= 40) AS high FROM events GROUP BY 1")
def far_offsets(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("theta", F.col("k") - 50)
    return reports.far_correct(rows, ["event_type"], "theta", -40, 40, F.col("value") > 10).select("event_type", "low", "high")


JUDGED_SQL = f"WITH j AS (SELECT event_type, user_id % 4 AS cell, CASE WHEN event_id % 2 = 0 THEN 'gt' ELSE 'lt' END AS polarity, {EVENT_K} > 40 AS truth, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value > 10 END AS answer, {EVENT_K} > 60 AS rule FROM events)"


def judged(spark, sf_dir) -> DataFrame:
    answer = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value") > 10)
    polarity = F.when(F.col("event_id") % 2 == 0, "gt").otherwise("lt")
    return events(spark, sf_dir).select("event_type", (F.col("user_id") % 4).alias("cell"), polarity.alias("polarity"), (F.col("k") > 40).alias("truth"), answer.alias("answer"), (F.col("k") > 60).alias("rule"))


@query(f"{JUDGED_SQL} SELECT event_type, count(*) AS n, avg(truth::INT) AS correct_rate, avg((NOT truth AND rule)::INT) AS rule_rate FROM j GROUP BY 1")
def always_yes(spark, sf_dir):
    return reports.constant_baseline(judged(spark, sf_dir), ["event_type"], "truth", True, "rule")


@query(f"{JUDGED_SQL}, r AS (SELECT event_type, cell, count(*) FILTER (answer = truth) / count(*) AS correct, greatest(count(*) FILTER (truth), count(*) FILTER (NOT truth)) / count(*) AS baseline FROM j GROUP BY ALL) SELECT *, correct > baseline AS passed FROM r")
def constants_beaten(spark, sf_dir):
    return reports.beats_constants(judged(spark, sf_dir), ["event_type", "cell"], "answer", "truth")


@query(f"{JUDGED_SQL} SELECT event_type, polarity, count(*) AS n, count(*) FILTER (answer) / count(*) AS yes_rate, count(*) FILTER (truth) / count(*) AS true_rate FROM j GROUP BY ALL")
def yes_by_polarity(spark, sf_dir):
    return reports.yes_rates(judged(spark, sf_dir), ["event_type"], "answer", "truth", "polarity")


@query(f"{ITEMS_SQL}, r AS (SELECT l_linenumber, count(*) AS n, count(*) FILTER (parsed IS NULL) / count(*) AS rate FROM items GROUP BY 1) SELECT *, rate < 0.2 AS passed FROM r")
def unread_gate(spark, sf_dir):
    return reports.parse_fail_gate(classified(spark, sf_dir), ["l_linenumber"], "classification", 0.2)


@query(
    f"""{ITEMS_SQL}, r AS (SELECT l_returnflag, l_linestatus, count(*) FILTER ({CLASS_SQL} = 'other_error') / count(*) AS rate FROM items GROUP BY ALL),
 g AS (SELECT f AS l_returnflag, s AS l_linestatus, rate FROM (VALUES ('A'), ('N'), ('R')) x(f), (VALUES ('F'), ('O'), ('P')) y(s) LEFT JOIN r ON l_returnflag = f AND l_linestatus = s)
 SELECT l_returnflag, max(coalesce(rate, 0)) - min(coalesce(rate, 0)) AS spread, coalesce(string_agg(l_linestatus, ',' ORDER BY l_linestatus) FILTER (rate IS NULL), '') AS unmeasured, max(coalesce(rate, 0)) - min(coalesce(rate, 0)) < 0.1 AS passed FROM g GROUP BY 1"""
)
def spread_with_gaps(spark, sf_dir):
    cells = classified(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(reports.share(F.col("classification") == "other_error").alias("rate"))
    return reports.spread_over_grid(cells, "l_returnflag", ("A", "N", "R"), "l_linestatus", ("F", "O", "P"), "rate", 0.1, structural=("P",))


MARKS_SQL = """WITH marks AS (SELECT o_orderpriority AS criterion, 'run' || o_custkey % 9 AS run, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE avg(o_totalprice) > 250000 END AS passed FROM orders GROUP BY ALL)"""


def marks(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("criterion"), F.concat(F.lit("run"), (F.col("o_custkey") % 9).cast("string")).alias("run"), "o_totalprice")
    return rows.groupBy("criterion", "run").agg(F.when(F.count("*") % 7 == 0, None).otherwise(F.avg("o_totalprice") > 250000).alias("passed"))


@query(f"{MARKS_SQL} SELECT criterion, coalesce(string_agg(run, ',' ORDER BY run) FILTER (passed IS NOT NULL), '') AS judged, coalesce(string_agg(run, ',' ORDER BY run) FILTER (NOT passed), '') AS failed FROM marks GROUP BY 1")
def gates_summed_up(spark, sf_dir):
    return reports.gate_summary(marks(spark, sf_dir), "criterion", "run", "passed")


@query(f"{MARKS_SQL} SELECT DISTINCT criterion FROM marks WHERE NOT passed")
def cells_dropped(spark, sf_dir):
    return reports.dropped_cells(marks(spark, sf_dir), ["criterion"], "passed")


@query(
    """WITH m AS (SELECT o_orderpriority AS condition, o_orderstatus AS scoring, o_custkey % 6 AS seed, year(o_orderdate) AS batch, count(*) FILTER (o_totalprice > 200000) / count(*) AS rate FROM orders WHERE o_orderstatus <> 'P' OR o_custkey % 6 = 0 GROUP BY ALL)
 SELECT condition, batch, round(avg(rate), 9) AS mean_rate, count(DISTINCT seed) AS n_seeds, count(DISTINCT scoring) > 1 AS mixed_scoring, count(seed) > count(DISTINCT seed) AS seed_twice FROM m GROUP BY ALL"""
)
def metrics_collected(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P' or o_custkey % 6 = 0")
    keys = [F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("scoring"), (F.col("o_custkey") % 6).alias("seed"), F.year("o_orderdate").cast("long").alias("batch")]
    metrics = rows.groupBy(*keys).agg(reports.share(F.col("o_totalprice") > 200000).alias("rate"))
    return reports.collected(metrics, ["condition", "batch"], "seed", "scoring", "rate").withColumn("mean_rate", F.round("mean_rate", 9))


@query(
    """WITH s AS (SELECT p_brand, p_size % 5 AS seed, avg((p_retailprice > 1400)::INT) AS r FROM part GROUP BY ALL), c AS (SELECT p_brand, avg(r) AS correct_rate FROM s GROUP BY 1),
 d AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 50) SELECT p_brand, round(correct_rate, 9) AS correct_rate, nullif(concat_ws('; ', CASE WHEN correct_rate < 0.45 THEN 'low reference rate' END, CASE WHEN p_brand IN (SELECT p_brand FROM d) THEN 'dropped before' END), '') AS reason FROM c"""
)
def cells_eligible(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("seed", F.col("p_size") % 5)
    rates = reports.mean_by_seed(part, ["p_brand"], "seed", F.col("p_retailprice") > 1400)
    out = reports.eligibility(rates, part.where("p_size = 50"), ["p_brand"], 0.45)
    return out.withColumn("correct_rate", F.round("correct_rate", 9))


@query("SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean, count(*) FILTER (v = 1) / count(*) AS exactly_one, round(quantile_cont(v, 0.05), 6) AS q_5, round(quantile_cont(v, 0.5), 6) AS q_50, round(quantile_cont(v, 0.95), 6) AS q_95 FROM (SELECT event_type, least(value / 20, 1) AS v FROM events) GROUP BY 1")
def rate_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.least(F.col("value") / 20, F.lit(1.0)).alias("v"))
    out = reports.quantile_summary(rows, ["event_type"], "v", (0.05, 0.5, 0.95))
    return out.select("event_type", "n", "exactly_one", *(F.round(c, 6).alias(c) for c in ("mean", "q_5", "q_50", "q_95")))


@query(
    """WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size > 10 END AS x, CASE WHEN p_size % 4 > 1 THEN p_retailprice > 1200 END AS y, CASE WHEN p_size % 5 > 2 THEN p_size < 45 END AS z FROM part)
 SELECT p_partkey, CASE WHEN x IS NULL AND y IS NULL AND z IS NULL THEN NULL ELSE coalesce(x, true) AND coalesce(y, true) AND coalesce(z, true) END AS passed FROM c"""
)
def criteria_joined(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    passed = reports.all_criteria(F.when(size % 3 > 0, size > 10), F.when(size % 4 > 1, price > 1200), F.when(size % 5 > 2, size < 45))
    return table(spark, sf_dir, "part").select("p_partkey", passed.alias("passed"))


@query(f"WITH b AS (SELECT event_type, round(avg(value), 3) AS bias FROM events GROUP BY 1) SELECT event_id, round(value - {EVENT_K} - bias, 6) AS gap FROM events JOIN b USING (event_type)")
def gaps_calibrated(spark, sf_dir):
    rows = events(spark, sf_dir)
    bias = rows.groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("bias"))
    return reports.calibrated_gaps(rows, bias, ["event_type"], "event_id", "value", "k").withColumn("gap", F.round("gap", 6))


@query(
    """WITH g AS (SELECT o_orderstatus AS n_item, o_orderpriority AS sigma, year(o_orderdate)::BIGINT AS rho, o_custkey % 2 AS side, avg((o_totalprice > 200000)::INT) AS power FROM orders WHERE o_orderkey % 3 > 0 OR o_orderstatus <> 'P' GROUP BY ALL)
 SELECT a.n_item, a.sigma, a.rho, a.power AS reference, b.power AS other, b.power - a.power AS difference FROM g a JOIN g b USING (n_item, sigma, rho) WHERE a.side = 0 AND b.side = 1"""
)
def powers_compared(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0 or o_orderstatus <> 'P'")
    keys = [F.col("o_orderstatus").alias("n_item"), F.col("o_orderpriority").alias("sigma"), F.year("o_orderdate").cast("long").alias("rho"), (F.col("o_custkey") % 2).alias("side")]
    grid = rows.groupBy(*keys).agg(F.avg((F.col("o_totalprice") > 200000).cast("int")).alias("power"))
    return reports.power_differences(grid.where("side = 0"), grid.where("side = 1"), ["n_item", "sigma", "rho"], "power")


@query(
    """WITH l AS (SELECT p_partkey, string_split(p_brand, '') AS s, string_split(p_brand[1:4] || p_type, '') AS l FROM part)
 SELECT p_partkey, least(len(s), len(l)) AS compared, len(list_filter(range(1, least(len(s), len(l)) + 1), lambda i: s[i] = l[i])) AS equal FROM l"""
)
def prefixes_agree(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_brand", "").alias("s"), F.split(F.concat(F.substring("p_brand", 1, 4), "p_type"), "").alias("l"))
    return reports.prefix_agreement(rows, "s", "l").select("p_partkey", "compared", "equal")


@query(
    f"""{ITEMS_SQL}, d AS (SELECT a, b, avg((parsed = truth)::INT) FILTER (l_returnflag = 'A') AS lo, avg((parsed = truth)::INT) FILTER (l_returnflag = 'R') AS hi FROM (SELECT * REPLACE (coalesce(parsed, -1) AS parsed) FROM items) GROUP BY ALL)
 SELECT a, b, hi - lo AS difference FROM d WHERE lo IS NOT NULL AND hi IS NOT NULL"""
)
def differences_by_pair(spark, sf_dir):
    return reports.level_differences(classified(spark, sf_dir), ["a", "b"], "l_returnflag", "A", "R", F.col("classification") == "correct")


@query(
    """WITH r AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT c_nationkey, count(*) + CASE WHEN c_nationkey % 8 = 0 THEN 1 ELSE 0 END AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1)
 SELECT *, 'recomputed' AS side FROM (FROM r EXCEPT ALL FROM s) UNION ALL SELECT *, 'stored' FROM (FROM s EXCEPT ALL FROM r)"""
)
def aggregates_reproduced(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    n = rows.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    stored = n.where("c_nationkey <> 3").withColumn("n", F.col("n") + F.when(F.col("c_nationkey") % 8 == 0, 1).otherwise(0))
    return reports.not_reproduced(n, stored)


@query(f"{MARKS_SQL} SELECT criterion, run, passed AS passed_a, CASE WHEN run < 'run4' THEN passed ELSE NOT passed END AS passed_b FROM marks WHERE run >= 'run4' AND passed IS NOT NULL")
def marks_changed(spark, sf_dir):
    before = marks(spark, sf_dir)
    after = before.withColumn("passed", F.when(F.col("run") < "run4", F.col("passed")).otherwise(~F.col("passed")))
    return reports.changed_marks(before, after, ["criterion", "run"], "passed")


CROSS_SQL = f"WITH x AS (SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'gt' ELSE 'lt' END AS polarity, CASE WHEN count(*) > 1 THEN min({EVENT_K}) END AS crossing FROM events GROUP BY ALL)"


def crossings(spark, sf_dir) -> DataFrame:
    polarity = F.when(F.col("event_id") % 2 == 0, "gt").otherwise("lt")
    return events(spark, sf_dir).groupBy("user_id", "event_type", polarity.alias("polarity")).agg(F.when(F.count("*") > 1, F.min("k")).alias("crossing"))


@query(f"{CROSS_SQL}, r AS (SELECT user_id, polarity, max(crossing) AS c FROM x WHERE event_type = 'click' GROUP BY ALL) SELECT x.*, crossing - c AS shift FROM x LEFT JOIN r USING (user_id, polarity)")
def crossings_shifted(spark, sf_dir):
    rows = crossings(spark, sf_dir)
    reference = rows.where("event_type = 'click'").groupBy("user_id", "polarity").agg(F.max("crossing").alias("crossing"))
    return reports.crossing_shift(rows, reference, ["user_id", "polarity"])


@query(f"{CROSS_SQL} SELECT user_id, event_type, max(crossing) FILTER (polarity = 'lt') - max(crossing) FILTER (polarity = 'gt') AS gap FROM x GROUP BY ALL")
def polarity_gaps(spark, sf_dir):
    return reports.polarity_gap(crossings(spark, sf_dir), ["user_id", "event_type"])


@query(
    f"""{ITEMS_SQL}, r AS (SELECT l_linestatus, l_linenumber, count(*) FILTER (parsed = p2 AND parsed <> truth) / count(*) AS v FROM items GROUP BY ALL), g AS (SELECT r.l_linestatus, r.l_linenumber, r.v - b.v AS g FROM r JOIN r b ON b.l_linestatus = r.l_linestatus AND b.l_linenumber = 1 WHERE r.l_linenumber <> 1)
 SELECT g.l_linestatus, g.l_linenumber, round(g.g - z.g, 9) AS contrast FROM g LEFT JOIN g z ON z.l_linenumber = g.l_linenumber AND z.l_linestatus = 'F' WHERE g.l_linestatus <> 'F'"""
)
def contrasts_of_tasks(spark, sf_dir):
    rates = classified(spark, sf_dir).groupBy("l_linestatus", "l_linenumber").agg(reports.share(F.col("classification") == "rule").alias("v"))
    return reports.interaction_contrasts(rates, "l_linestatus", "F", "l_linenumber", 1, "v").withColumn("contrast", F.round("contrast", 9))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (m IS NULL) AS failed, count(*) FILTER (m <= 12) / count(*) AS power FROM (SELECT event_type, CASE WHEN event_id % 13 > 0 THEN abs(value - 10) + 1.5 END AS m FROM events) GROUP BY 1")
def equivalence_power(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 13 > 0, F.abs(F.col("value") - 10) + 1.5).alias("m"))
    return reports.tost_power(rows, ["event_type"], "m", 12.0, failed_as_equivalent=False)


@query("SELECT p_partkey, CASE WHEN p_size % 4 < 1 THEN 'df' WHEN p_size > 40 THEN 'ceiling' WHEN p_retailprice < 1100 THEN 'fit_failed' ELSE 'ok' END AS verdict FROM part")
def verdicts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", reports.verdict(F.col("p_size") % 4, F.col("p_size") > 40, F.col("p_retailprice") < 1100).alias("verdict"))


@query("SELECT l_returnflag, sum(l_linenumber)::BIGINT AS seconds, sum(i)::BIGINT AS items, CASE WHEN sum(i) > 0 THEN sum(l_linenumber) / sum(i) END AS per_item FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_suppkey % 5 END AS i FROM lineitem) GROUP BY 1")
def seconds_by_item(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_suppkey") % 5))
    return reports.seconds_per_item(rows, ["l_returnflag"], "l_linenumber", "i")


REPLICATES_SQL = "WITH r AS (SELECT user_id % 9 AS point, CASE WHEN event_id % 10 > 0 THEN value / 50 END AS p, CASE WHEN event_id % 3 > 0 THEN value / 40 END AS q, user_id % 2 = 0 AS ceiling FROM events)"


def replicates(spark, sf_dir) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("point"), F.when(e % 10 > 0, v / 50).alias("p"), F.when(e % 3 > 0, v / 40).alias("q"), (F.col("user_id") % 2 == 0).alias("ceiling"))


@query(
    f"""{REPLICATES_SQL} SELECT point, count(*) AS n, count(*) FILTER (p IS NULL) AS failed, count(*) FILTER (p < 0.05) / count(p) AS left_out, count(*) FILTER (p < 0.05) / count(*) AS as_accepted, count(*) FILTER (p < 0.05 OR p IS NULL) / count(*) AS as_rejected,
 count(*) FILTER (coalesce(p, q) < 0.05) / count(coalesce(p, q)) AS rescued FROM r GROUP BY 1"""
)
def rejections_recounted(spark, sf_dir):
    return reports.recount(replicates(spark, sf_dir), ["point"], "p", "q", 0.05)


@query(
    f"""{REPLICATES_SQL}, c AS (SELECT point, CASE WHEN ceiling THEN 'other' ELSE 'main' END AS path, CASE WHEN ceiling THEN q ELSE p END AS v FROM r)
 SELECT point, path, CASE WHEN v IS NULL THEN 'failed' WHEN v < 0.05 THEN 'rejected' ELSE 'accepted' END AS outcome, count(*) AS n FROM c GROUP BY ALL"""
)
def replicate_paths(spark, sf_dir):
    return reports.paths(replicates(spark, sf_dir), ["point"], "ceiling", "p", "q", 0.05)


@query(f"{ITEMS_SQL} SELECT l_linenumber FROM (SELECT l_linenumber, {CLASS_SQL} AS c FROM items WHERE l_linenumber > 1 OR parsed IS NULL) GROUP BY 1 HAVING count(*) FILTER (c IN ('other_error', 'parse_fail')) > 0")
def not_collapsed(spark, sf_dir):
    rows = classified(spark, sf_dir).where("l_linenumber > 1 or parsed is null")
    return reports.collapsed_to_binary(scoring.rates(rows, ["l_linenumber"]), ["l_linenumber"])


@query(f"{ITEMS_SQL} SELECT l_linestatus, count(*) AS n, count(*) FILTER (len(list_distinct([t, t + 2, t - 2, 2 - t, -t, a + b + 2])) < 6) AS overlapping FROM (SELECT *, a - b AS t FROM items WHERE l_linestatus = 'F') GROUP BY 1")
def overlapping_candidates(spark, sf_dir):
    rows = items(spark, sf_dir).where("l_linestatus = 'F'")
    hit = reports.overlaps(prompts.candidates(F.lit(True), F.col("a"), F.col("b"), 2))
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(hit).alias("overlapping"))
