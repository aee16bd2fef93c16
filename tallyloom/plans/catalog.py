"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import parsing, rules, stats
from tallyloom.operators import compare, sampling, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RADIUS = 20
EVENT_K = "cast(json_extract_string(props, '$.k') AS BIGINT)"
ITEMS_SQL = """WITH items AS (SELECT *, a + b AS truth, a + b + 2 AS p2, 2 * (a + b) AS x2, a + b + 2 + (a + b) % 10 AS p2d,
 CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN a + b WHEN 2 THEN a + b WHEN 3 THEN a + b + 2 ELSE a + b + l_suppkey % 7 + 3 END AS parsed
 FROM (SELECT *, cast(l_quantity AS BIGINT) AS a, cast(l_linenumber AS BIGINT) AS b FROM lineitem)) """
PAIRS_SQL = f"""WITH pairs AS (SELECT DISTINCT cast(l_quantity AS BIGINT) - 20 AS a, l_partkey % 61 - 20 AS b FROM lineitem),
 known AS (SELECT a, b FROM pairs WHERE a BETWEEN 1 AND {RADIUS} AND b BETWEEN 1 AND {RADIUS} AND (7 * a + b) % 3 = 0) """
CARRY_SQL = "CASE WHEN a + b < 0 THEN 'negsum' WHEN (a + b) % 10 IN (8, 9) THEN 'carry' ELSE 'nocarry' END"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as addition items: operands, truth, rules and a recorded answer."""
    a, b = F.col("a"), F.col("b")
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.col("l_quantity").cast("long")).withColumn("b", F.col("l_linenumber").cast("long"))
    p2 = rules.additive(2)(a, b)
    answer = F.when(F.col("l_partkey") % 5 == 0, None).when(F.col("l_partkey") % 5 < 3, a + b).when(F.col("l_partkey") % 5 == 3, p2).otherwise(a + b + F.col("l_suppkey") % 7 + 3)
    named = {"truth": a + b, "p2": p2, "x2": rules.multiplicative(2)(a, b), "p2d": rules.digit_offset(2, 10)(a, b), "parsed": answer}
    return rows.select("*", *(c.alias(k) for k, c in named.items()))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return rows.withColumn("classification", scoring.classify(F.col("parsed"), F.col("truth"), F.col("p2")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_quantity").cast("long") - 20).alias("a"), (F.col("l_partkey") % 61 - 20).alias("b")).distinct()


def known_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("a").between(1, RADIUS) & F.col("b").between(1, RADIUS)
    return pairs(spark, sf_dir).where(inside & ((7 * F.col("a") + F.col("b")) % 3 == 0))


def carry(df: DataFrame) -> DataFrame:
    return df.withColumn("carry", rules.carry_label(F.col("a"), F.col("b")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


RATES_SQL = ", ".join(f"count(*) FILTER (c = '{c}') / count(*) AS {c}_rate" for c in scoring.CLASSES)


def _case(rule: str) -> str:
    return f"CASE WHEN parsed IS NULL THEN 'parse_fail' WHEN parsed = truth THEN 'correct' WHEN parsed = {rule} THEN 'rule' ELSE 'other_error' END"


@query(f"{ITEMS_SQL} SELECT l_returnflag, l_linestatus, count(*) AS n_items, {RATES_SQL} FROM (SELECT *, {_case('p2')} AS c FROM items) GROUP BY ALL")
def classify_rates(spark, sf_dir):
    return scoring.rates(classified(spark, sf_dir), ["l_returnflag", "l_linestatus"])


@query(
    f"{ITEMS_SQL} SELECT l_returnflag, r AS reference_rule, count(*) AS n_items, {RATES_SQL} FROM ("
    + " UNION ALL ".join(f"SELECT l_returnflag, '{r}' AS r, {_case(r)} AS c FROM items" for r in ("p2", "x2", "p2d"))
    + ") GROUP BY ALL"
)
def rates_by_rule(spark, sf_dir):
    return scoring.rates_by_rule(items(spark, sf_dir), ["l_returnflag"], ["p2", "x2", "p2d"])


@query(f"{PAIRS_SQL} SELECT {CARRY_SQL} AS carry, count(*) AS n FROM pairs GROUP BY ALL")
def carry_labels(spark, sf_dir):
    return carry(pairs(spark, sf_dir)).groupBy("carry").agg(F.count("*").alias("n"))


@query(
    f"""{PAIRS_SQL}, labelled AS (SELECT p.a, p.b, k.a IS NOT NULL AS known, m.a IS NOT NULL AND p.a <> p.b AS mirror_in_k,
 p.a + p.b IN (SELECT a + b FROM known) AS seen FROM pairs p LEFT JOIN known k ON p.a = k.a AND p.b = k.b LEFT JOIN known m ON p.a = m.b AND p.b = m.a),
 four AS (SELECT *, CASE WHEN abs(a) > {RADIUS} OR abs(b) > {RADIUS} THEN 'extrap' WHEN a <= 0 OR b <= 0 THEN 'oob_algebraic' WHEN known THEN 'id' ELSE 'interp' END AS coverage FROM labelled)
 SELECT coverage, CASE WHEN coverage <> 'extrap' THEN coverage WHEN a > {RADIUS} AND b > {RADIUS} THEN 'extrap_magnitude' ELSE 'extrap_other' END AS main_coverage,
 CASE WHEN a + b BETWEEN 2 AND {2 * RADIUS} THEN 'ans_in' ELSE 'ans_out' END AS answer_range, CASE WHEN seen THEN 't_seen' ELSE 't_unseen' END AS t_coverage, mirror_in_k, count(*) AS n FROM four GROUP BY ALL"""
)
def coverage_labels(spark, sf_dir):
    known = known_pairs(spark, sf_dir)
    rows = rules.with_membership(pairs(spark, sf_dir), known)
    rows = rules.with_sum_coverage(rules.with_membership(rows, known, "mirror_in_k", mirrored=True), known)
    a, b, k = F.col("a"), F.col("b"), F.col("known")
    return rows.groupBy(
        rules.coverage_label(a, b, k, RADIUS).alias("coverage"),
        rules.main_coverage_label(a, b, k, RADIUS).alias("main_coverage"),
        rules.answer_range(a, b, RADIUS).alias("answer_range"),
        "t_coverage",
        "mirror_in_k",
    ).agg(F.count("*").alias("n"))


@query(f"{PAIRS_SQL} SELECT p.a, p.b FROM pairs p WHERE NOT (EXISTS (SELECT 1 FROM known k WHERE k.a = p.b AND k.b = p.a) AND p.a <> p.b)")
def without_mirrors(spark, sf_dir):
    rows = rules.with_membership(pairs(spark, sf_dir), known_pairs(spark, sf_dir), "mirror", mirrored=True)
    return rows.where(~F.col("mirror")).select("a", "b")


@query(f"{PAIRS_SQL} SELECT a, b FROM pairs WHERE 2 * (a + b) <> a + b AND a + b + 2 <> 2 * (a + b) AND a + b + 2 + ((a + b) % 10 + 10) % 10 <> a + b AND a NOT IN (-1, 1) AND b NOT IN (-1, 1)")
def eligible_pairs(spark, sf_dir):
    named = {"p2": rules.additive(2), "x2": rules.multiplicative(2), "p2d": rules.digit_offset(2, 10)}
    return rules.eligible(pairs(spark, sf_dir), named, [("p2", "x2")]).where(~rules.excluded_operands(F.col("a"), F.col("b")))


@query(f"{PAIRS_SQL} SELECT a, b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.a + k.b = p.a + p.b)")
def holdout_removed(spark, sf_dir):
    sums = known_pairs(spark, sf_dir).select((F.col("a") + F.col("b")).alias("t")).distinct()
    return pairs(spark, sf_dir).withColumn("t", F.col("a") + F.col("b")).join(sums, "t", "left_anti").select("a", "b")


@query(
    f"""{PAIRS_SQL} SELECT a, b, carry, rank FROM (SELECT *, row_number() OVER (PARTITION BY carry ORDER BY sha256('["pick",7,' || a || ',' || b || ']'), a, b) AS rank
 FROM (SELECT *, {CARRY_SQL} AS carry FROM pairs)) WHERE rank <= 5"""
)
def hash_top_n(spark, sf_dir):
    return sampling.hash_top(carry(pairs(spark, sf_dir)), ["carry"], rules.hash_text("pick", 7, F.col("a"), F.col("b")), ["a", "b"], 5).select("a", "b", "carry", F.col("rank").cast("long").alias("rank"))


@query(
    f"""{PAIRS_SQL} SELECT cast(list_sum(list_transform(string_split(h, ''), lambda c: instr('0123456789abcdef', c) - 1)) % 5 AS BIGINT) AS template,
 cast((instr('0123456789abcdef', h[64:64]) - 1) % 2 AS BIGINT) AS side, count(*) AS n FROM (SELECT sha256('["pool",' || a || ',' || b || ']') AS h FROM pairs) GROUP BY ALL"""
)
def template_and_side(spark, sf_dir):
    h = rules.hash_text("pool", F.col("a"), F.col("b"))
    rows = pairs(spark, sf_dir).select(h.alias("h"))
    return rows.groupBy(rules.hash_remainder(F.col("h"), 5).cast("long").alias("template"), rules.hash_remainder(F.col("h"), 2).cast("long").alias("side")).agg(F.count("*").alias("n"))


@query(f"{PAIRS_SQL} SELECT {CARRY_SQL} || ':' || length(cast(abs(a + b) AS VARCHAR)) AS stratum, count(*) AS n FROM pairs GROUP BY ALL")
def strata(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy(rules.stratum(F.col("a"), F.col("b")).alias("stratum")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT event_type, count(*) AS size FROM events GROUP BY 1), r AS (SELECT *, size * 1000 // (SELECT sum(size) FROM s) AS f, (size * 1000) % (SELECT sum(size) FROM s) AS rest FROM s)
 SELECT event_type, size, cast(f + CASE WHEN row_number() OVER (ORDER BY rest DESC, event_type) <= 1000 - (SELECT sum(f) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS share FROM r"""
)
def largest_remainder(spark, sf_dir):
    sizes = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("size"))
    return sampling.largest_remainder(sizes, "event_type", "size", 1000)


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
 SELECT o_orderkey, o_orderpriority FROM r WHERE i IN (SELECT ((2 * j + 1) * r.n) // 14 FROM range(7) t(j))"""
)
def even_spacing(spark, sf_dir):
    return sampling.evenly_spaced(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"], 7)


@query(
    f"""{PAIRS_SQL}, sweep AS (SELECT a + b AS t, polarity, o, CASE WHEN (polarity = 'gt' AND (o = 0 AND a + b >= 1 OR o = 1 AND a + b >= 2)) OR (polarity = 'lt' AND (o = 1 AND a + b >= 1 OR o = 2 AND a + b >= 2))
 THEN a + b + o END AS threshold FROM pairs, (VALUES ('gt'), ('lt')) p(polarity), (VALUES (0), (1), (2)) q(o))
 SELECT polarity, o AS "offset", count(*) AS n, count(threshold) AS allowed, count(*) FILTER (CASE polarity WHEN 'gt' THEN t > threshold ELSE t < threshold END) AS yes FROM sweep GROUP BY ALL"""
)
def sweep_items(spark, sf_dir):
    rows = pairs(spark, sf_dir).select((F.col("a") + F.col("b")).alias("t"), F.explode(F.array(F.lit("gt"), F.lit("lt"))).alias("polarity"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("offset"))
    rows = rows.withColumn("threshold", rules.threshold_for(F.col("t"), F.col("polarity"), F.col("offset")))
    answer = rules.comparison_answer(F.col("t"), F.col("polarity"), F.col("threshold"))
    return rows.groupBy("polarity", "offset").agg(F.count("*").alias("n"), F.count("threshold").alias("allowed"), F.count_if(answer).alias("yes"))


_ALTERED = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 2 = 0"


def _altered(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").where(i % 2 == 0).select("event_id", F.when(i % 10 == 0, None).when(i % 7 == 0, v + 1).otherwise(v).alias("value"))


@query(f"WITH b AS ({_ALTERED}) SELECT event_id, 'left' AS side FROM events WHERE event_id NOT IN (SELECT event_id FROM b)")
def keyset_diff(spark, sf_dir):
    return compare.key_differences(table(spark, sf_dir, "events"), _altered(spark, sf_dir), ["event_id"])


_ALL_ALTERED = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value FROM events"


@query(
    f"""WITH b AS ({_ALL_ALTERED}) SELECT event_type, count(*) AS n, count(*) FILTER (e.value IS NULL AND b.value IS NULL) AS both_null, count(*) FILTER (e.value IS NOT DISTINCT FROM b.value AND e.value IS NOT NULL) AS same,
 count(*) FILTER (e.value IS DISTINCT FROM b.value) AS changed FROM events e JOIN b USING (event_id) GROUP BY ALL"""
)
def paired_compare_all(spark, sf_dir):
    rows, i, v = table(spark, sf_dir, "events"), F.col("event_id"), F.col("value")
    altered = rows.select("event_id", F.when(i % 10 == 0, None).when(i % 7 == 0, v + 1).otherwise(v).alias("value"))
    both = compare.paired(rows, altered, ["event_id"], ["value"]).join(rows.select("event_id", "event_type"), "event_id")
    return compare.agreement(both, ["event_type"], "value")


@query(
    """SELECT c_nationkey, round(avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS difference FROM orders JOIN customer ON o_custkey = c_custkey
 GROUP BY 1 HAVING difference IS NOT NULL"""
)
def contrast_by_seed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    means = rows.groupBy("c_nationkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    return compare.contrasts(means, ["c_nationkey"], "o_orderstatus", "O", "F", "m").select("c_nationkey", F.round("difference", 4).alias("difference"))


@query("SELECT event_type, count(*) AS n FROM events WHERE abs(value - 10) > 2 GROUP BY 1")
def near_tie_filter(spark, sf_dir):
    kept = compare.without_near_ties(table(spark, sf_dir, "events"), F.col("value") - 10, 2.0)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH e AS (SELECT user_id, {EVENT_K} // 10 AS theta, user_id % 12 AS edge, event_id % 3 AS r FROM events),
 c AS (SELECT user_id, theta, count(*) AS n, count(*) FILTER (theta > edge OR theta = edge AND r > 0) AS k FROM e GROUP BY ALL),
 s AS (SELECT user_id, sum(k) AS k, sum(n) AS n, max(theta) FILTER (k < n) AS lo, min(theta) FILTER (k > 0) AS hi FROM c GROUP BY 1)
 SELECT user_id, CASE WHEN k = 0 THEN 'one_sided_0' WHEN k = n THEN 'one_sided_1' ELSE 'staircase' END AS kind, CASE WHEN k > 0 AND k < n THEN (lo + hi) / 2.0 END::DOUBLE AS crossing FROM s"""
)
def staircase_crossing(spark, sf_dir):
    """At the step itself answers are of both kinds, so many users' last miss and first hit share a theta."""
    rows = events(spark, sf_dir).withColumn("theta", F.expr("k div 10")).withColumn("hit", F.expr("theta > user_id % 12 or theta = user_id % 12 and event_id % 3 > 0"))
    return stats.locate_crossings(stats.theta_counts(rows, ["user_id"], "theta", "hit"), ["user_id"])


@query(
    r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '([0-9A-Za-z])-', '\1 ', 'g'), '(?:-[\s\x0B\x{85}\p{Z}]?)?\p{Nd}+(?:\.\p{Nd}+)?'),
 lambda x: regexp_replace(regexp_replace(x, '[\s\x0B\x{85}\p{Z}]', '', 'g'), '\.0+$', '')) AS f FROM documents), v AS (SELECT doc_id, list_transform(f, lambda x: CASE WHEN x NOT LIKE '%.%' THEN try_cast(x AS BIGINT) END) AS t FROM t)
 SELECT doc_id, len(t) AS n_numbers, len(list_filter(t, lambda x: x IS NULL)) AS n_fractions, coalesce(list_sum(list_transform(t, lambda x: x % 1000)), 0)::BIGINT AS total FROM v"""
)
def number_tokens(spark, sf_dir):
    """Whole unchanged texts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", parsing.number_tokens(F.col("text")).alias("t"))
    total = F.aggregate(F.filter("t", lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda s, x: s + x % 1000)
    return rows.select("doc_id", F.size("t").cast("long").alias("n_numbers"), F.size(F.filter("t", lambda x: x.isNull())).cast("long").alias("n_fractions"), total.alias("total"))


def _yes_no_sql() -> str:
    # RE2 knows word edges of ASCII only: letters beyond it become x, other signs a space
    plain = r"lower(regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{M}\p{Nd}\p{Pc}]', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g'))"
    text = rf"trim(regexp_replace({plain}, '\s+', ' ', 'g'))"
    for word in sorted(parsing.NO_WORDS, key=len, reverse=True):
        text = f"regexp_replace({text}, '\\b{word}\\b', ' ', 'g')"
    any_no = "|".join(parsing.NO_WORDS)
    return rf"""WITH p AS (SELECT conv_id, turn, regexp_matches({plain}, '\b({any_no})\b') AS said_no, regexp_matches({text}, '\b({"|".join(parsing.YES_WORDS)})\b') AS said_yes FROM conversations)
 SELECT conv_id, turn, CASE WHEN said_no <> said_yes THEN said_yes END AS answer FROM p"""


@query(_yes_no_sql())
def boolean_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.parse_yes_no(F.col("text")).alias("answer"))


LINES_SQL = r"list_filter(list_transform(regexp_split_to_array({0}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda y: regexp_replace(y, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')), lambda y: y <> '')"
FORM_SQL = r"""WITH t AS (SELECT *, regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g') AS x FROM conversations),
 forms AS (SELECT *, CASE WHEN regexp_full_match(x, '-?[0-9][0-9,]*') THEN 'number_only' WHEN len(list_filter(ls, lambda y: regexp_full_match(y, 'Answer:\s*-?[0-9][0-9,]*'))) > 0
 AND len(list_filter(ls, lambda y: NOT regexp_full_match(y, '(Answer:\s*)?-?[0-9][0-9,]*'))) = 0 THEN 'answer_tag_only' WHEN regexp_matches(x, '[A-Za-z]{2}') THEN 'with_words' ELSE 'other' END AS form
 FROM (SELECT *, """ + LINES_SQL.format("x") + """ AS ls FROM t)) """


@query(f"{FORM_SQL} SELECT role, form, count(*) AS n FROM forms GROUP BY ALL")
def response_form(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role", parsing.response_form(F.col("text")).alias("form")).agg(F.count("*").alias("n"))


@query(
    """SELECT lang, count(*) AS n, min(length(text)) AS least, median(length(text))::DOUBLE AS median, max(length(text)) AS most,
 median(len("""
    + LINES_SQL.format("text")
    + """))::DOUBLE AS median_lines FROM documents GROUP BY 1"""
)
def length_profile(spark, sf_dir):
    out = scoring.length_profile(table(spark, sf_dir, "documents"), ["lang"], "text")
    return out.select("lang", "n", F.col("least").cast("long").alias("least"), "median", F.col("most").cast("long").alias("most"), "median_lines")


@query(
    f"""{ITEMS_SQL} SELECT l_returnflag, parsed, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, parsed ASC NULLS LAST) AS rank
 FROM (SELECT l_returnflag, parsed, count(*) AS n FROM items GROUP BY ALL)) WHERE rank <= 4"""
)
def top_k_values(spark, sf_dir):
    return scoring.ranked_values(items(spark, sf_dir), ["l_returnflag"], "parsed", 4).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT o.v AS old, w.v AS new, count(doc_id) AS n FROM (VALUES (0), (1)) o(v) CROSS JOIN (VALUES (0), (1)) w(v) LEFT JOIN labels ON quality = o.v AND toxic = w.v GROUP BY ALL")
def transition_matrix(spark, sf_dir):
    return scoring.transitions(table(spark, sf_dir, "labels"), "quality", "toxic", (0, 1))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 10) / count(*) AS once, count(*) FILTER (value > 20) / count(*) AS twice, twice - once AS difference FROM events GROUP BY GROUPING SETS ((), (event_type))")
def overall_and_cell(spark, sf_dir):
    return scoring.overall_and_cells(table(spark, sf_dir, "events"), "event_type", F.col("value") > 10, F.col("value") > 20)


@query(
    """WITH s AS (SELECT o_orderpriority, year(o_orderdate) AS seed, avg(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS m FROM orders GROUP BY ALL)
 SELECT o_orderpriority, count(*) AS n_seeds, round(avg(m), 9) AS mean, round(coalesce(stddev_samp(m), 0), 9) AS sd FROM s GROUP BY 1"""
)
def seed_mean_sd(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("seed"), F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("hit"))
    out = scoring.mean_of_seeds(rows, ["o_orderpriority"], "seed", "hit")
    return out.select("o_orderpriority", "n_seeds", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query(
    """WITH g AS (SELECT radius, lag(radius) OVER (ORDER BY radius) AS "inner" FROM (SELECT DISTINCT 10 * (1 + l_linenumber % 5) AS radius FROM lineitem))
 SELECT g.radius, g."inner", count(l_quantity) AS n, count(*) FILTER (l_discount > 0.05) / nullif(count(l_quantity), 0) AS rate FROM g LEFT JOIN lineitem ON 10 * (1 + l_linenumber % 5) = g.radius AND (g."inner" IS NULL OR l_quantity > g."inner") GROUP BY ALL"""
)
def grid_shell(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("radius", 10 * (1 + F.col("l_linenumber") % 5))
    return scoring.shell_rates(rows, "radius", F.col("l_quantity"), F.col("l_discount") > 0.05)


@query("SELECT lang, toxic, count(*) AS n, count(*) FILTER (quality = 1) / count(*) AS rate, count(*) FILTER (quality = 1) / count(*) >= 0.5 AS passed FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def gate_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return scoring.cell_gate(rows, ["lang", "toxic"], F.col("quality") == 1, 0.5)


@query(
    """WITH c AS (SELECT lang, toxic, count(*) FILTER (quality = 1) / count(*) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
 SELECT toxic, max(rate) - min(rate) AS spread, max(rate) - min(rate) < 0.3 AS passed FROM c GROUP BY 1"""
)
def gate_spread(spark, sf_dir):
    return scoring.spread_gate(gate_cells(spark, sf_dir), ["toxic"], "rate", 0.3)


@query("SELECT event_type, round(max(m) + ln(avg(exp(x - m))), 9) AS value FROM (SELECT event_type, -40 * value AS x, max(-40 * value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def log_mean_exp_bias(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (-40 * F.col("value")).alias("x"))
    return stats.log_mean_exp(rows, ["event_type"], "x", "value").select("event_type", F.round("value", 9).alias("value"))


@query(
    """SELECT vec_id, round(ln(list_sum(list_transform(embedding[1:32], lambda x: exp(x::DOUBLE)))), 9) AS yes, round(ln(list_sum(list_transform(embedding[33:64], lambda x: exp(x::DOUBLE)))), 9) AS no,
 ln(list_sum(list_transform(embedding[1:32], lambda x: exp(x::DOUBLE)))) > ln(list_sum(list_transform(embedding[33:64], lambda x: exp(x::DOUBLE)))) AS says_yes, list_transform(list_reverse_sort(embedding)[1:3], lambda x: round(x::DOUBLE, 6)) AS top FROM embeddings"""
)
def forced_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    yes, no = stats.log_sum_exp(F.slice("e", 1, 32)), stats.log_sum_exp(F.slice("e", 33, 32))
    return rows.select("vec_id", F.round(yes, 9).alias("yes"), F.round(no, 9).alias("no"), stats.choose(yes, no).alias("says_yes"), F.transform(F.slice(F.sort_array("e", asc=False), 1, 3), lambda x: F.round(x, 6)).alias("top"))


@query("SELECT lang, toxic, count(*) AS n, CASE WHEN min(quality) = 1 THEN 'one' WHEN max(quality) = 0 THEN 'zero' END AS ceiling FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def ceiling_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return scoring.ceilings(rows, ["lang", "toxic"], F.col("quality") == 1)


@query("SELECT user_id, min(event_id) FILTER (value < 1) AS first_step FROM events GROUP BY 1")
def first_below(spark, sf_dir):
    return scoring.first_below(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 1.0)


@query("SELECT p_brand, arg_min(p_name, p_partkey) FILTER (p_size > 45) AS chosen FROM part GROUP BY 1")
def first_passing(spark, sf_dir):
    return scoring.first_passing(table(spark, sf_dir, "part"), ["p_brand"], "p_name", "p_partkey", F.col("p_size") > 45)


@query(
    """WITH s AS (SELECT DISTINCT o_orderpriority AS p, o_custkey AS i FROM orders), r AS (SELECT i FROM s WHERE p = '5-LOW'), n AS (SELECT DISTINCT p FROM s WHERE p <> '5-LOW')
 SELECT n.p AS o_orderpriority, (SELECT count(*) FROM r WHERE i NOT IN (SELECT i FROM s WHERE s.p = n.p)) AS missing, (SELECT count(*) FROM s WHERE s.p = n.p AND i NOT IN (SELECT i FROM r)) AS extra FROM n"""
)
def item_set_check(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("item"))
    return compare.set_sizes(rows, "o_orderpriority", "item", "5-LOW")


@query(
    """WITH m AS (SELECT o_orderstatus, month(o_orderdate) AS m, count(*) FILTER (o_totalprice > 200000) * 100 >= 58 * count(*) AS ok FROM orders GROUP BY ALL),
 w AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderstatus ORDER BY m) AS failed FROM m)
 SELECT o_orderstatus, max(m) FILTER (failed = 0) AS last_holding, coalesce(bool_or(failed > 0 AND ok), false) AS holds_again FROM w GROUP BY 1"""
)
def scan_until_failure(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.month("o_orderdate").alias("m"))
    points = rows.agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("high"))
    return compare.scan_until_failure(points, ["o_orderstatus"], "m", F.col("high") * 100 >= F.col("n") * 58)


@query(
    """WITH d AS (SELECT l_returnflag, (CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END - CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END)::DOUBLE AS d FROM lineitem)
 SELECT l_returnflag, count(d) AS n, round(avg(d), 9) AS mean, round(greatest(-1, avg(d) - 1.959963984540054 * stddev_samp(d) / sqrt(count(d))), 9) AS low, round(least(1, avg(d) + 1.959963984540054 * stddev_samp(d) / sqrt(count(d))), 9) AS high FROM d GROUP BY 1"""
)
def ci_of_differences(spark, sf_dir):
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (one(F.col("l_discount") > 0.05) - one(F.col("l_tax") > 0.04)).alias("d"))
    out = stats.mean_interval(rows, ["l_returnflag"], "d")
    return out.select("l_returnflag", "n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


@query("SELECT sha256(string_agg('[' || n_nationkey || ',\"' || n_name || '\"]', ',' ORDER BY n_nationkey)) AS hash FROM nation")
def set_hash(spark, sf_dir):
    text = F.concat(F.lit("["), F.col("n_nationkey"), F.lit(',"'), F.col("n_name"), F.lit('"]'))
    return compare.set_hash(table(spark, sf_dir, "nation"), ["n_nationkey"], text)


@query(f"{ITEMS_SQL} SELECT l_returnflag, count(*) AS n, count(*) FILTER (parsed IS NULL OR a > 40 OR b > 5) AS dropped, count(*) FILTER (parsed IS NULL) AS unread, count(*) FILTER (a > 40) AS large_a, count(*) FILTER (b > 5) AS large_b FROM items GROUP BY 1")
def drop_reasons(spark, sf_dir):
    reasons = {"unread": F.col("parsed").isNull(), "large_a": F.col("a") > 40, "large_b": F.col("b") > 5}
    return scoring.drop_reasons(items(spark, sf_dir), ["l_returnflag"], reasons)


@query(f'{ITEMS_SQL} SELECT l_linestatus, parsed - truth AS "offset", count(*) AS n FROM items WHERE parsed <> truth GROUP BY ALL')
def offset_profile(spark, sf_dir):
    return scoring.offsets(items(spark, sf_dir), ["l_linestatus"], "parsed", "truth")


@query(
    """SELECT event_type, count(*) FILTER (t) / count(*) AS always_yes, count(*) FILTER (NOT t) / count(*) AS always_no, count(*) FILTER (t = g) / count(*) AS yes_if_gt, count(*) FILTER (t <> g) / count(*) AS yes_if_lt
 FROM (SELECT event_type, value > 10 AS t, event_id % 2 = 0 AS g FROM events) GROUP BY 1"""
)
def constant_strategies(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 10).alias("truth"), F.when(F.col("event_id") % 2 == 0, "gt").otherwise("lt").alias("polarity"))
    return scoring.strategies(rows, ["event_type"], "truth", "polarity")


@query(
    f"""{PAIRS_SQL} SELECT a, b, CASE WHEN row_number() OVER (ORDER BY sha256('["split",3,' || a || ',' || b || ']'), a, b) <= 200 THEN 'pilot' ELSE 'main' END AS side FROM pairs"""
)
def pilot_split(spark, sf_dir):
    return sampling.split_by_hash(pairs(spark, sf_dir), rules.hash_text("split", 3, F.col("a"), F.col("b")), ["a", "b"], 200, "pilot", "main")


@query(
    f"""{PAIRS_SQL}, n AS (SELECT count(*) AS n FROM known), r AS (SELECT a, b, 1000 // (SELECT n FROM n) + CASE WHEN row_number() OVER (ORDER BY sha256('["repeat",' || a || ',' || b || ']'), a, b) <= 1000 % (SELECT n FROM n) THEN 1 ELSE 0 END AS times FROM known)
 SELECT a, b, cast(i AS BIGINT) AS repeat_index FROM r, range(1000) t(i) WHERE i < times"""
)
def repetition_plan(spark, sf_dir):
    out = sampling.repeat(known_pairs(spark, sf_dir), 1000, rules.hash_text("repeat", F.col("a"), F.col("b")), ["a", "b"])
    return out.withColumn("repeat_index", F.col("repeat_index").cast("long"))


@query(
    f"""{PAIRS_SQL}, c AS (SELECT a, b, sha256('["fill",' || a || ',' || b || ']') AS h, {CARRY_SQL} AS carry FROM pairs),
 f AS (SELECT a, b, 'carry' AS cell FROM (SELECT *, row_number() OVER (ORDER BY h, a, b) AS r FROM c WHERE carry = 'carry') WHERE r <= 40),
 s AS (SELECT a, b, 'any' AS cell FROM (SELECT *, row_number() OVER (ORDER BY h, a, b) AS r FROM c WHERE a + b >= 0 AND (a, b) NOT IN (SELECT (a, b) FROM f)) WHERE r <= 60)
 SELECT a, b, cell FROM f UNION ALL SELECT a, b, cell FROM s"""
)
def cell_fill(spark, sf_dir):
    cells = [("carry", F.col("carry") == "carry", 40), ("any", F.col("a") + F.col("b") >= 0, 60)]
    return sampling.fill_cells(carry(pairs(spark, sf_dir)), cells, rules.hash_text("fill", F.col("a"), F.col("b")), ["a", "b"]).select("a", "b", "cell")


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus IN (SELECT o_orderstatus FROM orders WHERE o_totalprice > 450000)) AS kept FROM orders GROUP BY 1")
def solved_scope(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    high = orders.where("o_totalprice > 450000").select("o_orderstatus").distinct().withColumn("in_scope", F.lit(True))
    return orders.join(high, "o_orderstatus", "left").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.coalesce("in_scope", F.lit(False))).alias("kept"))


@query()
def logistic_fit(spark, sf_dir):
    """A curve for each event type over theta; an iterative fit, checked in tests."""
    rows = events(spark, sf_dir).withColumn("theta", F.expr("k div 10")).withColumn("hit", F.expr("value * 3 + k > 75"))
    return stats.locate_crossings(stats.theta_counts(rows, ["event_type"], "theta", "hit"), ["event_type"])


@query()
def exact_intervals(spark, sf_dir):
    """Exact binomial intervals of correct answers; checked against tail sums in tests."""
    counts = classified(spark, sf_dir).groupBy("l_linenumber").agg(F.count_if(F.col("classification") == "correct").alias("k"), F.count("*").alias("n"))
    return stats.with_exact_interval(counts, "k", "n")


@query()
def seeded_strata(spark, sf_dir):
    """A shuffle of each stratum by Python's generator; its order has no SQL form."""
    return sampling.seeded_order(carry(pairs(spark, sf_dir)), ["carry"], ["a", "b"], 5)


@query()
def word_numbers(spark, sf_dir):
    """Numbers in words and final lines of turns; Unicode folding and word tables are read in Python."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.parse_words("text").alias("value"), parsing.final_answer("text").alias("final"), parsing.parse_number(F.col("text")).alias("number"))


@query(
    """WITH u AS (SELECT p_brand, p_partkey, min(p_type) AS old FROM part GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('["deal",3,' || p_partkey || ']'), p_partkey) AS d FROM u)
 SELECT t.p_partkey, t.p_brand, s.old AS p_type FROM i t JOIN i s ON s.p_brand = t.p_brand AND s.k = t.d"""
)
def permuted_tasks(spark, sf_dir):
    """Labels dealt anew to items."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return sampling.permuted_labels(rows, ["p_brand"], "p_partkey", "p_type", 3)


# further queries register themselves
from tallyloom.plans import decisions, designs, pools, profiles, reports, studies  # noqa: E402, F401
