"""Queries of strict profiles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import profiles
from tallyloom.plans.catalog import EVENT_K, ITEMS_SQL, RATES_SQL, classified, events, query, table

_CLASS_SQL = "CASE WHEN parsed IS NULL THEN 'parse_fail' WHEN parsed = truth THEN 'correct' WHEN parsed = p2 THEN 'rule' ELSE 'other_error' END"


@query(
    """SELECT l_linestatus, sum(CASE g WHEN 'spec_sub' THEN a - b WHEN 'spec_mul' THEN a * b ELSE a + b END)::BIGINT AS truth, sum(CASE g WHEN 'spec_sub' THEN a - b + 2 WHEN 'spec_mul' THEN a * b + 2 ELSE a + b + 2 * (1 + l_suppkey % 3) END)::BIGINT AS rule
 FROM (SELECT *, ['spec_sub', 'spec_mul', 'sum', 'sum'][1 + l_partkey % 4] AS g, cast(l_quantity AS BIGINT) AS a, l_linenumber::BIGINT AS b FROM lineitem) GROUP BY 1"""
)
def truths_by_group(spark, sf_dir):
    group = F.get(F.array(*map(F.lit, ("spec_sub", "spec_mul", "sum", "sum"))), (F.col("l_partkey") % 4).cast("int"))
    pair = profiles.truth_and_rule(group, F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), 2, 1 + F.col("l_suppkey") % 3)
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", pair.alias("p"))
    return rows.groupBy("l_linestatus").agg(F.sum("p.truth").alias("truth"), F.sum("p.rule").alias("rule"))


@query(f"{ITEMS_SQL} SELECT l_returnflag, l_linestatus, count(*) AS n_items, {RATES_SQL}, count(*) FILTER (c = 'correct') / count(*) < 0.405 AS fails FROM (SELECT *, {_CLASS_SQL} AS c FROM items WHERE l_returnflag <> 'N') GROUP BY ALL")
def cells_required(spark, sf_dir):
    return profiles.cell_table(classified(spark, sf_dir), [], "l_returnflag", ["A", "R"], "l_linestatus", ["F", "O"], 0.405)


@query("SELECT lang, CASE WHEN label < 4 THEN 'gt' ELSE 'lt' END AS polarity, split_part(trim(text), ' ', 1) AS text, count(*) AS n FROM (SELECT *, length(text) % 8 AS label FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def first_token_counts(spark, sf_dir):
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").where(text.isNotNull())
    records = rows.select("lang", F.when(F.length(text) % 8 < 4, "gt").otherwise("lt").alias("polarity"), F.transform(F.slice(F.split(F.trim(text), " ", 3), 1, 2), lambda w: F.struct(w.alias("text"))).alias("top_k"))
    return profiles.first_tokens(records, ["lang", "polarity"])


@query(
    """WITH r AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), u AS (SELECT conv_id, max(n) AS x FROM r GROUP BY 1), y AS (SELECT conv_id, min(n) AS y FROM r GROUP BY 1)
 SELECT conv_id % 5 AS part, count(*) AS n, avg(x - y) AS mean, min(x - y)::BIGINT AS least, max(x - y)::BIGINT AS most FROM u JOIN y USING (conv_id) GROUP BY 1"""
)
def lengths_paired(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.length("text")).alias("long"), F.min(F.length("text")).alias("short"))
    arms = rows.select((F.col("conv_id") % 5).alias("part"), "conv_id", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(a).alias("n")) for a in ("long", "short")))).alias("s")).select("part", "conv_id", "s.*")
    return profiles.paired_lengths(arms, ["part"], "arm", "long", "short", "conv_id", F.col("n"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_suppkey % 3 < 2) AS n_written FROM lineitem GROUP BY 1")
def sums_written(spark, sf_dir):
    a, b = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    said = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("so "), a.cast("string"), F.lit(" + "), b.cast("string"), F.lit(" is"))).when(F.col("l_suppkey") % 3 == 1, F.concat(b.cast("string"), F.lit("+"), a.cast("string"))).otherwise(F.concat(F.lit("9"), a.cast("string"), F.lit("+"), b.cast("string"), F.lit("0")))
    rows = table(spark, sf_dir, "lineitem").withColumn("said", said)
    return profiles.expression_counts(rows, ["l_returnflag"], "said", a, b)


@query(
    f"""WITH s AS (SELECT event_type, {EVENT_K} % 4 AS symbol, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, round(ln(avg(exp(-v))) - ln(avg(exp(-2 * v + 1))), 9) AS bias FROM s GROUP BY 1"""
)
def bias_over_symbols(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("event_type", (F.col("k") % 4).cast("string").alias("symbol")).agg(F.avg("value").alias("v"))
    rows = rows.select("event_type", "symbol", (-F.col("v")).alias("yes"), (1 - 2 * F.col("v")).alias("no"))
    return profiles.content_free_bias(rows, ["event_type"], "symbol", ["0", "1", "2", "3"], "yes", "no").withColumn("bias", F.round("bias", 9))


@query("SELECT DISTINCT p_brand, p_size % 3 AS level FROM part WHERE p_size > 45 AND p_retailprice > 950")
def cells_confirmed(spark, sf_dir):
    marks = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 3).alias("level"), ((F.col("p_size") > 45) & (F.col("p_retailprice") > 950)).alias("fails"))
    return profiles.confirmed_cells(marks, ["p_brand", "level"], "fails", marks.groupBy("p_brand", "level").agg(F.bool_or("fails").alias("any")).where("any"))


@query(
    """SELECT o_orderpriority, coefficient, count(v) AS n, count(*) FILTER (v IS NULL) AS missing, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.25), 6) AS q_25, round(quantile_cont(v, 0.5), 6) AS q_50 FROM (
 SELECT o_orderpriority, 'price' AS coefficient, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders UNION ALL SELECT o_orderpriority, 'days', (o_custkey % 97)::DOUBLE FROM orders) GROUP BY ALL"""
)
def coefficients_summed_up(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"), (F.col("o_custkey") % 97).alias("days"))
    out = profiles.coefficient_summary(rows, ["o_orderpriority"], ["price", "days"], (0.25, 0.5))
    return out.select("o_orderpriority", "coefficient", "n", "missing", *(F.round(c, 6).alias(c) for c in ("mean", "q_25", "q_50")))
