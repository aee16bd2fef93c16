"""Queries of curves and limits of power over the driver's tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import curves
from tallyloom.plans.catalog import query, table

NODES = 12


@query(
    """WITH s AS (SELECT event_type, CASE WHEN user_id % 9 <= 2 THEN 'low' WHEN user_id % 9 >= 6 THEN 'high' END AS side, abs(value - 10) <= 4 AS near, event_id % 3 > 0 AS ok FROM events)
 SELECT event_type, side, count(*) AS n, count(*) FILTER (near) AS n_near_tie, CASE WHEN bool_and(near) THEN NULL ELSE count(*) FILTER (ok AND NOT near) END AS n_correct,
 count(*) FILTER (ok AND NOT near) / nullif(count(*) FILTER (NOT near), 0) AS correct_rate FROM s WHERE side IS NOT NULL GROUP BY ALL"""
)
def far_without_near_ties(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("theta", F.col("user_id") % 9).withColumn("gap", F.col("value") - 10)
    return curves.sides_without_near_ties(rows, ["event_type"], "theta", 2, 6, "gap", 4.0, F.col("event_id") % 3 > 0)


def _limits_sql(direction: str) -> str:
    return f"""WITH p AS (SELECT o_orderpriority, o_orderstatus, month(o_orderdate) AS m, count(*) FILTER (o_totalprice > 150000) * 100 >= 55 * count(*) AS ok FROM orders GROUP BY ALL),
 w AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY m {direction}) AS failed FROM p),
 l AS (SELECT o_orderpriority, o_orderstatus, arg_max(m, {'-m' if direction == 'DESC' else 'm'}) FILTER (failed = 0) AS last_holding, arg_min(m, {'-m' if direction == 'DESC' else 'm'}) FILTER (failed > 0) AS first_failing, coalesce(bool_or(failed > 0 AND ok), false) AS non_monotone FROM w GROUP BY ALL)
 SELECT *, CASE WHEN first_failing IS NULL THEN 'everywhere' WHEN last_holding IS NULL THEN 'nowhere' ELSE 'inside' END AS verdict FROM l"""


def _limits(spark, sf_dir, descending: bool):
    points = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus", F.month("o_orderdate").alias("m"))
    power = points.agg((F.count_if(F.col("o_totalprice") > 150000) * 100 - 55 * F.count("*")).alias("power"))
    return curves.power_limits(power, ["o_orderpriority", "o_orderstatus"], "m", "power", 0, descending)


@query(_limits_sql("ASC"))
def limits_upwards(spark, sf_dir):
    return _limits(spark, sf_dir, False)


@query(_limits_sql("DESC"))
def limits_downwards(spark, sf_dir):
    return _limits(spark, sf_dir, True)


@query("SELECT l_returnflag, l_linestatus, max(greatest(abs(l_discount - 0.05) + 1.5 * l_tax, abs(l_tax - 0.02) + 1.5 * l_discount)) AS margin FROM lineitem GROUP BY ALL")
def equivalence_margins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_discount") - 0.05).withColumn("y", F.col("l_tax") - 0.02)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.max(curves.equivalence_margin(["x", "y"], ["l_tax", "l_discount"], 1.5)).alias("margin"))


_SUM = " + ".join(f"{w / math.sqrt(math.pi)!r} / (1 + exp(-(eta + sqrt(2 * v) * ({x!r}))))" for x, w in zip(*(a.tolist() for a in np.polynomial.hermite.hermgauss(NODES))))


@query(f"SELECT p_partkey, round({_SUM}, 9) AS rate FROM (SELECT p_partkey, p_size / 10.0 - 2.5 AS eta, (p_partkey % 7) / 2.0 AS v FROM part)")
def marginal_rates(spark, sf_dir):
    rate = curves.marginal_rate(F.col("p_size") / 10.0 - 2.5, (F.col("p_partkey") % 7) / 2.0, NODES)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(rate, 9).alias("rate"))
