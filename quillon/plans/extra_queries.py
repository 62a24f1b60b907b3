"""Additional coverage: grouping sets, cube, rollup and sketches; the surveyed system has none of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import views as V
from quillon.plans.registry import query
from quillon.sources.tables import table


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def extra_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def extra_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey))")
def extra_grouping_sets(spark, d):
    rows = table(spark, d, "customer")
    return rows.groupingSets([[F.col("c_mktsegment")], [F.col("c_nationkey")]], F.col("c_mktsegment"), F.col("c_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@query()
def extra_approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def newest_of_kind(spark, d):
    """O2, O3, Q2, Q5: a feed whose length is clamped."""
    rows = table(spark, d, "orders").withColumn("kind", F.col("o_orderpriority"))
    return V.feed(rows, "1-URGENT", ["o_orderdate", "o_orderkey"], 500, 100).select("o_orderkey", "o_totalprice")


@query("SELECT round(CAST(coalesce(sum(CAST(l_tax * 100 AS INTEGER)), 0) AS DOUBLE), 6) AS spent FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01')")
def month_to_date(spark, d):
    """J30, A4."""
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started_at"))
    sources = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.round(F.col("l_tax") * 100).alias("cost"))
    return V.month_to_date(sources, runs, F.lit("2001-07-01").cast("timestamp_ntz"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem l WHERE l_returnflag = 'A' AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')
AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_returnflag = 'N')""")
def carried_forward(spark, d):
    """Lines of one flag carried to the next, where the order has none there."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("url"), F.col("l_returnflag").alias("prompt_version"), "l_partkey", "l_suppkey", "l_linenumber")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderpriority").alias("kind"))
    out = V.carried_forward(lines, orders, "A", "N", "1-URGENT")
    return out.select(F.col("url").alias("l_orderkey"), "l_partkey", "l_suppkey", "l_linenumber")


@query("""WITH u AS (SELECT user_id, CASE WHEN bool_or(event_type = 'signup') THEN count(*) END AS p FROM events GROUP BY 1), f AS (SELECT user_id, p, CASE WHEN p <= 8 THEN greatest(5, least(40, p)) END AS small FROM u),
s AS (SELECT 20000 - coalesce(sum(small), 0) AS budget, count(*) FILTER (p > 8) AS k FROM f), e AS (SELECT budget, k, greatest(8, least(40, budget // k)) AS each FROM s),
g AS (SELECT budget, CASE WHEN each * k > budget THEN greatest(5, budget // k) ELSE each END AS each FROM e)
SELECT user_id, CAST(CASE WHEN p IS NULL THEN 40 ELSE coalesce(small, greatest(5, least(each, p))) END AS BIGINT) AS cap FROM f, g WHERE p IS NULL OR small IS NOT NULL OR budget > 0""")
def post_allocation(spark, d):
    """users without a signup are the ones of unknown rate."""
    users = table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("known"), F.count(F.lit(1)).alias("n"))
    return V.allocation(users.select("user_id", F.when(F.col("known"), F.col("n")).alias("projected")), 20000, 40, 8, 8).select("user_id", "cap")
