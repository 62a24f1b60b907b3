"""Scores, aggregates, windows and top-k on the star schema and on events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.operators import topk as K
from quillon.operators import windows as W
from quillon.operators.scalar_filters import with_defaults
from quillon.plans.registry import query
from quillon.sources.tables import table

_MAGNITUDE = "CASE WHEN l_quantity >= 34 THEN 'high' WHEN l_quantity >= 17 THEN 'medium' ELSE 'low' END"
_CONFIDENCE = "CASE WHEN l_discount >= 0.07 THEN 'high' WHEN l_discount >= 0.03 THEN 'medium' ELSE 'low' END"
_EVENT = "CASE o_orderpriority WHEN '1-URGENT' THEN 5.0 WHEN '2-HIGH' THEN 4.0 WHEN '3-MEDIUM' THEN 3.0 WHEN '4-NOT SPECIFIED' THEN 2.0 ELSE 1.0 END"
_LEVEL = "CASE {0} WHEN 'high' THEN 3.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
_GATE = "CASE {0} WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
_BAND = "CASE WHEN {0} >= 75 THEN 'critical' WHEN {0} >= 50 THEN 'high' WHEN {0} >= 25 THEN 'medium' ELSE 'low' END"
_ACTIONS = {"R": 3.0, "A": 2.0, "N": 1.0}


def _tags(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), F.expr(_MAGNITUDE).alias("magnitude"), F.expr(_CONFIDENCE).alias("confidence"), F.col("l_returnflag").alias("action"), F.expr(_MAGNITUDE).alias("impact"))


def _scored(spark, d):
    orders = table(spark, d, "orders")
    return A.both_scores(orders, _tags(spark, d), "o_orderkey", F.expr(_EVENT).cast("double"), _ACTIONS)


_SCORED = f"""WITH s AS (SELECT o_orderkey, any_value(o_custkey) AS o_custkey, any_value(o_orderdate) AS o_orderdate, any_value(o_orderpriority) AS o_orderpriority,
 round(100.0::DOUBLE * (CAST(any_value({_EVENT}) AS DOUBLE) / 5.0::DOUBLE) * (coalesce(max({_LEVEL.format('(' + _MAGNITUDE + ')')} * {_GATE.format('(' + _CONFIDENCE + ')')}), 0.0::DOUBLE) / 3.0::DOUBLE), 1) AS score,
 round(100.0::DOUBLE * (coalesce(max(CASE l_returnflag WHEN 'R' THEN 3.0::DOUBLE WHEN 'A' THEN 2.0::DOUBLE WHEN 'N' THEN 1.0::DOUBLE END), 0.0::DOUBLE) / 3.0::DOUBLE)
  * (coalesce(max({_LEVEL.format('(' + _MAGNITUDE + ')')} * {_GATE.format('(' + _CONFIDENCE + ')')}), 0.0::DOUBLE) / 3.0::DOUBLE), 1) AS ai_score
 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""


@query(_SCORED + f" SELECT o_orderkey, score, {_BAND.format('score')} AS band FROM s")
def max_tag_score(spark, d):
    """A5, A7, F61."""
    return _scored(spark, d).select("o_orderkey", "score", A.band_of(F.col("score")).alias("band"))


@query(_SCORED + f" SELECT o_orderkey, ai_score, {_BAND.format('ai_score')} AS band, greatest(score, ai_score) AS significance FROM s")
def ai_score(spark, d):
    """A6, G7."""
    return _scored(spark, d).select("o_orderkey", "ai_score", A.band_of(F.col("ai_score")).alias("band"), F.greatest("score", "ai_score").alias("significance"))


@query(_SCORED + " SELECT o_orderkey, greatest(score, ai_score) AS rank_value, least(score, ai_score) AS rank_min FROM s ORDER BY 2 DESC, 3 DESC, o_orderdate DESC, 1 LIMIT 50")
def scored_topk(spark, d):
    """The flagship: J3's tags to A5's and A6's scores to W5's ranks to O1's cap and order."""
    value, least = W.rank_key("score", "ai_score")
    rows = _scored(spark, d).withColumn("rank_value", value).withColumn("rank_min", least)
    top = K.capped_digest(rows, [F.desc("rank_value"), F.desc("rank_min"), F.desc("o_orderdate"), F.asc("o_orderkey")], [F.desc("o_orderdate"), F.desc("rank_value"), F.asc("o_orderkey")], 50)
    return top.select("o_orderkey", "rank_value", "rank_min")


@query(_SCORED + ", g AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS group_size, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, CAST(o_orderdate AS DATE), o_orderkey) AS n FROM s) SELECT o_custkey, o_orderkey, score, group_size FROM g WHERE n = 1")
def anchor_group(spark, d):
    """W1, G6."""
    return W.anchors(_scored(spark, d), "o_custkey", "score", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "score", "group_size")


@query(_SCORED + ", g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS n FROM s) SELECT o_custkey, o_orderkey FROM g WHERE n = 1")
def release_latest(spark, d):
    """W1 for release trains: the latest of equals."""
    return W.anchors(_scored(spark, d), "o_custkey", "score", "o_orderdate", "o_orderkey", latest=True).select("o_custkey", "o_orderkey")


@query(_SCORED + ", g AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS members FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, CAST(o_orderdate AS DATE), o_orderkey) AS n FROM g WHERE ai_score >= 50) SELECT o_custkey, o_orderkey, members FROM p WHERE n = 1")
def first_passing(spark, d):
    """W2."""
    return W.first_passing(_scored(spark, d), "o_custkey", F.col("ai_score") >= 50, "score", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "members")


@query(f"""SELECT o_orderkey, l_partkey AS mechanism, weight FROM (SELECT l_orderkey AS o_orderkey, l_partkey, w AS weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, o) AS n
FROM (SELECT *, {_LEVEL.format('(' + _MAGNITUDE + ')')} * {_GATE.format('(' + _CONFIDENCE + ')')} / 3.0::DOUBLE AS w, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS o FROM lineitem) WHERE w > 0) WHERE n = 1""")
def strongest_tag(spark, d):
    """W3."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr(_MAGNITUDE).alias("magnitude"), F.expr(_CONFIDENCE).alias("confidence"), F.col("l_partkey").alias("mechanism"), (F.col("l_linenumber") * F.lit(10000000000) + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("ordinal"))
    return W.strongest_tag(rows, "o_orderkey").select("o_orderkey", "mechanism", "weight")


@query("SELECT o_orderpriority, max(o_orderdate) AS newest, count(*) AS n FROM orders GROUP BY 1")
def watermark_group(spark, d):
    """A1."""
    return A.watermarks(table(spark, d, "orders"), "o_orderpriority", "o_orderdate")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS {s.lower()}" for s in _SEGMENTS) + ", count(*) FILTER (c_acctbal < 0) AS negative, count(*) AS total FROM customer GROUP BY 1")
def conditional_counts(spark, d):
    """A2, A3, A10, A19, A30, A33."""
    rows = table(spark, d, "customer")
    return rows.groupBy("c_nationkey").agg(*[F.count_if(F.col("c_mktsegment") == s).alias(s.lower()) for s in _SEGMENTS], F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count(F.lit(1)).alias("total"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_status(spark, d):
    """A18, A34."""
    return A.pivot_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, bool_and(l_quantity > 2) AS all_large FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def having_distinct(spark, d):
    """A8, A9, A23."""
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.bool_and(F.col("l_quantity") > 2).alias("all_large")).where("suppliers >= 2")


@query("SELECT p_brand FROM part GROUP BY 1 HAVING bool_and(p_retailprice > 905) ORDER BY 1")
def forall_gate(spark, d):
    """A9."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.bool_and(F.col("p_retailprice") > 905).alias("ok")).where("ok").select("p_brand")


_REVENUE = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"


def _revenue(spark, d):
    return table(spark, d, "lineitem").withColumn("revenue", F.expr(_REVENUE))


@query(f"SELECT l_suppkey, round(CAST(sum({_REVENUE}) AS DOUBLE), 2) AS total, round(CAST(100 * sum({_REVENUE}) AS DOUBLE) / CAST((SELECT sum({_REVENUE}) FROM lineitem) AS DOUBLE), 4) AS pct FROM lineitem GROUP BY 1")
def share_of_total(spark, d):
    """A24, A26."""
    rows = A.shares(_revenue(spark, d).withColumn("revenue", F.col("revenue").cast("decimal(18,4)")), ["l_suppkey"], "revenue")
    return rows.select("l_suppkey", F.round(F.col("total").cast("double"), 2).alias("total"), F.round(F.col("pct").cast("double"), 4).alias("pct"))


@query(f"WITH s AS (SELECT l_suppkey, sum({_REVENUE}) AS t FROM lineitem GROUP BY 1) SELECT round(100 * CAST((SELECT sum(t) FROM (SELECT t FROM s ORDER BY t DESC LIMIT 10)) AS DOUBLE) / CAST(sum(t) AS DOUBLE), 4) AS pct FROM s")
def concentration(spark, d):
    """A25."""
    sums = _revenue(spark, d).groupBy("l_suppkey").agg(F.sum("revenue").alias("t")).withColumn("t", F.col("t").cast("double"))
    return A.concentration(sums, "t", 10)


_PCT = f"""WITH s AS (SELECT s_nationkey, s_name, sum({_REVENUE}) AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
p AS (SELECT s_nationkey, s_name, round(100 * CAST(t AS DOUBLE) / CAST(sum(t) OVER (PARTITION BY s_nationkey) AS DOUBLE), 4) AS pct FROM s)"""


@query(_PCT + " SELECT s_nationkey, max(pct) AS max_pct, arg_max(s_name, (pct, s_name)) AS top_name, count(*) FILTER (pct > 5) AS n_over_5, round(coalesce(sum(pct) FILTER (pct > 5), 0), 4) AS sum_over_5, count(*) FILTER (pct > 10) AS n_over_10 FROM p GROUP BY 1")
def limit_rules(spark, d):
    """A27."""
    rows = _revenue(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy("s_nationkey", "s_name").agg(F.sum("revenue").alias("t"))
    whole = F.sum("t").over(Window.partitionBy("s_nationkey")).cast("double")
    return A.limit_rules(sums.withColumn("pct", F.round(100 * F.col("t").cast("double") / whole, 4)), "s_nationkey", "s_name", "pct")


@query("SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1")
def set_agg(spark, d):
    """A11, A20-A22."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS total, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts, min(lo) AS first_seen, max(hi) AS last_seen FROM p GROUP BY 1""")
def two_level_map(spark, d):
    """A15, A16, F70."""
    rows = A.map_of_counts(table(spark, d, "events"), "user_id", "event_type", "ts")
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.withColumn("counts", text)


@query("""WITH s AS (SELECT l_partkey, l_suppkey, max(floor(l_extendedprice / l_quantity / 100)) AS t FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey, max(t) AS strength FROM s GROUP BY 1)
SELECT l_partkey, strength, array_to_string(list_sort(list(l_suppkey)), ',') AS members FROM s JOIN b USING (l_partkey) WHERE t = strength GROUP BY ALL""")
def tied_top(spark, d):
    """W4."""
    rows = table(spark, d, "lineitem").withColumn("s", F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 100).cast("double"))
    return W.tied_top(rows, "l_partkey", "l_suppkey", "s").select("l_partkey", "strength", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(_SCORED + """, g AS (SELECT *, greatest(score, ai_score) AS rank_value, least(score, ai_score) AS rank_min FROM s)
SELECT o_orderkey, rank_value, rank_min FROM (SELECT * FROM g ORDER BY rank_value DESC, rank_min DESC, o_orderdate DESC, o_orderkey LIMIT 100)""")
def rank_two_scores(spark, d):
    """W5, O1, O12."""
    value, least = W.rank_key("score", "ai_score")
    rows = _scored(spark, d).withColumn("rank_value", value).withColumn("rank_min", least)
    return K.capped_digest(rows, [F.desc("rank_value"), F.desc("rank_min"), F.desc("o_orderdate"), F.asc("o_orderkey")], [F.desc("o_orderdate")], 100).select("o_orderkey", "rank_value", "rank_min")


@query("""WITH x AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM x),
g AS (SELECT user_id, run, count(*) AS streak, max(day) AS last_day FROM r GROUP BY ALL) SELECT user_id, arg_max(streak, last_day) AS streak, CAST(max(last_day) AS VARCHAR) AS last_day FROM g GROUP BY 1""")
def active_streak(spark, d):
    """W8, W9, W25."""
    days = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    return W.trailing_streak(days, "user_id", "day").withColumn("last_day", F.col("last_day").cast("string"))


_MONTHLY = "WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY ALL)"


def _monthly(spark, d):
    rows = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rows.groupBy("o_orderpriority", "month").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))


@query(_MONTHLY + " SELECT o_orderpriority, month, round(100.0::DOUBLE * (revenue / lag(revenue, 4) OVER (PARTITION BY o_orderpriority ORDER BY month) - 1), 4) AS change_pct FROM m")
def runup_lag(spark, d):
    """W10, J20."""
    return W.lag_change(_monthly(spark, d), "o_orderpriority", "month", "revenue").select("o_orderpriority", "month", "change_pct")


@query(_MONTHLY + " SELECT o_orderpriority, arg_min(revenue, month) AS first, arg_max(revenue, month) AS last, max(revenue) AS highest, round(100.0::DOUBLE * (arg_max(revenue, month) / arg_min(revenue, month) - 1), 4) AS change_pct, count(*) AS n FROM m GROUP BY 1")
def window_delta(spark, d):
    """W11, F50."""
    rows = W.window_delta(_monthly(spark, d), "o_orderpriority", "month", "revenue")
    return rows.select("o_orderpriority", "first", "last", "highest", "change_pct", F.size("series").cast("long").alias("n"))


_TOP10 = """WITH s AS (SELECT strftime(l_shipdate, '%Y') AS period, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY total DESC, l_partkey) AS rank FROM s) WHERE rank <= 10)"""


def _top10(spark, d):
    rows = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("period"), "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return rows, W.top_per_period(rows, "period", "l_partkey", "q", 10)


@query(_TOP10 + " SELECT period, l_partkey, CAST(total AS BIGINT) AS total FROM t")
def top10_per_year(spark, d):
    """W13."""
    return _top10(spark, d)[1].select("period", "l_partkey", "total")


@query(_TOP10 + """, p AS (SELECT l_partkey, dense_rank() OVER (ORDER BY period) AS p FROM t), n AS (SELECT l_partkey, count(DISTINCT p) AS n FROM p GROUP BY 1)
SELECT count(*) AS ever, count(*) FILTER (n = (SELECT max(p) FROM p)) AS always, round((SELECT count(*) FROM p a JOIN p b ON a.l_partkey = b.l_partkey AND b.p = a.p + 1) / ((SELECT max(p) FROM p) - 1), 4) AS mean_carried FROM n""")
def churn_top10(spark, d):
    """W13, U3."""
    return W.churn(_top10(spark, d)[1], "period", "l_partkey")


@query(_TOP10 + """ SELECT l_partkey, CAST(t.total AS BIGINT) AS "then", CAST(coalesce(n.total, 0) AS BIGINT) AS now FROM t LEFT JOIN (SELECT * FROM s WHERE period = (SELECT max(period) FROM s)) n USING (l_partkey) WHERE t.period = (SELECT min(period) FROM s)""")
def cohort_then_now(spark, d):
    """W14."""
    rows, tops = _top10(spark, d)
    return W.cohort(tops, rows, "period", "l_partkey", "q").select("l_partkey", "then", F.col("now").cast("long").alias("now"))


_QUARTERS = """WITH q AS (SELECT l_partkey AS k, strftime(l_shipdate, '%Y-%m') AS period, sum(CAST(l_quantity AS BIGINT)) AS shares, floor(max(l_extendedprice / l_quantity)) AS price FROM lineitem GROUP BY ALL)"""


def _quarters(spark, d):
    rows = table(spark, d, "lineitem").withColumn("period", F.date_format("l_shipdate", "yyyy-MM"))
    return rows.groupBy(F.col("l_partkey").alias("k"), "period").agg(F.sum(F.col("l_quantity").cast("long")).alias("shares"), F.floor(F.max(F.col("l_extendedprice") / F.col("l_quantity"))).cast("double").alias("price"))


@query(_QUARTERS + """, x AS (SELECT *, (shares - lag(shares) OVER (PARTITION BY k ORDER BY period)) * price AS m FROM q)
SELECT k, round(-coalesce(sum(m), 0), 2) + 0 AS flow, round(arg_min(shares, period) * arg_max(price, period), 2) AS untraded, round(arg_max(shares, period) * arg_max(price, period), 2) AS held FROM x GROUP BY 1""")
def counterfactual(spark, d):
    """W12. Sums of two-place numbers are rounded on both sides."""
    return W.counterfactual(_quarters(spark, d), "k", "period", "shares", "price").withColumn("flow", F.col("flow") + F.lit(0.0))


@query(_QUARTERS + """, e AS (SELECT k, period, abs(price / (shares + 900.0::DOUBLE) - 1) AS error FROM q), j AS (SELECT k, max(period) FILTER (error >= 0.4) AS jump, max(period) AS newest FROM e GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period DESC) AS n FROM e JOIN j USING (k) WHERE jump IS NULL OR jump = newest OR period > jump)
SELECT k, jump, count(*) AS checked, round(max(error), 6) AS worst, arg_max(period, (error, period)) AS worst_at, round(max(error), 6) <= 0.02 AS ok FROM l WHERE n <= 4 GROUP BY ALL""")
def post_split_verify(spark, d):
    """A price against a stand-in one; jumps cut off what was before."""
    rows = _quarters(spark, d).withColumn("theirs", F.col("shares") + F.lit(900.0))
    return W.verify_prices(rows, "k", "period", "price", "theirs").select("k", "jump", "checked", "worst", "worst_at", "ok")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE (n - 1) % 5 = 0 OR n = c")
def downsample(spark, d):
    """W17."""
    return W.downsampled(table(spark, d, "events"), "user_id", ["ts", "event_id"], 5).select("event_id")


@query("SELECT c_custkey, round(avg_rank, 1) AS avg_rank FROM (SELECT c_custkey, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0::DOUBLE AS avg_rank FROM (SELECT c_custkey, round(c_acctbal, -2) AS r FROM customer))")
def average_rank(spark, d):
    """W19."""
    rows = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", -2).alias("r"))
    return W.average_rank(rows, "r", "avg_rank").select("c_custkey", F.round("avg_rank", 1).alias("avg_rank"))


@query("SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def latest_amendment(spark, d):
    """W20-W22, W26, S12."""
    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    return W.latest_per(rows, ["o_custkey", "year"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "year", "o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_type <> 'PROMO' AND p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def gated_topk(spark, d):
    """O5, O6, O14."""
    return K.accepted_top(table(spark, d, "part"), (F.col("p_type") != "PROMO") & (F.col("p_size") > 10), [F.desc("p_retailprice"), F.asc("p_partkey")], 10).select("p_partkey")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down,
count(*) OVER (PARTITION BY user_id) AS c, bool_or(event_type = 'signup') OVER (PARTITION BY user_id) AS has FROM events) SELECT event_id, greatest(c - 3, 0) AS truncated FROM n WHERE CASE WHEN has THEN up ELSE down END <= 3""")
def cap_by_direction(spark, d):
    """Users who signed up stand for those with a cursor."""
    events = table(spark, d, "events")
    has = events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("has"))
    return K.capped_by_cursor(events.join(has, "user_id"), "user_id", ["ts", "event_id"], F.col("has"), 3).select("event_id", "truncated")


@query("SELECT user_id, count(*) AS n, round(max(spent), 2) AS spent FROM (SELECT user_id, sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 500 GROUP BY 1")
def budget_walk(spark, d):
    """W24, I15, F67."""
    rows = table(spark, d, "events").withColumn("cost", F.col("value").cast("decimal(18,4)"))
    return W.within_budget(rows, "cost", [F.col("ts"), F.col("event_id")], 500, ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("spent"), 2).alias("spent"))


@query("""WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT *, n * 200.0::DOUBLE / sum(n) OVER () AS x FROM g), f AS (SELECT *, floor(x) AS w FROM w)
SELECT c_nationkey, CAST(w + CASE WHEN row_number() OVER (ORDER BY x - w DESC, c_nationkey) <= 200 - sum(w) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats FROM f""")
def apportionment(spark, d):
    """A39."""
    sizes = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return A.apportion(sizes, "c_nationkey", "n", 200).select("c_nationkey", "seats")


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_path(spark, d):
    """F72, P15, S8, S3."""
    return with_defaults(table(spark, d, "events").select("event_id", "props"), "props", {"k": ("long", -1), "missing": ("string", "none")}).select("event_id", "k", "missing")
