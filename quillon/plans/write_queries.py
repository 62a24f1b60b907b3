"""Write semantics, dates, costs and small set operators over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import dates as D
from quillon.functions import maths as N
from quillon.functions import text as X
from quillon.operators import aggregates as A
from quillon.operators import dml, joins as J
from quillon.operators import scalar_filters as S
from quillon.operators import windows as W
from quillon.plans.registry import query
from quillon.sources.tables import table


def _old_new(spark, d):
    """Orders of even customers as the stored table, those of customers divisible by three as the new rows."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("version"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))
    return rows.where("cust % 2 = 0"), rows.where("cust % 3 = 0").withColumn("price", F.when(F.col("cust") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")))


_OLD_NEW = """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS version, o_totalprice AS price, o_custkey AS cust FROM orders), o AS (SELECT * FROM r WHERE cust % 2 = 0),
n AS (SELECT id, version, CASE WHEN cust % 5 = 0 THEN price + 1 ELSE price END AS price, cust FROM r WHERE cust % 3 = 0)"""


@query(_OLD_NEW + " SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def hash_upsert(spark, d):
    """M1, K1, K2: the merged table."""
    old, new = _old_new(spark, d)
    return dml.upsert(old, new, "id", "cust", "price")[0]


@query(_OLD_NEW + """ SELECT count(*) FILTER (o.id IS NULL) AS added, count(*) FILTER (o.id IS NOT NULL AND n.id IS NOT NULL AND o.price <> n.price) AS updated,
 count(*) FILTER (o.price = n.price) AS unchanged, count(*) FILTER (n.id IS NULL) AS kept, count(*) AS total FROM o FULL JOIN n USING (id)""")
def upsert_counts(spark, d):
    """M1: what an upsert did."""
    old, new = _old_new(spark, d)
    return dml.upsert(old, new, "id", "cust", "price")[1]


@query(_OLD_NEW + " SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = n.id AND o.version = n.version)")
def insert_absent(spark, d):
    """M2: new rows whose key and version the table lacks."""
    old, new = _old_new(spark, d)
    return dml.insert_absent(old, new, ["id", "version"])


@query(_OLD_NEW + " SELECT * FROM o WHERE version <> 'F' OR id NOT IN (SELECT id FROM n WHERE version = 'F') UNION ALL SELECT * FROM n WHERE version = 'F'")
def rebuild_version(spark, d):
    """M3: one version's rows replaced by key."""
    old, new = _old_new(spark, d)
    return dml.rebuild_version(old, new.where("version = 'F'"), "id", "version", "F")


@query("""WITH r AS (SELECT event_id AS id, ts AS started_at, CASE WHEN value > 50 THEN 'running' ELSE 'ok' END AS status FROM events)
SELECT id, CASE WHEN status = 'running' AND (id <> (SELECT max(id) FROM r WHERE status = 'running') OR epoch(TIMESTAMP '2024-02-01') - floor(epoch(started_at)) > 7200) THEN 'failed' ELSE status END AS status FROM r""")
def close_stale(spark, d):
    """Stale runs closed."""
    runs = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.when(F.col("value") > 50, "running").otherwise("ok").alias("status"))
    return dml.close_stale(runs, F.lit("2024-02-01").cast("timestamp")).select("id", "status")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST(floor((o_orderkey % 5) * 30.5) AS INTEGER) AS cutoff, CAST(greatest(1, least(3, ceil((o_orderkey % 120) / 30.5))) AS BIGINT) AS months,
try_cast(CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE) AS day, CAST(o_orderdate AS DATE) + 1 AS first_day FROM orders""")
def date_rules(spark, d):
    """F42, F44, F49."""
    day = F.col("o_orderdate").cast("date")
    said = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.concat(day.cast("string"), F.lit("T10:00:00Z")))
    return table(spark, d, "orders").select("o_orderkey", D.months_cutoff(day, F.col("o_orderkey") % 5).alias("cutoff"), D.whole_months(F.col("o_orderkey") % 120).cast("long").alias("months"), D.tolerant_date(said).alias("day"), D.first_covered_day(day).alias("first_day"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity * l_extendedprice + l_linenumber * l_extendedprice * 0.1::DOUBLE + l_suppkey * l_discount) / 1e6 / CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS cost,
CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS affordable, l_extendedprice + l_linenumber * CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity ELSE 1.0 END AS projected FROM lineitem""")
def call_costs(spark, d):
    """F65, F66, F67."""
    c = F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", N.call_cost(c("l_quantity"), c("l_suppkey"), c("l_linenumber"), c("l_extendedprice"), c("l_discount"), c("l_returnflag") == "R").alias("cost"),
        N.affordable(c("l_extendedprice"), c("l_quantity")).alias("affordable"), N.projected_spend(c("l_extendedprice"), c("l_quantity"), c("l_linenumber"), 1.0).alias("projected"),
    )


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS corp, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN CASE WHEN user_id % 3 = 0 THEN 'confirmed_org_wide' ELSE 'confirmed' END
 WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'vendor' WHEN user_id % 2 = 0 THEN 'handle' ELSE 'unknown' END AS tier FROM events GROUP BY user_id""")
def employment_tiers(spark, d):
    """Tiers from counted events."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("corp"), F.count_if(F.col("event_type") == "signup").alias("vendor"))
    return rows.select("user_id", "corp", A.employment(F.col("corp"), F.col("user_id") % 3 == 0, F.col("vendor"), F.col("user_id") % 2 == 0).alias("tier"))


@query("SELECT event_type AS tier, count(*) AS n FROM events GROUP BY 1")
def tier_counts(spark, d):
    """A2."""
    return A.tier_counts(table(spark, d, "events").select(F.col("event_type").alias("tier")))


@query("SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def prefix_filter(spark, d):
    """P10."""
    return S.prefixed(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "Brand#1")


@query("SELECT r_regionkey, r_name, coalesce((SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey), '') AS names FROM region")
def label_to_many(spark, d):
    """Regions with the names of their nations."""
    nations = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("name"))
    return J.many_by_label(table(spark, d, "region").select("r_regionkey", "r_name"), nations, "r_regionkey").withColumn("names", F.array_join("names", ","))


@query(_OLD_NEW + " SELECT id, 'missing' AS kind FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'invented' AS kind FROM n WHERE id NOT IN (SELECT id FROM o)")
def missing_and_invented(spark, d):
    """U5."""
    return J.missing_and_invented(*_old_new(spark, d), "id")


@query("""SELECT o_orderkey AS id, l_suppkey AS name, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey) AS INTEGER) AS position, CAST(count(*) OVER (PARTITION BY o_orderkey) AS INTEGER) AS n_authors FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def byline_position(spark, d):
    """Suppliers of an order as its byline."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    articles = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(lines.alias("authors"))
    return W.byline_positions(articles, "id", "authors")


@query("SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN c_name[1:12] || '…' ELSE c_name END AS title FROM customer")
def truncated_titles(spark, d):
    """F26."""
    return table(spark, d, "customer").select("c_custkey", X.shortened(F.col("c_name"), 12).alias("title"))
