"""Routes, joins, filters and set operations on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.maths import sign_product
from quillon.operators import aggregates as A
from quillon.operators import joins as J
from quillon.operators import topk as K
from quillon.plans.registry import query
from quillon.sources.tables import table

_HIGH_LOW = "CASE WHEN {0} >= {1} THEN 'high' WHEN {0} >= {2} THEN 'medium' ELSE 'low' END"
_QTY, _SIZE, _PRICE, _DISC = (_HIGH_LOW.format(*x) for x in (("l_quantity", 34, 17), ("p_size", 34, 17), ("p_retailprice", 967, 933), ("l_discount", 0.07, 0.03)))
_SIGN = "CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'mixed' END"
_EDGE_SIGN = "CASE WHEN p_type IN ('SMALL','PROMO') THEN 'negative' WHEN p_type = 'ECONOMY' THEN 'mixed' ELSE 'positive' END"
_MAG = "CASE {0} WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 ELSE 1.0 END"
_CONF = "CASE {0} WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.0 END"


def _tags(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("mechanism"), F.expr(_SIGN).alias("sign"), F.expr(_QTY).alias("magnitude"), F.expr(_DISC).alias("confidence"))


def _edges(spark, d):
    rows = table(spark, d, "part")
    return rows.select(F.col("p_brand").alias("isin"), F.col("p_partkey").alias("mechanism"), F.expr(_EDGE_SIGN).alias("sign"), F.expr(_SIZE).alias("magnitude"), F.expr(_PRICE).alias("confidence"))


_WEIGHT = lambda m, c: f"((CAST({_MAG.format(m)} AS DOUBLE)) * (CAST({_CONF.format(c)} AS DOUBLE)) / 3.0::DOUBLE)"
_PRODUCT = "CASE WHEN t.sign = 'mixed' OR e.sign = 'mixed' THEN 'mixed' WHEN t.sign = e.sign THEN 'positive' ELSE 'negative' END"
_MECH_SQL = f"""
WITH t AS (SELECT l_orderkey AS article, l_partkey AS mechanism, {_SIGN} AS sign, {_QTY} AS m, {_DISC} AS c FROM lineitem),
e AS (SELECT p_brand AS isin, p_partkey AS mechanism, {_EDGE_SIGN} AS sign, {_SIZE} AS m, {_PRICE} AS c FROM part),
mech AS (SELECT article, isin, 'mechanism' AS route, CAST(mechanism AS VARCHAR) AS via, {_PRODUCT} AS direction,
 round({_WEIGHT('t.m', 't.c')} * {_WEIGHT('e.m', 'e.c')} * 0.9::DOUBLE, 4) AS strength FROM t JOIN e USING (mechanism))"""


@query(_MECH_SQL + " SELECT * FROM mech WHERE strength > 0")
def route_equi_strength(spark, d):
    """J3, F60, F61, J1, F69."""
    return J.mechanism_route(_tags(spark, d), _edges(spark, d), 0.9).withColumn("via", F.col("via").cast("string"))


def _category_tags(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("article"), F.col("p_type").alias("category"), F.expr(_SIGN).alias("sign"), F.expr(_DISC).alias("confidence"))


def _membership(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("isin"), F.col("p_type").alias("category")).distinct()


def _routable(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.avg("p_size").alias("s"), F.count(F.lit(1)).alias("n")).where("category <> 'PROMO'")


_CAT_SQL = f"""
ct AS (SELECT l_orderkey AS article, p_type AS category, {_SIGN} AS sign, {_DISC} AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
mem AS (SELECT DISTINCT p_brand AS isin, p_type AS category FROM part),
cat AS (SELECT article, isin, 'category' AS route, category AS via, sign AS direction, round({_WEIGHT("'high'", 'c')} * 0.5::DOUBLE, 4) AS strength
 FROM ct JOIN mem USING (category) WHERE category <> 'PROMO')"""


@query("WITH" + _CAT_SQL + " SELECT via, direction, count(*) AS n, round(sum(strength), 4) AS total FROM cat WHERE strength > 0 GROUP BY ALL")
def route_category(spark, d):
    """J4."""
    rows = J.category_route(_category_tags(spark, d), _membership(spark, d), _routable(spark, d), 0.5)
    return rows.groupBy("via", "direction").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("strength"), 4).alias("total"))


@query(f"""
SELECT o_orderkey AS article, n_name AS isin, 'exposure' AS route, concat_ws(':', c_mktsegment, n_name) AS via, 'mixed' AS direction,
round({_WEIGHT("CASE WHEN n_regionkey >= 3 THEN 'high' WHEN n_regionkey >= 1 THEN 'medium' ELSE 'low' END", "CASE WHEN n_name < 'NATION_15' THEN 'high' WHEN n_name < 'NATION_20' THEN 'medium' ELSE 'low' END")} * 0.6::DOUBLE, 4) AS strength
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 200000 AND o_orderstatus <> 'P' AND n_name < 'NATION_20'""")
def route_gated(spark, d):
    """Exposure counts only for scored items and live edges. The laboratory is market segment and nation."""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    lab = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("|", "c_mktsegment", "n_name").alias("lab"))
    articles = orders.where("o_orderstatus <> 'P'").join(lab, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("article"), "lab", F.greatest(F.col("o_totalprice") - 200000, F.lit(0)).alias("score"))
    edges = customer.select("c_mktsegment").distinct().crossJoin(F.broadcast(nation)).select(
        F.col("n_name").alias("isin"), F.concat_ws("|", "c_mktsegment", "n_name").alias("lab"), F.col("n_name").alias("kind"), F.expr(_HIGH_LOW.format("n_regionkey", 3, 1)).alias("magnitude"),
        F.expr("CASE WHEN n_name < 'NATION_15' THEN 'high' WHEN n_name < 'NATION_20' THEN 'medium' ELSE 'low' END").alias("confidence"), F.lit(False).alias("is_dormant"),
    )
    return J.exposure_route(articles, edges, 0.6).withColumn("via", F.concat_ws(":", F.substring_index("via", "|", 1), "isin"))


@query(f"""{_MECH_SQL}, {_CAT_SQL},
u AS (SELECT *, 0 AS r FROM mech WHERE strength > 0 UNION ALL SELECT *, 1 AS r FROM cat WHERE strength > 0)
SELECT route, direction, count(*) AS n_rows, round(sum(strength), 3) AS total FROM (
 SELECT *, row_number() OVER (PARTITION BY article, isin, route, via ORDER BY strength DESC, r, direction) AS n FROM u) WHERE n = 1 GROUP BY ALL""")
def routes_best_per_key(spark, d):
    """The whole union, one row a key, summed up by route and direction."""
    mech = J.mechanism_route(_tags(spark, d), _edges(spark, d), 0.9).withColumn("via", F.col("via").cast("string"))
    # All holdings of a category share its tags: the best tag is chosen before the category meets its holdings.
    own = _membership(spark, d).select(F.col("category").alias("isin"), "category").distinct()
    keys = ["article", "isin", "route", "via"]
    best = J.union_best([J.category_route(_category_tags(spark, d), own, _routable(spark, d), 0.5)], keys)
    cat = best.drop("isin").join(_membership(spark, d).withColumnRenamed("category", "via"), "via")
    rows = J.union_best([mech], keys).unionByName(cat.select(*J.CONNECTION))
    return rows.groupBy("route", "direction").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("strength"), 3).alias("total"))


@query(f"""{_MECH_SQL}, {_CAT_SQL},
b AS (SELECT article, isin, route, via, direction, max(strength) AS strength FROM (SELECT * FROM mech WHERE strength > 0 UNION ALL SELECT * FROM cat WHERE strength > 0) GROUP BY ALL),
k AS (SELECT * FROM b WHERE route = 'mechanism' OR NOT EXISTS (SELECT 1 FROM b x WHERE x.route = 'mechanism' AND x.article = b.article AND x.isin = b.isin
 AND x.direction = CASE b.direction WHEN 'positive' THEN 'negative' WHEN 'negative' THEN 'positive' END))
SELECT route, direction, count(*) AS n_rows FROM k GROUP BY ALL""")
def contradiction_anti(spark, d):
    """J8."""
    mech = J.mechanism_route(_tags(spark, d), _edges(spark, d), 0.9).withColumn("via", F.col("via").cast("string"))
    # The strongest tag of each direction, before the category meets its holdings.
    own = _membership(spark, d).select(F.col("category").alias("isin"), "category").distinct()
    best = lambda rows: rows.groupBy("article", "isin", "route", "via", "direction").agg(F.max("strength").alias("strength"))
    cat = best(J.category_route(_category_tags(spark, d), own, _routable(spark, d), 0.5)).drop("isin").join(_membership(spark, d).withColumnRenamed("category", "via"), "via")
    rows = best(mech).unionByName(cat.select(*J.CONNECTION))
    return J.drop_contradicted(rows).groupBy("route", "direction").agg(F.count(F.lit(1)).alias("n_rows"))


_WORDS = ("license", "gnu", "apache", "idiot", "menteí", "für", "est", "clown", "public", "version", "scum", "trash")
_WORD_VALUES = ", ".join(f"({i}, '{w}')" for i, w in enumerate(_WORDS))


@query(f"""SELECT doc_id, arg_min(w, i) AS via FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS ts FROM documents), (VALUES {_WORD_VALUES}) t(i, w)
WHERE list_contains(ts, w) GROUP BY doc_id""")
def named_mention(spark, d):
    """The first of twelve names that a document has as a word."""
    holdings = spark.createDataFrame([(str(i), None, [w], None) for i, w in enumerate(_WORDS)], "isin string, name string, aliases array<string>, ticker string")
    hits = J.named_route(table(spark, d, "documents").select(F.col("doc_id").alias("article"), "text"), holdings)
    return hits.groupBy(F.col("article").alias("doc_id")).agg(F.min_by(F.substring_index("via", ":", -1), F.col("isin").cast("int")).alias("via"))


@query("SELECT o_orderkey AS key, o_orderpriority FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def pending_anti(spark, d):
    """J9, U6, J16, S13, O14."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return J.pending(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority"), done, "key")


@query("SELECT o_orderkey AS key, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def settled_semi(spark, d):
    """J10."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return J.settled(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority"), done, "key")


@query("""WITH c AS (SELECT event_id, md5(CASE WHEN event_type = 'signup' THEN 'old' ELSE event_type || props END) AS h FROM events WHERE event_type <> 'error')
SELECT e.event_id, e.event_type FROM events e LEFT JOIN c ON e.event_id = c.event_id AND md5(e.event_type || e.props) = c.h WHERE c.event_id IS NULL""")
def stale_cache_anti(spark, d):
    """Events that the cache lacks or holds under another hash."""
    rows = table(spark, d, "events").withColumn("h", F.md5(F.concat("event_type", "props")))
    cache = table(spark, d, "events").where("event_type <> 'error'").select("event_id", F.md5(F.when(F.col("event_type") == "signup", F.lit("old")).otherwise(F.concat("event_type", "props"))).alias("h"))
    return J.stale(rows, cache, "event_id", ["h"]).select("event_id", "event_type")


@query("""SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, CAST(abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) AS BIGINT) AS gap
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 14""")
def band_self_join(spark, d):
    """J12, G15."""
    return J.band_pairs(table(spark, d, "orders"), "o_orderkey", ["o_custkey"], "o_orderdate", 14)


_TOKENS = "unnest(regexp_extract_all(lower({0}), '[a-z]{{6,}}'))"


@query("""WITH w AS (SELECT p_partkey AS id, p_brand AS lab, p_type, p_partkey % 90 AS day, unnest(string_split(p_name, ' ')) || '-' || (p_size % 3) AS stem FROM part),
m AS (SELECT id, lab, p_type, day, unnest([stem, stem || '-' || lower(p_type)]) AS word FROM w), r AS (SELECT * FROM m WHERE p_type IN ('STANDARD', 'SMALL')), t AS (SELECT * FROM m WHERE p_type IN ('LARGE', 'ECONOMY', 'MEDIUM'))
SELECT r.id AS a, t.id AS b, arg_min(r.word, (-length(r.word), r.word)) AS evidence FROM r JOIN t USING (lab, word) WHERE abs(r.day - t.day) <= 7 GROUP BY ALL""")
def set_overlap_links(spark, d):
    """Parts as releases and announcements of a brand's models, within seven days (a stand-in date)."""
    models = F.transform(F.split("p_name", " "), lambda w: F.concat_ws("-", w, (F.col("p_size") % 3).cast("string"), F.lower("p_type")))
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("lab"), F.col("p_type").alias("event_type"), F.when(F.col("p_type").isin("STANDARD", "SMALL"), F.col("p_name")).alias("repo"),
        models.alias("models"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 90).cast("int")).alias("day"),
    )
    return J.release_links(rows, ["LARGE", "ECONOMY", "MEDIUM"], 7)


@query("""SELECT c.event_id, c.user_id, p.event_id AS purchase_id, p.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def asof_join(spark, d):
    """J21."""
    events = table(spark, d, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    return J.as_of(clicks, buys, ["user_id"], "ts", "bought", ["purchase_id", "purchase_value"], "purchase_id").select("event_id", "user_id", "purchase_id", "purchase_value")


@query("""WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders), p AS (SELECT DISTINCT o_orderpriority FROM orders),
f AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY ALL)
SELECT month, o_orderpriority, coalesce(n, 0) AS n FROM m CROSS JOIN p LEFT JOIN f USING (month, o_orderpriority)""")
def dense_calendar(spark, d):
    """J22."""
    orders = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    facts = orders.where("o_totalprice > 300000").groupBy("month", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return J.dense(orders.select("month").distinct(), orders.select("o_orderpriority").distinct(), facts, ["month", "o_orderpriority"], ["n"])


_YEAR = "SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS {1} FROM lineitem WHERE year(l_shipdate) = {0} GROUP BY 1"


def _diff(spark, d):
    rows = table(spark, d, "lineitem")
    year = lambda y: rows.where(F.year("l_shipdate") == y).groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return J.full_diff(year(1996), year(1997), "l_partkey", "q")


_DIFF_SQL = f"""WITH a AS ({_YEAR.format(1996, 'old')}), b AS ({_YEAR.format(1997, 'new')}),
f AS (SELECT l_partkey, old, new, CASE WHEN old IS NULL THEN 'entered' WHEN new IS NULL THEN 'left' WHEN old <> new THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b USING (l_partkey))"""


@query(_DIFF_SQL + " SELECT * FROM f")
def full_outer_diff(spark, d):
    """J19, E19, U2, K1, E14."""
    return _diff(spark, d)


@query(_DIFF_SQL + """ SELECT count(*) FILTER (state = 'entered') AS entered, count(*) FILTER (state = 'left') AS "left", count(*) FILTER (state = 'changed') AS changed,
round(100.0 * (count(*) FILTER (state IN ('entered', 'left'))) / greatest(1, count(old)), 4) AS turnover_pct FROM f""")
def turnover(spark, d):
    """A35."""
    return J.turnover(_diff(spark, d))


@query("SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey = n_nationkey")
def left_default_label(spark, d):
    """J15."""
    nation = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.with_label(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "n_name", "label").select("c_custkey", "label")


@query("""SELECT c_name, k AS key, CASE WHEN k IS NULL THEN 'none' WHEN o_custkey IS NULL THEN 'unmatched' ELSE 'held' END AS state
FROM (SELECT c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) END AS k FROM customer)
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) ON k = o_custkey""")
def derived_key_join(spark, d):
    """J17, F24."""
    buyers = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("owner")).distinct()
    customers = table(spark, d, "customer").select("c_name", "c_mktsegment")
    key = F.when(F.col("c_mktsegment") != "BUILDING", F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("long"))
    return J.on_derived_key(customers.withColumn("key", key), buyers, key, "owner", ("none", "unmatched", "held")).select("c_name", "key", "state")


@query("""WITH w AS (SELECT DISTINCT lower(p_brand) AS w FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 1)) FROM part UNION SELECT unnest(['license', 'idiot', 'zzzz']))
SELECT w FROM w WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), w))""")
def substring_anti(spark, d):
    """J26, U2."""
    part = table(spark, d, "part")
    words = part.select(F.lower("p_brand").alias("w")).union(part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))).union(spark.createDataFrame([("license",), ("idiot",), ("zzzz",)], "w string")).distinct()
    return J.not_contained(words, table(spark, d, "documents"), "w", "text")


@query("""SELECT o_orderkey, len(list(l_partkey)) AS n_lines, list_sum(list(l_partkey)) AS keys FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
UNION ALL SELECT o_orderkey, 0, 0 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def nested_items(spark, d):
    """Orders with their lines nested; flattened again for the comparison."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    rows = J.nested(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), lines, "o_orderkey", [*order, "l_quantity"], "lines", order)
    keys = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["l_partkey"])
    return rows.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), keys.alias("keys"))


@query("""WITH l AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
SELECT a, count(*) AS n FROM s WHERE a IN (SELECT p_partkey FROM part WHERE p_size > 10) AND b IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY a""")
def links_both_ways(spark, d):
    """Links from either end, both ends in the rendered set."""
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit("with").alias("relation")).distinct()
    ids = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"))
    return J.both_ways(links, ids).groupBy("a").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_partkey AS key, arg_min(p, (length(p), o)) AS name, count(*) AS n_rows, round(sum(q), 2) AS q FROM
(SELECT l_partkey, o_orderpriority AS p, l_orderkey * 1000000000 + l_suppkey * 1000 + l_linenumber AS o, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def merged_shortest_name(spark, d):
    """J27, A26."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_partkey").alias("key"), F.col("o_orderpriority").alias("name"), (F.col("l_orderkey") * 1000000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("q"))
    return J.merged_by_key(rows, "key", "name", "seq", ["q"]).withColumn("q", F.round("q", 2))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderpriority = '1-URGENT' THEN 2.0 END AS score,
CASE WHEN o_orderstatus = 'F' THEN 'fresh' WHEN o_orderpriority = '1-URGENT' THEN 'rescored' ELSE 'blocked' END AS provenance FROM orders""")
def version_overlay(spark, d):
    """J31, J18."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    keys = orders.select("o_orderkey")
    fresh = orders.where("o_orderstatus = 'F'").withColumn("score", F.lit(1.0))
    old = orders.where("o_orderpriority = '1-URGENT'").withColumn("score", F.lit(2.0))
    return J.overlay(keys, [("fresh", fresh), ("rescored", old)], "o_orderkey", "score")


@query("SELECT count(*) FILTER (WHERE s = 'positive') AS positive, count(*) FILTER (WHERE s = 'negative') AS negative, count(*) FILTER (WHERE s = 'mixed') AS mixed FROM (SELECT " + _PRODUCT.replace("t.sign", "(" + _SIGN + ")").replace("e.sign", "(" + _EDGE_SIGN + ")") + " AS s FROM lineitem JOIN part ON l_partkey = p_partkey)")
def sign_products(spark, d):
    """F60."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(sign_product(F.expr(_SIGN), F.expr(_EDGE_SIGN)).alias("s"))
    return rows.agg(*[F.count_if(F.col("s") == v).alias(v) for v in ("positive", "negative", "mixed")])


_BANDED = "SELECT o_orderkey, o_orderdate, o_orderpriority, CASE WHEN o_totalprice >= 375000 THEN 'critical' WHEN o_totalprice >= 250000 THEN 'high' WHEN o_totalprice >= 125000 THEN 'medium' ELSE 'low' END AS band FROM orders"


@query(f"SELECT o_orderkey, band FROM ({_BANDED}) WHERE band IN ('high', 'critical') AND o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def band_floor_window(spark, d):
    """Bands at or over a floor, in a half-open window, without muted kinds."""
    bands = (("critical", 375000.0), ("high", 250000.0), ("medium", 125000.0), ("low", -1e18))
    rows = table(spark, d, "orders").where(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    rows = rows.where((F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") <= F.lit("1997-06-30").cast("timestamp_ntz")))
    return rows.withColumn("band", A.band_of(F.col("o_totalprice"), bands)).where(A.at_least(F.col("band"), F.lit("high"), bands)).select("o_orderkey", "band")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 25 AS sent FROM orders")
def capped_status(spark, d):
    """O8."""
    rows = K.delivered(table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, ["o_orderpriority"])
    return rows.select("o_orderkey", (F.col("status") == "delivered").alias("sent"))
