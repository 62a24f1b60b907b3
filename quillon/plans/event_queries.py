"""Periods, sessions, state, evaluation, alerts and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import alerts as L
from quillon.operators import evaluation as E
from quillon.operators import incremental as I
from quillon.operators import quality as V
from quillon.operators import readmodels as R
from quillon.operators import windows as W
from quillon.plans.registry import query
from quillon.sources.tables import table

_DAY = "CAST(ts AS DATE)"
_END = "DATE '1970-01-01' + CAST(ceil(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 2.0) * 2 AS INTEGER)"


@query(f"SELECT CAST({_END} AS VARCHAR) AS period_end, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    """Two-day periods on the epoch grid, (start, end]."""
    rows = I.by_period(table(spark, d, "events"), "ts", 2)
    out = rows.groupBy("period_end", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 2).alias("total"))
    return out.withColumn("period_end", F.col("period_end").cast("string"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-10' AND CAST(ts AS DATE) <= DATE '2024-01-12'")
def half_open(spark, d):
    """P4, F41, I2."""
    day = F.col("ts").cast("date")
    return table(spark, d, "events").where((day > F.lit("2024-01-10").cast("date")) & (day <= F.lit("2024-01-12").cast("date"))).select("event_id")


@query("""WITH p AS (SELECT DISTINCT CAST(ts AS DATE) AS period_end FROM events WHERE event_type = 'signup' AND value > 80), f AS (SELECT max(period_end) AS hi FROM p),
g AS (SELECT CAST(unnest(generate_series(hi + 1, DATE '2024-02-20' - 2, INTERVAL 1 DAY)) AS DATE) AS period_end FROM f) SELECT CAST(period_end AS VARCHAR) AS period_end, CAST(period_end + 1 AS VARCHAR) AS publish_at FROM g WHERE period_end NOT IN (SELECT period_end FROM p) ORDER BY period_end DESC LIMIT 7""")
def backfill(spark, d):
    """Days after the newest edition, the latest seven."""
    published = table(spark, d, "events").where("event_type = 'signup' and value > 80").select(F.col("ts").cast("date").alias("period_end")).distinct()
    return I.missing_periods(published, F.lit("2024-02-20").cast("date"), 1).select(F.col("period_end").cast("string").alias("period_end"), F.col("publish_at").cast("string").alias("publish_at"))


@query("""WITH o AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events)
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM o""")
def gap_sessions(spark, d):
    """W7 and I6 without a cap."""
    return W.gap_sessions(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 6 * 3600).select("event_id", "session")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
r AS (SELECT user_id, n, t, t AS first, 1 AS train FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.n, o.t, CASE WHEN o.t - r.t <= 172800 AND o.t - r.first <= 604800 THEN r.first ELSE o.t END, r.train + CASE WHEN o.t - r.t <= 172800 AND o.t - r.first <= 604800 THEN 0 ELSE 1 END
FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, max(train) AS trains, count(*) AS n FROM r GROUP BY 1""")
def session_cap(spark, d):
    """Gaps of two days and a span of a week."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    out = W.capped_sessions(rows, ["user_id"], F.floor(seconds), "event_id", 172_800, 604_800)
    return out.groupBy("user_id").agg(F.countDistinct("train").cast("int").alias("trains"), F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) - 1 AS repeats FROM events GROUP BY ALL""")
def alert_dedupe(spark, d):
    """I7."""
    return I.episodes(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "repeats")


@query("""WITH c AS (SELECT DISTINCT event_type || ':' || user_id AS k FROM events WHERE event_type IN ('error', 'purchase')), s AS (SELECT DISTINCT event_type || ':' || user_id AS k, event_type = 'error' AS ack FROM events WHERE event_type IN ('error', 'purchase') AND value > 70)
SELECT k AS dedupe_key, CASE WHEN s.k IS NULL THEN 'new' WHEN ack THEN 'reopen' ELSE 'known' END AS action FROM c LEFT JOIN s USING (k)""")
def alert_reopen(spark, d):
    """Acknowledged episodes that come again are opened again."""
    rows = table(spark, d, "events").where("event_type in ('error', 'purchase')").withColumn("dedupe_key", F.concat_ws(":", "event_type", "user_id"))
    stored = rows.where("value > 70").select("dedupe_key", F.when(F.col("event_type") == "error", F.lit("2024-02-01").cast("timestamp")).alias("acknowledged_at")).distinct()
    return I.dispatch(rows.select("dedupe_key"), stored)


@query("""WITH l AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1)
SELECT l.user_id, count(e.event_id) AS consecutive_failures FROM l LEFT JOIN events e ON e.user_id = l.user_id AND e.event_type = 'error' AND (l.ok IS NULL OR e.ts > l.ok) GROUP BY 1""")
def failure_streak(spark, d):
    """I8, R2."""
    rows = table(spark, d, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return I.failure_streaks(rows, "user_id", "ts", "ok").select("user_id", "consecutive_failures")


@query("""WITH c AS (SELECT user_id, max(ts) AS cursor FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.event_id FROM events e LEFT JOIN c USING (user_id) WHERE cursor IS NULL OR ts > cursor""")
def cursor_since(spark, d):
    """I5, I10, S21."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    cursors = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("cursor"))
    return I.since_cursor(events, cursors, "user_id", "ts").select("event_id")


@query("""WITH b AS (SELECT user_id, bool_and(event_type <> 'error') AS ok, max(ts) AS new FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1), s AS (SELECT user_id, max(ts) AS watermark FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT user_id, CASE WHEN ok THEN greatest(watermark, new) ELSE watermark END AS watermark FROM s FULL JOIN b USING (user_id)""")
def watermark_advance(spark, d):
    """I4: only full success moves a mark."""
    events = table(spark, d, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    at = F.lit("2024-01-20").cast("timestamp_ntz")
    state = events.where(F.col("ts") < at).groupBy("user_id").agg(F.max("ts").alias("watermark"))
    return I.advanced_watermarks(state, events.where(F.col("ts") >= at), "user_id", "ts")


_LABELLED = "SELECT lang, quality, toxic, doc_id FROM labels JOIN documents USING (doc_id)"


def _labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("""WITH s AS (SELECT CAST(quality = 0 AS INT) AS r1, CAST(toxic = 1 AS INT) AS r2, CAST(n_chars < 500 AS INT) AS g1, CAST(contains(lower(text), 'idiot') AS INT) AS g2 FROM labels JOIN documents USING (doc_id)),
h AS (SELECT r1 * g1 + r2 * g2 AS hit, r1 + r2 AS nr, g1 + g2 AS ng FROM s),
x AS (SELECT CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(ng - hit) AS BIGINT) AS fp, CAST(sum(nr - hit) AS BIGINT) AS fn, count(*) FILTER (hit = nr AND hit = ng) AS identical,
 avg(CASE WHEN nr = 0 AND ng = 0 THEN 1.0::DOUBLE WHEN hit = 0 THEN 0 ELSE 2 * (hit / ng) * (hit / nr) / ((hit / ng) + (hit / nr)) END) AS m FROM h)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1, round(m, 6) AS macro_f1, identical FROM x""")
def f1_micro(spark, d):
    """A document's set of labels against the set that plain rules give it."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    told = F.array_compact(F.array(F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, "toxic")))
    guess = F.array_compact(F.array(F.when(F.col("n_chars") < 500, "low"), F.when(F.contains(F.lower("text"), F.lit("idiot")), "toxic")))
    out = E.axis(rows.select(told.alias("r"), guess.alias("g")), "r", "g")
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], "precision", "recall", "f1", "macro_f1", "identical")


@query(f"""WITH t AS (SELECT lang, 1 - quality AS a, toxic AS b FROM ({_LABELLED})), s AS (SELECT lang, count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS o, (sum(a) / count(*)) * (sum(b) / count(*)) + (1 - sum(a) / count(*)) * (1 - sum(b) / count(*)) AS e FROM t GROUP BY 1)
SELECT lang, n, round(o, 6) AS observed, round(CASE WHEN e = 1 THEN 1 ELSE (o - e) / (1 - e) END, 6) AS kappa FROM s""")
def kappa(spark, d):
    """E3."""
    rows = _labelled(spark, d).select("lang", (1 - F.col("quality")).alias("a"), F.col("toxic").alias("b"))
    return E.kappa(rows, "a", "b", ["lang"])


@query(f"SELECT lang, round(avg(abs(quality - toxic)), 6) AS mae, round(sqrt(avg((quality - toxic) * (quality - toxic))), 6) AS rmse, count(*) FILTER (quality = toxic) AS identical, count(*) FILTER (sign(quality) = sign(toxic)) AS same_sign FROM ({_LABELLED}) GROUP BY 1")
def mae(spark, d):
    """E5."""
    return E.errors(_labelled(spark, d), "quality", "toxic", ["lang"])


_PER_CUSTOMER = "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1"


def _per_customer(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"SELECT round(corr(n, total), 6) AS pearson FROM ({_PER_CUSTOMER})")
def pearson(spark, d):
    """E4."""
    return E.pearson(_per_customer(spark, d), "n", "total")


@query(f"""WITH r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0::DOUBLE AS b FROM ({_PER_CUSTOMER}))
SELECT round(corr(a, b), 6) AS spearman FROM r""")
def spearman(spark, d):
    """E4, W19."""
    return E.spearman(_per_customer(spark, d), "n", "total")


@query("""WITH r AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS runs FROM events GROUP BY 1), v AS (SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS votes FROM events GROUP BY ALL)
SELECT user_id, event_type, votes, runs FROM v JOIN r USING (user_id) WHERE votes >= runs // 2 + 1""")
def majority_vote(spark, d):
    """Days vote for event types."""
    rows = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return E.majority(rows, "user_id", "day", "event_type").select("user_id", "event_type", "votes", "runs")


@query("SELECT user_id, CAST(quantile_disc(round(value), 0.5) AS DOUBLE) AS median FROM events GROUP BY 1")
def lower_median(spark, d):
    """E8."""
    return E.lower_median(table(spark, d, "events").withColumn("v", F.round("value")), ["user_id"], "v")


@query("SELECT user_id, count(*) AS n, count(DISTINCT value) AS distinct, round(max(value) - min(value), 4) AS range, round(stddev_samp(value), 4) AS stdev FROM events GROUP BY 1")
def variance_record(spark, d):
    """E9."""
    return E.variance(table(spark, d, "events"), ["user_id"], "value")


@query(f"""WITH x AS (SELECT lang, quality = 0 AS t, toxic = 1 AS r FROM ({_LABELLED})), c AS (SELECT lang, count(*) FILTER (t AND r) AS tp, count(*) FILTER (NOT t AND r) AS fp, count(*) FILTER (t AND NOT r) AS fn, count(*) FILTER (NOT t AND NOT r) AS tn FROM x GROUP BY 1)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS agreement, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c""")
def confusion(spark, d):
    """E10, E11."""
    rows = _labelled(spark, d).select("lang", (F.col("quality") == 0).alias("t"), (F.col("toxic") == 1).alias("r"))
    return E.confusion(rows, "t", "r", ["lang"])


@query("""WITH a AS (SELECT conv_id AS k, md5(string_agg(text, '|' ORDER BY turn)) AS h FROM conversations WHERE role = 'user' GROUP BY 1), b AS (SELECT conv_id AS k, md5(string_agg(text, '|' ORDER BY turn)) AS h FROM conversations WHERE role <> 'system' GROUP BY 1)
SELECT k, CASE WHEN a.h IS NULL THEN 'entered' WHEN b.h IS NULL THEN 'left' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b USING (k)""")
def manifest_diff(spark, d):
    """Hashes of conversations before and after answers were added."""
    from quillon.operators.joins import full_diff

    rows = table(spark, d, "conversations")
    h = lambda r: r.groupBy(F.col("conv_id").alias("k")).agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "|")).alias("h"))
    return full_diff(h(rows.where("role = 'user'")), h(rows.where("role <> 'system'")), "k", "h").select("k", "state")


@query("""SELECT 'lineitem_key' AS "check", count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
SELECT 'price_range', count(*) FROM part WHERE p_retailprice NOT BETWEEN 905 AND 1500 UNION ALL
SELECT 'order_customer', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL
SELECT 'priority', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') UNION ALL
SELECT 'discount_under_tax', count(*) FROM lineitem WHERE NOT l_discount >= l_tax UNION ALL
SELECT 'part_sold', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def dq_violations(spark, d):
    """Violations per check; checks without any show as none, so rows are counted over a fixed list."""
    t = lambda n: table(spark, d, n)
    found = V.violations([
        V.unique(t("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem_key"), V.in_range(t("part"), "p_partkey", "p_retailprice", 905, 1500, "price_range"),
        V.refers(t("orders"), "o_custkey", t("customer"), "c_custkey", "order_customer"), V.member(t("orders"), "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "priority"),
        V.holds(t("lineitem"), "l_orderkey", F.col("l_discount") >= F.col("l_tax"), "discount_under_tax", "discount is under tax"),
        V.complete(t("part"), t("lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "part_sold"),
        V.required(t("customer"), "c_custkey", ["c_name", "c_mktsegment"], "customer_fields"), V.exactly_one(t("region"), "r_regionkey", ["r_name"], "region_name"),
    ])
    names = spark.createDataFrame([(n,) for n in ("lineitem_key", "price_range", "order_customer", "priority", "discount_under_tax", "part_sold")], "check string")
    return names.join(found.groupBy("check").agg(F.count(F.lit(1)).alias("n")), "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH l AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1), f AS (SELECT l.user_id, l.ok, count(e.event_id) AS n FROM l LEFT JOIN events e ON e.user_id = l.user_id AND e.event_type = 'error' AND (l.ok IS NULL OR e.ts > l.ok) GROUP BY ALL)
SELECT 'source_down' AS rule, count(*) AS n FROM f WHERE n >= 2 UNION ALL SELECT 'high_band_item', count(*) FROM orders WHERE o_totalprice >= 375000 AND o_orderdate >= TIMESTAMP '2001-01-01' HAVING count(*) > 0
UNION ALL SELECT 'budget_exceeded', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(CAST(o_totalprice AS DECIMAL(18,2))) > 4000000) HAVING count(*) > 0""")
def alert_rules(spark, d):
    """Candidates of several rules, counted."""
    events = table(spark, d, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    states = I.failure_streaks(events, "user_id", "ts", "ok").select(F.col("user_id").cast("string").alias("source_id"), F.col("last_success").alias("last_success_at"), "consecutive_failures", F.lit(False).alias("disabled"))
    orders = table(spark, d, "orders")
    items = orders.select(F.col("o_orderkey").cast("string").alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("published_on"), F.when(F.col("o_totalprice") >= 375000, "critical").otherwise("low").alias("band"))
    spend = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent")).select(F.lit("customer").alias("scope"), F.col("o_custkey").alias("scope_key"), "spent", F.lit(4000000).alias("ceiling"))
    rules = [L.source_down(states, 2), L.high_band(items, "critical", F.lit("2001-01-01").cast("timestamp_ntz")), L.budget_exceeded(spend)]
    return L.evaluate(rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT *, o_totalprice > 250000 AS ok FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-03-01'), g AS (SELECT o_custkey, count(*) AS n, bool_or(ok) AS ok FROM x GROUP BY 1)
SELECT count(*) AS considered, count(*) FILTER (ok) AS matched_rule, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS collapsed, least(count(*) FILTER (ok), 20) AS surfaced, count(*) - least(count(*) FILTER (ok), 20) AS suppressed FROM g""")
def digest_stats(spark, d):
    """A window's digest; groups are customers."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("article"), "o_custkey", F.col("o_orderdate").alias("published_on"), F.col("o_totalprice").alias("rank_value"), F.col("o_totalprice").alias("rank_min"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    stats = R.digest(rows, "o_custkey", F.col("rank_value") > 250000, at("1998-01-01"), at("1998-03-01"), 20)[1]
    return stats.select(*[F.col(c).cast("long").alias(c) for c in ("considered", "matched_rule", "collapsed", "surfaced", "suppressed")])


@query("SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def health(spark, d):
    """A32, Q4."""
    return R.health({n: table(spark, d, n) for n in ("lineitem", "orders", "events")})
