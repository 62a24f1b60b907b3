"""Text functions, duplicates, graphs and search over documents, pages, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import graph as G
from quillon.operators import readmodels as R
from quillon.operators import topk as K
from quillon.operators import windows as W
from quillon.operators.scalar_filters import mapped, post_verdict
from quillon.plans.registry import query
from quillon.sources.tables import table


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents")
def normalise_title(spark, d):
    """F1."""
    return table(spark, d, "documents").select("doc_id", X.normalised_title(F.col("text")).alias("title"))


@query("""WITH t AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents), g AS (SELECT lang, t, min(doc_id) AS root FROM t GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id AS node, root FROM t JOIN g USING (lang, t)""")
def exact_dup(spark, d):
    """F1, G1."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text").withColumn("day", F.lit(0))
    return G.exact_groups(docs, "lang", "day", "text", "doc_id")


_VISIBLE = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>|<svg.*?</svg>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, length(trim(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g'))) AS n FROM pages")
def html_strip(spark, d):
    """F7 before entities."""
    text = F.trim(F.regexp_replace(X.strip_tags(F.col("html")), r"\s+", " "))
    return table(spark, d, "pages").select("page_id", F.length(text).cast("long").alias("n"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def title(spark, d):
    """F9."""
    return table(spark, d, "pages").select("page_id", X.title_tag(F.col("html")).alias("title"))


@query()
def html_text(spark, d):
    """F7 with the whole entity table, F32."""
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query()
def abstract(spark, d):
    """The first long enough of block quote, headed section and opening, and which it was."""
    return table(spark, d, "pages").select("page_id", X.abstract(F.col("html")).alias("a")).select("page_id", "a.text", "a.strategy")


@query("SELECT page_id, lower(regexp_replace(regexp_replace(split_part(url, '?', 1), '^https?://(www\\.)?', ''), '^/+|/+$', '', 'g')) AS key FROM pages")
def url_canonical(spark, d):
    """F13."""
    return table(spark, d, "pages").select("page_id", X.archive_key(F.col("url")).alias("key"))


@query("""SELECT DISTINCT array_to_string(string_split(lower(regexp_replace(regexp_replace(split_part(url, '?', 1), '^https?://(www\\.)?', ''), '^/+|/+$', '', 'g')), '/')[1:2], '/') || '*' AS prefix FROM pages""")
def url_prefixes(spark, d):
    """F14."""
    return table(spark, d, "pages").select(X.archive_prefix(F.col("url")).alias("prefix")).distinct()


_CORE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '@[A-Za-z0-9_]{1,15}', '', 'g'), '#', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, CASE WHEN length({_CORE}) < 60 THEN 'under 60 characters of substance (' || length({_CORE}) || ')' END AS dropped FROM conversations")
def substance_filter(spark, d):
    """P13, F27, J14."""
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", post_verdict(F.col("text"), F.array().cast("array<string>"), 60).alias("dropped"))


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)) AS a FROM documents),
b AS (SELECT list_distinct(flatten(list(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)))) AS b FROM benchmark)
SELECT doc_id, round(coalesce(len(list_filter(a, lambda x: list_contains(b, x) AND NOT list_contains(['a','an','the','of','for','to','in','on','and','or','with','is','are','be','this','that','from','as','by','we','present','system','via','using','based','into','at','its','their'], x))) / nullif(len(list_filter(a, lambda x: NOT list_contains(['a','an','the','of','for','to','in','on','and','or','with','is','are','be','this','that','from','as','by','we','present','system','via','using','based','into','at','its','their'], x))), 0), 0), 6) AS overlap FROM w, b""")
def token_overlap(spark, d):
    """The share of a document's content words that the benchmark's vocabulary has, by a semi join on words
    instead of a list of the whole vocabulary."""
    docs = table(spark, d, "documents").select("doc_id", F.explode_outer(X.content_words(F.col("text"))).alias("w"))
    vocabulary = table(spark, d, "benchmark").select(F.explode(X.content_words(F.col("text"))).alias("v")).distinct()
    marked = docs.join(vocabulary, F.col("w") == F.col("v"), "left")
    return marked.groupBy("doc_id").agg(F.round(F.coalesce(F.try_divide(F.count("v"), F.count("w")), F.lit(0.0)), 6).alias("overlap"))


@query("""WITH m AS (SELECT doc_id, source, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+[0-9]+'))) AS id FROM documents)
SELECT id, min(doc_id) AS first_doc, count(*) AS mentions, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM m GROUP BY 1""")
def earliest_mention(spark, d):
    """Identifiers are words that end in digits."""
    ids = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+[0-9]+)"), F.lit(1)))
    rows = table(spark, d, "documents").select("doc_id", "lang", F.explode(ids).alias("id"), F.lit("").alias("url"))
    return W.first_mentions(rows, "id", "doc_id", "url", "lang").select("id", F.col("first_seen").alias("first_doc"), "mentions", F.array_join("corpora", ",").alias("langs"))


@query()
def model_identifiers(spark, d):
    """Identifiers of a list of families in all texts, their stems and surroundings."""
    pattern = X.model_pattern(["version", "gpl", "license"], 3)
    rows = table(spark, d, "documents").select("doc_id", "text", F.explode(X.identifiers(F.col("text"), pattern)).alias("m"))
    return rows.select("doc_id", F.col("m.id").alias("id"), X.stem(F.col("m.id")).alias("stem"), X.quote_for(F.col("m.raw"), F.col("text")).alias("quote"))


@query("""SELECT 'document' AS doc_type, CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), length(text) FROM benchmark
UNION ALL SELECT CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'answer' ELSE 'announcement' END, conv_id || '/' || turn, length(text) FROM conversations""")
def corpus_union(spark, d):
    """U8, P17, P23."""
    docs = table(spark, d, "documents").select(F.lit("document").alias("doc_type"), F.col("doc_id").cast("string").alias("id"), F.length("text").cast("long").alias("n"))
    items = table(spark, d, "benchmark").select(F.lit("item").alias("doc_type"), F.col("item_id").cast("string").alias("id"), F.length("text").cast("long").alias("n"))
    kind = mapped({"user": "question", "assistant": "answer"}, F.col("role"), "announcement")
    talks = table(spark, d, "conversations").select(kind.alias("doc_type"), F.concat_ws("/", "conv_id", "turn").alias("id"), F.length("text").cast("long").alias("n"))
    return docs.unionByName(items).unionByName(talks)


def _gated(spark, d):
    """Pairs of vectors of one label, one kind (a stand-in) and at most 14 days (a stand-in date) apart."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 60).cast("int"))
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding", (F.col("vec_id") % 7 % 2).alias("kind"), day.alias("day"))
    return G.gated_pairs(rows, "vec_id", "label", "day", "kind", "embedding", 14, 0.5, 0.4)


_COSINE = """SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine FROM embeddings a JOIN embeddings b
 ON a.label = b.label AND a.vec_id % 7 % 2 = b.vec_id % 7 % 2 AND abs(a.vec_id % 60 - b.vec_id % 60) <= 14 AND a.vec_id < b.vec_id"""


@query(f"SELECT a, b, round(cosine, 4) + 0 AS cosine, CASE WHEN cosine >= 0.5 THEN 'merge' WHEN cosine >= 0.4 THEN 'defer' ELSE 'apart' END AS gate FROM ({_COSINE})")
def cosine_gate(spark, d):
    """Vectors are scaled once, before the join on label, kind and bucket of days."""
    return _gated(spark, d).select("a", "b", (F.round("cosine", 4) + F.lit(0.0)).alias("cosine"), "gate")


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_COSINE}) WHERE cosine >= 0.4), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.reach = s.a), g AS (SELECT node, min(reach) AS group_id FROM r GROUP BY 1),
w AS (SELECT v.vec_id, coalesce(g.group_id, v.vec_id) AS group_id FROM embeddings v LEFT JOIN g ON v.vec_id = g.node) SELECT vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS size FROM w""")
def components(spark, d):
    """Groups of the vectors that the gate merges or defers."""
    edges = _gated(spark, d).where("gate <> 'apart'").select("a", "b", F.lit("gated").alias("method"))
    return G.groups_with_evidence(table(spark, d, "embeddings").select("vec_id"), "vec_id", edges).select("vec_id", "group_id", "size")


@query()
def alias_fixpoint(spark, d):
    """Every customer to the least customer of the chain that starts at a common part's first buyer."""
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    first = rows.groupBy("l_partkey").agg(F.min("o_custkey").alias("target"))
    links = rows.join(first, "l_partkey").groupBy(F.col("o_custkey").alias("alias")).agg(F.min("target").alias("target")).where("target < alias")
    return G.collapse_chains(links)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS s FROM lineitem)
SELECT a.s AS a, b.s AS b, count(*) AS common FROM m a JOIN m b ON a.g = b.g AND a.s < b.s GROUP BY ALL HAVING count(*) >= 2""")
def coauthor(spark, d):
    """Suppliers that meet in two orders or more."""
    return G.co_occurrence(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey", 2)


@query("""WITH s AS (SELECT quality = 0 AS bad, n_chars / 1000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)), g AS (SELECT unnest([0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (bad AND score >= threshold) AS tp, count(*) FILTER (NOT bad AND score >= threshold) AS fp, count(*) FILTER (bad AND score < threshold) AS fn FROM g, s GROUP BY 1)
SELECT threshold, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""")
def threshold_curve(spark, d):
    """G14, E10."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 0).alias("bad"), (F.col("n_chars") / 1000.0).alias("score"))
    curve = G.threshold_curve(rows, "score", "bad", [0.5, 1.0, 2.0, 4.0, 8.0])
    return curve.select("threshold", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') ORDER BY doc_id LIMIT 500")
def search_substring(spark, d):
    """A search whose result is a capped list."""
    return R.search(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", ["text", "source"], "License", 500).select("doc_id", "source")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5('s1' || doc_id), doc_id) AS n FROM documents) WHERE n <= 3""")
def stratified_sample(spark, d):
    """E12."""
    return K.hash_sample(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 3, "s1").select("doc_id")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS turn FROM documents),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY turn, source, doc_id) AS nth FROM t) SELECT doc_id FROM n WHERE nth <= 30""")
def spread_sample(spark, d):
    """Round-robin over sources, the longest first."""
    return K.spread_sample(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id", "lang", "source", "n_chars", 30).select("doc_id")


@query()
def verbatim_quotes(spark, d):
    """each conversation turn's first sentence snapped to the turn's own wording."""
    first = F.regexp_extract("text", r"^([^.!?\n]{12,}[.!?])", 1)
    rows = table(spark, d, "conversations").withColumn("quote", first).where("quote <> ''")
    return rows.select("conv_id", "turn", X.snap_quote(F.upper("quote"), F.col("text")).alias("snapped"))


@query("SELECT c_custkey, CASE WHEN length(n) >= 4 THEN n END AS name FROM (SELECT c_custkey, 'Customer ' || c_mktsegment AS n FROM customer)")
def legal_suffixes(spark, d):
    """trailing legal tokens go, in any spelling."""
    name = F.concat(F.lit("Customer "), F.col("c_mktsegment"), F.lit(" Holdings, S.A. (Inc.)"))
    return table(spark, d, "customer").select("c_custkey", X.match_name(name).alias("name"))
