"""Golden examples of the text, number and date functions."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import dates as D
from quillon.functions import maths as M
from quillon.functions import text as X


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize("a, b, c", [("positive", "positive", "positive"), ("positive", "negative", "negative"), ("negative", "negative", "positive"), ("mixed", "negative", "mixed"), ("positive", "mixed", "mixed")])
def test_sign_product(spark, a, b, c):
    assert one(spark, M.sign_product(F.col("a"), F.col("b")), a=a, b=b) == c


@pytest.mark.parametrize("m, c, w", [("high", "high", 1.0), ("medium", "medium", 1 / 3), ("high", "low", 0.0)])
def test_weight(spark, m, c, w):
    assert abs(one(spark, M.weight(F.col("m"), F.col("c")), m=m, c=c) - w) < 1e-12


@pytest.mark.parametrize("name, short", [("Micron Technology, Inc.", "Micron"), ("Taiwan Semiconductor Manufacturing Company Limited", "Taiwan Semiconductor"), ("BE Semiconductor Industries N.V.", "BE Semiconductor Industries"), ("SE AG", None), ("ABC /4", None)])
def test_match_name(spark, name, short):
    assert one(spark, X.match_name(F.col("n")), n=name) == short


def test_identifiers(spark):
    pattern = X.model_pattern(["gpt", "deepseek", "opus", "haiku", "claude", "llama"], 2)
    ids = lambda t: [r.id for r in one(spark, X.identifiers(F.col("t"), pattern), t=t)]
    assert ids("DeepSeek-V4 and deepseek-r1-0528, gpt-4o; opus-4-8 is Opus 4.8") == ["deepseek-v4", "deepseek-r1.0528", "gpt-4o", "opus-4.8"]
    assert ids("dm-haiku v0.0.7 and Claude") == []
    for raw, stem in (("gpt-6-astra", "gpt-6"), ("deepseek-r1.0528", "deepseek-r1.0528"), ("plain-name", "plain-name")):
        assert one(spark, X.stem(F.col("i")), i=raw) == stem


def test_pages_and_dates(spark):
    assert one(spark, X.strip_html(F.col("t")), t="<p>It&amp;#x27;s</p><script>x</script> Skip to main content ok") == "It's ok"
    assert str(one(spark, X.date_from_page(F.col("t")), t="on September 5, 2025 and")) == "2025-09-05"
    assert str(one(spark, X.date_from_page(F.col("t")), t="Sep 15, 2025")) == "2025-09-15"
    assert str(one(spark, X.date_from_slug(F.col("t")), t="https://x.org/news250821")) == "2025-08-21"
    assert one(spark, X.date_from_slug(F.col("t")), t="https://x.org/news0821") is None
    assert one(spark, X.canonical_link(F.col("t"), "x\\.org"), t="<a href='https://x.org/a/#f'> <a href='https://x.org/index/b/'>") == "https://x.org/index/b"
    assert one(spark, X.archive_key(F.col("t")), t="https://www.X.org/A/b/?q=1") == "x.org/a/b"
    assert one(spark, X.title_tag(F.col("t")), t='<title id="p">T</title>') == "T"
    assert one(spark, X.quote_for(F.col("r"), F.col("t"), width=5), r="mid", t="start  of mid and end") == "of mid and"


def test_names_numbers_and_posts(spark):
    parts = one(spark, X.name_parts(F.col("n")), n="José M. Núñez")
    assert (parts.given, parts.family) == ("jose", "nunez")
    fits = lambda a, b: one(spark, X.given_names_compatible(F.col("a"), F.col("b")), a=a, b=b)
    assert fits("sam", "samuel") and fits("", "x") and not fits("ann", "bob") and not fits("jonathan", "jonathon") and fits("samuel", "sammie") and not fits("jo", "joan")
    shape = lambda t: one(spark, X.looks_like_a_name(F.col("t")), t=t)
    assert shape("Li") and shape("Ann B. Lee") and not shape("PPO") and not shape("Junxiao Song proposed") and not shape("A B C D E") and not shape("X" * 41) and not shape("li")
    assert one(spark, X.tidy_fund_name(F.col("t")), t="Amazon.comInc. ABCHoldings 3M5GFund") == "Amazon.com Inc. ABC Holdings 3 M5 G Fund"
    assert one(spark, X.german_number(F.col("n")), n="1.234,56") == 1234.56 and one(spark, X.german_number(F.col("n")), n="x") is None
    assert one(spark, X.substance(F.col("t")), t="congrats @some_one 🎉 #win https://t.co/x") == "congrats win"
    assert one(spark, X.humanise(F.col("t")), t="open_weights") == "Open weights"
    assert one(spark, X.shortened(F.col("t"), 5), t="abcdefgh") == "abcde…"
    assert one(spark, X.document_type(F.col("l"), F.col("t")), l="x", t="GPT-5 System Card") == "system_card"
    assert one(spark, X.document_type(F.col("l"), F.col("t")), l="anthropic", t="Notes") == "interpretability"


def test_quotes_snap_to_the_document():
    text = "The model “Bench 2.1 , scored”  well…\nand it’s   cheap."
    assert X.snapped('the model "Bench 2.1, scored" well', text) == "The model “Bench 2.1 , scored”  well"
    assert X.snapped("The model ... it's cheap.", text) == text
    assert X.snapped("nothing like this here", text) is None and X.snapped("short", text) is None


def test_periods(spark):
    at = 1757041200  # 2025-09-05T03:00Z
    p = one(spark, D.published_period(F.col("at"), 24), at=at)
    assert (p.start, p.end) == (1757030400 - 2 * 86400, 1757030400 - 86400)
    assert one(spark, D.in_window(F.col("d"), F.col("a"), F.col("b")), d=2, a=1, b=2) and not one(spark, D.in_window(F.col("d"), F.col("a"), F.col("b")), d=1, a=1, b=2)
    assert 0 <= one(spark, D.jitter(F.col("u")), u="x") < 1
