"""Near-duplicates, page extraction, classifier and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillon.llm import cotrain, dartminhash, html_extract, pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def classes(rows):
    """Least id of each document's component of links of 0.8 or more, by comparing all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = {i: shingles(t) for i, t in rows}
    text = dict(rows)
    ids = sorted(root)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            blank = not (text[a] or "").strip() or not (text[b] or "").strip()
            if not blank and (text[a] == text[b] or similarity(bags[a], bags[b]) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 500)}" for _ in range(4000)]
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(6, 250))
        for _ in range(rng.randint(1, 6)):
            copy = [w if rng.random() > rng.choice((0, 0.01, 0.02, 0.06)) else rng.choice(words) for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    hot = rng.choices(words, k=150)
    for k in range(120):
        copy = list(hot)
        copy[rng.randrange(150)] = "x"
        rows.append((n, " ".join(copy)))
        n += 1
    rows += [(n + k, "one two three") for k in range(60)]
    n += 60
    return rows + [(n, ""), (n + 1, None), (n + 2, "!!!"), (n + 3, "!!!"), (n + 4, "ONE, two; three"), (n + 5, "  "), (n + 6, "a b a b " * 300), (n + 7, "a b a b " * 290)]


def test_classes_match_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in dartminhash.dedup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_near_copies_inside_a_template_family(spark):
    rng = random.Random(11)
    template = [f"t{k}" for k in range(400)]

    def change(words, places):
        return [f"w{rng.randrange(10**9)}" if k in places else w for k, w in enumerate(words)]

    rows = []
    for _ in range(120):
        base = change(template, at := rng.sample(range(0, 400, 5), 2))
        rows += [(len(rows) + k, " ".join(change(base, rng.sample([p for p in range(0, 400, 5) if p not in at], 4)))) for k in range(2)]
    want = classes(rows)
    assert 100 < len(set(want.values())) < 240
    got = {r.doc_id: r.class_id for r in dartminhash.dedup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_few_pairs_of_a_large_family_are_compared_in_full(spark, monkeypatch):
    """A family whose members share buckets without being near: the bounds leave little to the exact comparison."""
    rng = random.Random(12)
    template, compared = [f"t{k}" for k in range(300)], []
    rows = []
    for _ in range(300):
        places = set(rng.sample(range(300), 9))
        rows.append((len(rows), " ".join(f"w{rng.randrange(10**9)}" if k in places else w for k, w in enumerate(template))))
    rows += [(len(rows) + k, rows[k][1] + " end") for k in range(20)]
    exact = dartminhash.confirmed
    monkeypatch.setattr(dartminhash, "confirmed", lambda sketches, texts, pairs, similarity: compared.append(pairs.count()) or exact(sketches, texts, pairs, similarity))
    got = {r.doc_id: r.class_id for r in dartminhash.dedup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and len(set(got.values())) >= 290
    assert 20 <= sum(compared) < len(rows)


def test_pairs_across_classes_grow_with_the_members(spark, monkeypatch):
    """Two large classes of one family with very many links between them: a few pairs join them."""
    rng = random.Random(14)
    template, compared = [f"t{k}" for k in range(150)], []
    rows = []
    for k in range(700):
        places = rng.sample(range(150), rng.choice([1, 2, 2, 3, 5, 8]))
        rows.append((k, " ".join(f"w{rng.randrange(40)}" if p in places else w for p, w in enumerate(template))))
    kinds = {"led": 0, "rest": 0}
    exact, cut = dartminhash.confirmed, dartminhash.cut

    def counted(df, name, *most):
        back = cut(df, name, *most)
        if name in kinds:
            kinds[name] += back.count()
        return back

    monkeypatch.setattr(dartminhash, "confirmed", lambda sketches, texts, pairs, similarity: compared.append(pairs.count()) or exact(sketches, texts, pairs, similarity))
    monkeypatch.setattr(dartminhash, "cut", counted)
    got = {r.doc_id: r.class_id for r in dartminhash.dedup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and len(set(got.values())) > 100
    assert kinds["led"] + kinds["rest"] < len(rows) and sum(compared[1:]) < len(rows), (kinds, compared)


@pytest.mark.parametrize("slots", [1 << 20, 1 << 12])
def test_near_texts_meet_in_a_list(slots, monkeypatch):
    """Also where many regions share a counter; texts of different sizes, down to a single region."""
    monkeypatch.setattr(dartminhash, "SLOTS", slots)
    rng = np.random.default_rng(15)
    sets = [rng.integers(0, 1 << 32, size) for size in (1, 1, 2, 5, 9, 60, 200)]
    for _ in range(300):
        base = sets[rng.integers(len(sets))]
        base = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.1])]
        sets.append(np.append(base, rng.integers(0, 1 << 32, rng.integers(0, len(base) // 8 + 1))))
    sets = [s for s in sets if len(s)]
    cells = dartminhash._lists(np.concatenate(sets).astype(np.uint32).view(np.int32), np.array([len(s) for s in sets]), pa.int32())
    ids = pa.array(range(len(sets)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, cells], names=["node", "class", "cells"]).slice(1)
    batches = [batch.slice(0, 100), batch.slice(100)]
    table = pa.Table.from_batches(list(dartminhash._slots(b.select(["cells"]) for b in batches)))
    counts = np.zeros((slots // dartminhash.SLOT_ROW, dartminhash.SLOT_ROW), np.uint32)
    for row, raw in zip(*table.to_pydict().values(), strict=True):
        counts[row] = np.frombuffer(raw, np.int64)
    assert counts.sum() == sum(len(s) for s in sets[1:])
    lists, size = {}, {}
    for r in pa.Table.from_batches(list(dartminhash._prefixes(iter(batches), counts.reshape(-1), 0.8))).to_pylist():
        lists.setdefault(r["region"], []).append((r["node"], r["place"]))
        size[r["node"]] = r["size"]

    def until(a, b):
        return len(set(sets[a])) - int(np.ceil(0.8 / 1.8 * (len(set(sets[a])) + len(set(sets[b]))) - 1e-6)) + 1

    met = {(a, b) for members in lists.values() for a, p in members for b, q in members if a < b and p < until(a, b) and q < until(b, a)}
    near = {(a, b) for a in range(1, len(sets)) for b in range(a + 1, len(sets)) if 10 * (same := len(set(sets[a].tolist()) & set(sets[b].tolist()))) >= 8 * (len(sets[a]) + len(sets[b]) - same)}
    assert len(near) > 500 and near <= met
    assert all(size[a] == len(sets[a]) for a in size)


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many shuffle partitions there are; each file costs an executor processes."""
    from quillon import scratch
    from quillon.operators import components

    files = {}

    def cut(df, name, *most):
        back = scratch.cut(df, name, *most)
        files.setdefault(name, []).append(len(back.inputFiles()))
        return back

    monkeypatch.setattr(dartminhash, "cut", cut)
    monkeypatch.setattr(components, "cut", cut)
    asked = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    rows = corpus()
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.class_id for r in dartminhash.dedup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == classes(rows)
    small = [n for name, ns in files.items() for n in (ns[1:] if name == "edges" else ns) if name not in ("sketches", "texts", "rest")]
    assert len(small) > 12 and max(small) <= 2


def test_both_sides_of_a_list_share_a_shuffle(spark, monkeypatch):
    """Whatever the number of blocks, every two members of different classes meet once."""
    monkeypatch.setattr(dartminhash, "BLOCK", 2)
    asked = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in asked}
    rows = [(region, node, node, 10, 0, 10, [0] * dartminhash.PARITIES) for region in range(3) for node in range(2 * region, 9)]
    lists = spark.createDataFrame(rows, "region int, node long, class long, size int, place int, weight long, odd array<long>")
    found = spark.createDataFrame([(3, 3), (5, 3)], "node long, root long")
    texts = lists.groupBy("node").agg({"weight": "max", "odd": "max"}).toDF("node", "weight", "odd")
    pairs = spark.createDataFrame([(1, 2, 1, 2, 0), (1, 8, 1, 8, 0)], "a long, b long, lead long, other long, salt long")
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        met = dartminhash.across_classes(lists, found, 0.8, 1)
        assert {tuple(r) for r in met.collect()} == {(a, b) for a in range(9) for b in range(a + 1, 9)} - {(3, 5)} and met.count() == 35
        assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()
        few = dartminhash.possible(texts.localCheckpoint(), pairs, 0.8)
        assert few.count() == 2 and "hashpartitioning(node" not in few._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_driver_hands_memory_back_on_the_way(spark, monkeypatch):
    from quillon.llm import memory

    runtime, calls = spark._jvm.java.lang.Runtime.getRuntime(), []
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    memory.relieve(spark)
    least = used()
    for _ in range(8):
        spark._jvm.java.lang.String.valueOf("x" * (16 << 20))
    assert memory.relieve(spark) and used() < least + 40
    monkeypatch.setattr(dartminhash, "relieve", lambda session: calls.append(memory.relieve(session)))
    rows = corpus()
    assert {r.doc_id: r.class_id for r in dartminhash.dedup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == classes(rows)
    assert len(calls) >= 3


def test_null_ids_repeated_rows_and_clashing_names(spark):
    rows = [(None, "alpha beta gamma", "k", 1), (None, "alpha beta gamma", "k", 1), (7, "alpha beta gamma", "k", 2), (7, "alpha beta gamma", "k", 2), (9, None, "k", 3), (None, "only nulls here", "k", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, bands int")
    got = sorted(((r.doc_id, r.class_id) for r in dartminhash.dedup_classes(df).collect()), key=repr)
    assert got == sorted([(None, 7), (None, 7), (7, 7), (7, 7), (9, 9), (None, None)], key=repr)
    kept = dartminhash.keep_one(df)
    assert kept.columns == df.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(7, "alpha beta gamma", "k", 2), (9, None, "k", 3), (None, "only nulls here", "k", 4)]))
    assert dartminhash.dedup_classes(df.limit(0)).count() == 0 and dartminhash.keep_one(df.limit(0)).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 1 << 63, 700, dtype=np.uint64), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    cells = np.concatenate([common, own[:150], common, own[150:]])
    sig = dartminhash.dart_signatures(cells, np.repeat([0, 1], 850), np.array([850, 850]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.7) < 0.05
    half = dartminhash.dart_signatures(np.concatenate([common, common]), np.repeat([0, 1], 700), np.array([700.0, 350.0]), 1024, np.repeat([1.0, 0.5], 700))
    assert abs((half[0] == half[1]).mean() - 0.5) < 0.06


PAGE = """<html><head><title>t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav>Home &gt; <a href=x>News</a></nav><header><p>Site</p></header>
<!-- <p>no</p> --><article class="post"><header><h1>A &amp; B</h1></header><p>One<b>two</b>&nbsp; three<br>four<p>Fünf &#x2014; &lt;six&gt;</p><aside>no</aside><div class="share-bar">no</div>
<section id="comments"><article class="comment"><p>no</p></article></section><ul><li>x</li><li>y</li></ul><form><p>no</p></form></article><footer>no</footer></body></html>"""


def test_blocks_of_an_article():
    text = "\n".join(t for k, t in html_extract.blocks(PAGE) if k == html_extract.ARTICLE)
    assert text == "A & B\nOnetwo three four\nFünf — <six>\nx\ny"


@pytest.mark.parametrize("page", ["", "<", "<p", "a<b>c", "<p>x</div></p>y", "<script>x", "<!-- x", "<a href='x>y", "</article>z", "<p class=ad>a<p>b", "x &amp;amp; y &unknown; &#0;", "<" * 3000, "<div>" * 3000])
def test_broken_pages_do_not_crash(page):
    html_extract.blocks(page)


@pytest.mark.parametrize("page", ["<a ", "<div>", "<a href='x", "</b>", "<!", "<b>", "<p class=x>", "<script>", "&amp", "<x \"'>"])
def test_parsing_is_linear(page):
    import time

    began = time.time()
    html_extract.blocks(page * (2_000_000 // len(page)) + "</p>")
    html_extract.blocks("<a " + page.strip("<>") * (2_000_000 // len(page)) + ">")
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_counts_pages(seed):
    rng = random.Random(seed)
    streams = [[rng.randint(0, 2 if seed < 3 else 30) for _ in range(rng.randint(0, 60))] for _ in range(6)] + [[7] * 40, [7] * 8]
    ids, page = [x for s in streams for x in s], [i for i, s in enumerate(streams) for _ in s]
    d, want = html_extract.DEPTH, {}
    for i, s in enumerate(streams):
        for k in range(len(s) - d + 1):
            want.setdefault(tuple(s[k : k + d]), set()).add(i)
    at, pages = html_extract.suffix_groups(np.array(ids), np.array(page))
    assert {tuple(ids[a : a + d]): n for a, n in zip(at.tolist(), pages.tolist())} == {k: len(v) for k, v in want.items()}


def test_host_boilerplate_goes_whatever_the_shards(spark):
    rng = random.Random(2)
    line = "this line of twelve words stands on every page of the host"
    pages, want = [], {}
    for i in range(30):
        own = " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(20))
        host = ("a", "b", None)[i % 3]
        pages.append((i, f"http://{host}.org/{i}" if host else None, f"<body><div>{line}</div><div>{own}</div><span>{line}</span></body>"))
        want[i] = own
    pages += [(30, "http://a.org/x", None), (31, "http://c.org/x", f"<p>{line}</p>"), (32, "http://c.org/y", f"<p>{line}</p>"), (32, "http://c.org/y", f"<p>{line}</p>")]
    want |= {30: "", 31: line, 32: line}
    # Versions of one page, and a passage that two pages share, aren't boilerplate.
    body = " ".join(f"b{k}" for k in range(60))
    pages += [(40 + i, "http://d.org/x", f"<div>{line}</div><div>{body} v{i}</div>") for i in range(9)] + [(60 + i, f"http://d.org/{i}", f"<div>{line}</div><p>s{i} {body.replace('b', 'c') if i < 2 else i} {' '.join(str(rng.random()) for _ in range(30))}</p>") for i in range(20)]
    want |= {40 + i: f"{line}\n{body} v{i}" for i in range(9)} | {60 + i: re.search("<p>(.*)</p>", pages[-20 + i][2])[1] for i in range(20)}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (1 << 20, 100):
        out = html_extract.extract(df.withColumn("text", df.url), shard_tokens=limit).collect()
        assert {r.page_id: r.text for r in out} == want and len(out) == len(pages) and all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_repeats_tell_the_article_from_a_card(spark):
    """Pages with an article element and unmarked blocks: the suffix array decides which is the text."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(n))
    card = "read also what our readers liked best in the past week"
    pages, want = [], {}
    for i in range(30):
        # A card on every page; a page's own article with a remark; versions of one article with a changing remark.
        own, remark = words(40), words(9)
        pages.append((i, f"http://a.org/{i}", f"<nav>x</nav><article>{card}</article><div>{own}</div>"))
        pages.append((100 + i, f"http://b.org/{i}", f"<article><p>{own}</p><p>{card}</p></article><div>{words(60)}</div><footer>{card}</footer>"))
        pages.append((200 + i, f"http://c.org/{i}", f"<main>{' '.join(f'b{k}' for k in range(60))}</main><div>{remark}</div>"))
        want |= {i: own, 100 + i: f"{own}\n{card}", 200 + i: " ".join(f"b{k}" for k in range(60))}
    # A lone page's article is the text whatever stands beside it.
    pages.append((300, "http://d.org/", f"<article>{card}</article><div>{words(50)}</div>"))
    want[300] = card
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (1 << 20, 200):
        assert {r.page_id: r.text for r in html_extract.extract(df, shard_tokens=limit).collect()} == want


def test_pages_without_open_blocks_are_evidence_in_full(spark):
    """Articles of one host under the same menu are as many pages, their passages count, and every page is looked at."""
    rng = random.Random(6)
    words = lambda n: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(n))
    menu, passage = " ".join(f"m{k}" for k in range(12)), " ".join(f"p{k}" for k in range(10))
    pages, want = [], {}
    for i in range(40):
        own = words(30)
        pages.append((i, f"http://a.org/{i}", f"<nav>{menu}</nav><article>{own}</article>"))
        pages.append((100 + i, f"http://b.org/{i}", f"<article><p>{own}</p><p>{passage}</p></article>"))
        want |= {i: (own, 12), 100 + i: (f"{own}\n{passage}", 10)}
    own = words(30)
    pages += [(200, "http://a.org/x", f"<div>{menu}</div><div>{own}</div>"), (201, "http://b.org/x", f"<div>{passage}</div><div>{own}</div>")]
    pages += [(202, "http://c.org/x", f"<nav>{menu}</nav><article>{own}</article>"), (203, None, None)]
    want |= {200: (own, 12), 201: (own, 10), 202: (own, 0), 203: ("", 0)}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit, most in ((1 << 20, 1 << 21), (60, 2)):
        out = html_extract.extract(df, shard_tokens=limit, per_pass=most).collect()
        assert {r.page_id: (r.text, r.n_repeated) for r in out} == want and len(out) == len(pages)


def test_articles_of_the_pages_table(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def labelled(n, seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad, low = rng.random() < 0.15, rng.random() < 0.2
        ws = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if bad:
            for k in rng.sample(range(len(ws)), 4):
                ws[k] = rng.choice(("nasty", "vile", "rotten"))
        docs.append((i, " ".join(w.upper() + "!!" if low else w for w in ws), rng.choice(("en", "de", None)), f"src{i % 5}"))
        labels.append((i, 0 if low else 1, 1 if bad else 0))
    return docs, labels


def test_classifier_on_held_out_labels(spark):
    docs, labels = labelled(900, 4)
    df = spark.createDataFrame([*docs, (None, None, None, None)], "doc_id long, text string, lang string, source string").withColumn("labelled", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    known = spark.createDataFrame(labels[:500], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in cotrain.score(df, known).collect()}
    assert len(out) == 901
    for head, place in (("p_low", 1), ("p_toxic", 2)):
        truth = [(1 - r[1]) if place == 1 else r[2] for r in labels[500:]]
        hits = sum((out[r[0]][head] >= 0.5) == bool(t) for r, t in zip(labels[500:], truth))
        assert hits / len(truth) > 0.97
    again = {r.doc_id: r for r in cotrain.score(df, known).collect()}
    assert again == out


def test_classifier_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "x", "en", "s"), (1, "x", "en", "s")], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotrain.score(df, none).where("keep").count() == 2 and cotrain.score(df.limit(0), none).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert cotrain.score(df, nulls).where("keep").count() == 2


def test_classifier_sums_and_scores_by_hand(spark):
    """The executors' sums against one sum over all rows, and every score against its model, term by term."""
    import math

    docs, labels = labelled(700, 9)
    docs += [(2000, "long " * 200000, "en", "src1"), (2001, "", "en", "src1"), (None, "nasty rotten x", "en", None), (3, docs[3][1], "en", "src2")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    coder, heads = cotrain.fit(df, known)
    bad, words = heads["toxic"], {w: i for w, i in coder.words.items()}
    assert {b"nasty", b"vile", b"rotten"} <= set(words) and len(set(bad.columns["text"])) == len(bad.columns["text"])
    logistic = lambda z: 1 / (1 + math.exp(-z))
    for r in cotrain.score(df.withColumn("labelled", df.lang).withColumn("text2", df.text), known).collect():
        raw = r.text.encode()
        ws = WORD.findall(r.text.lower())
        seen = cotrain.content(raw, [w.encode() for w in ws])
        cells = coder.cells(cotrain.layout(raw, [w.encode() for w in ws]), r.lang, r.source)
        z = {}
        for view, mine in (("text", {words[w] for w in seen if w in words}), ("meta", set(cells))):
            b = bad.beta[view]
            z[view] = b[-1] + sum(b[k] for k, c in enumerate(bad.columns[view]) if c in mine)
        a, m, c = bad.stack
        assert abs(r.p_toxic - logistic(a * z["text"] + m * z["meta"] + c)) < 1e-9 and r.keep == (r.p_low < 0.5 and r.p_toxic < 0.5)
    rng = np.random.default_rng(1)
    rows = [tuple(np.flatnonzero(rng.random(coder.widths[v]) < 0.2).tolist() for v in cotrain.VIEWS) for _ in range(3000)]
    pool = spark.createDataFrame(rows, "text array<int>, meta array<int>").repartition(7)
    got = cotrain.lessons(pool, coder.widths, heads)
    x = {v: cotrain._dense([r[k] for r in rows], coder.widths[v]) for k, v in enumerate(cotrain.VIEWS)}
    checked = 0
    for name, head in heads.items():
        z = head.logits(x)
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            p = 1 / (1 + np.exp(-(head.scale[teacher][0] * z[teacher] + head.scale[teacher][1])))
            yes, no = head.sure(p)
            use = yes | no
            if use.any():
                one = np.hstack([x[pupil][:, head.columns[pupil]], np.ones((len(rows), 1))])[use]
                q = 1 / (1 + np.exp(-one @ head.beta[pupil]))
                lesson = got[name, pupil]
                assert lesson.documents == use.sum() and np.allclose(lesson.gradient, one.T @ (yes[use] - q)) and np.allclose(lesson.curvature, one.T @ np.diag(np.maximum(q * (1 - q), 1e-5)) @ one)
                checked += 1
            else:
                assert (name, pupil) not in got
    assert checked


def test_pseudo_labels_teach(spark):
    """Few labels: the views are right more often after they have taught each other on the whole pool."""
    docs, labels = labelled(1500, 12)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels[:120], "doc_id long, quality int, toxic int")
    right = {}
    for rounds in (0, 3):
        out = {r.doc_id: r for r in cotrain.score(df, known, rounds=rounds).collect()}
        right[rounds] = sum((out[i].p_toxic >= 0.5) == (t == 1) and (out[i].p_low >= 0.5) == (q == 0) for i, q, t in labels[120:])
    assert right[3] >= right[0] and right[3] > 0.95 * 1380


def test_boosted_trees_learn_and_express_the_same(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = Counter()
    for _ in range(4000):
        code = rng.randrange(1 << len(pii.FEATURES))
        label = int(bool(code >> 11 & 1) and not code >> 6 & 1) if rng.random() > 0.02 else rng.randint(0, 1)
        rows[code, label, int(rng.random() > 0.25)] += 1
    model = pii.boost([(*k, float(v)) for k, v in sorted(rows.items())])
    codes = list(range(0, 1 << len(pii.FEATURES), 7))
    good = sum((model.chance(c) >= model.threshold) == bool(c >> 11 & 1 and not c >> 6 & 1) for c in codes)
    assert good / len(codes) > 0.97
    df = spark.createDataFrame([(c,) for c in codes], "c int").select("c", model.selects(F.col("c")).alias("y"))
    assert all(r.y == (model.chance(r.c) >= model.threshold) for r in df.collect())


def test_pipeline_stages(spark, sf_dir):
    """Each stage against what it says, on its own input."""
    from quillon.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    want = {r.doc_id for r in queries.op7_quality_classifier(spark, sf_dir).where("keep").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    unique = corpus_pipeline.near_dedup(spark, kept, sf_dir).cache()
    root = classes([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(root.values()))
    clean = corpus_pipeline.decontaminate(spark, unique, sf_dir).cache()
    bad = {r.doc_id for r in queries.op1_decontaminate(spark, sf_dir).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()} - bad
    hidden = corpus_pipeline.hide_secrets(spark, clean, sf_dir).cache()
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in hidden.collect():
        assert (r.text == before[r.doc_id]) == (not re.search(r"(?i)token = |AKIA[A-Z0-9]{16}|[0-9a-f]{24}", before[r.doc_id])) and not re.search(r"[0-9a-f]{24}", r.text)
    mixed = corpus_pipeline.mix(spark, hidden, sf_dir)
    assert {"doc_id", "text", "copy_no", "taken"} <= set(mixed.columns) and mixed.count() > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == mixed.count()


def test_trimmed_passes_every_batch_on():
    import pyarrow as pa

    from quillon.llm.memory import trimmed

    batches = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (3, 0, 5)]
    assert [b.num_rows for b in trimmed(iter(batches))] == [3, 0, 5] and list(trimmed(iter([]))) == []
