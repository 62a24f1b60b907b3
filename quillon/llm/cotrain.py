"""Quality and toxicity classifier by co-training of two views.

The text-content view sees which words and punctuation runs a document holds; the page-metadata view sees its
language, source, length and layout (binned shares of capitals, symbols, digits, repeated lines and the like).
Each view is a logistic regression. In every round each view labels all unlabelled documents, and those it is sure
of teach the other view: the executors sum what they add to the other view's gradient and curvature, and only these
sums, whose size is that of the model, reach the driver. A held-out part of the labels, on which no view is fitted,
calibrates each view, in every round, and in the end both together: a logistic regression of their two logits.
The whole is done for "low quality" and for "toxic"; a document is kept if both chances are under 1/2.

The views start from at most MAX_LABELLED labelled documents, those of the least digests of their ids (a parameter).
The words of a head's text view are the MAX_WORDS that tell most about its labels, by counts over those documents;
languages and sources that MIN_FACET of them share are cells of the metadata view. The pool of unlabelled documents
has no bound; it's written once as numbers of words and cells. Whole texts of all documents are scored, in one pass
without a shuffle.

Defined results: a null text counts as empty; null lang or source is a value of its own; a document with several
labels is low if one says so and toxic if one says so; null labels are ignored; of several labelled rows of one id
the greatest text teaches; without labels, or with labels of one class only, the chance is the share of that class
(0 without labels), so all is kept or judged alike; repeated rows are scored alike; an empty table gives an empty
result. Other columns pass through; only p_text, p_meta, p_low, p_toxic and keep are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.memory import trimmed
from quillon.llm.words import raw_texts, words
from quillon.scratch import cut

MAX_LABELLED, MAX_WORDS, MIN_FACET = 8000, 300, 5
ROUNDS, PSEUDO_SHARE, SURE = 3, 0.5, 0.95
#: How much the odds of a sure negative lie under those of the class.
SURE_ODDS = 20.0
RIDGE, META_RIDGE, BINS, STEM, HELD = 0.1, 0.9, 8, 4, 0.25
HEADS, VIEWS = ("low", "toxic"), ("text", "meta")
#: Rows of a dense matrix at a time, and rows of a curvature matrix in one row of a table.
BLOCK, STRIP = 1024, 16

_RUN = re.compile(rb"[!-/:-@\[-`{-~]+")
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGIT = bytes(range(0x30, 0x3A))
_SYMBOL = b"#*$%&|<>!@^~=_\\{}[]+/"
_MARK = b".,;:?'\"()-"
_HIGH = bytes(range(0x80, 0x100))


def content(raw: bytes, ws: list[bytes]) -> set[bytes]:
    """The text view: words, their first bytes, and punctuation runs; the latter two under marks that no word has."""
    seen = set(ws)
    return seen | {b"\x01" + w[:STEM] for w in seen if len(w) > STEM} | {b"\x00" + r[:8] for r in set(_RUN.findall(raw))}


def layout(raw: bytes, ws: list[bytes]) -> list[float]:
    """The numbers of the metadata view."""
    n, n_words = len(raw) or 1, len(ws)
    share = lambda chars: 1 - len(raw.translate(None, chars)) / n if raw else 0.0
    lines = [x for x in raw.split(b"\n") if x]
    return [
        math.log1p(len(raw)), share(_UPPER), share(_LOWER), share(_DIGIT), share(_SYMBOL), share(_MARK), share(_HIGH),
        math.log1p(len(lines)), 1 - len(set(lines)) / len(lines) if lines else 0.0, n / (n_words + 1), math.log1p(n / (len(lines) or 1)),
        len(set(ws)) / (n_words or 1), sum(map(eq, ws, islice(ws, 1, None))) / (n_words or 1),
    ]


N_NUMBERS = len(layout(b"", []))


def _facets(lang, source) -> tuple[str, str]:
    return f"lang={lang}", f"source={source}"


class Coder:
    """Numbers of a document's telling words and of its metadata cells."""

    def __init__(self, telling: list[bytes], edges: list[list[float]], facets: list[str]):
        self.words = {w: i for i, w in enumerate(telling)}
        self.known = frozenset(self.words)
        self.edges = edges
        self.starts = np.cumsum([0, *(len(e) + 1 for e in edges)]).tolist()
        self.facets = {f: self.starts[-1] + i for i, f in enumerate(facets)}
        self.widths = {"text": len(self.words), "meta": self.starts[-1] + len(facets)}

    def __call__(self, raw: bytes, lang, source) -> tuple[list[int], list[int]]:
        ws = words(raw)
        found = sorted(self.words[w] for w in self.known & content(raw, ws))
        return found, self.cells(layout(raw, ws), lang, source)

    def cells(self, numbers: list[float], lang, source) -> list[int]:
        out = [s + bisect_right(e, x) for s, e, x in zip(self.starts, self.edges, numbers)]
        return out + [self.facets[f] for f in _facets(lang, source) if f in self.facets]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches, 256):
        texts = raw_texts(_column(part, "text"))
        token_lists = [words(t) for t in texts]
        sets = [sorted(content(t, ws)) for t, ws in zip(texts, token_lists)]
        numbers = [layout(t, ws) for t, ws in zip(texts, token_lists)]
        kept = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(_column(part, c) for c in kept), pa.array(sets, pa.list_(pa.binary())), pa.array(numbers, pa.list_(pa.float64()))], names=[*kept, "words", "numbers"])


def _coded(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    """Numbers of words and cells of whole texts."""
    for part in _slices(batches, 256):
        rows = zip(raw_texts(_column(part, "text")), _column(part, "lang").to_pylist(), _column(part, "source").to_pylist())
        found = [coder(*row) for row in rows]
        yield pa.RecordBatch.from_arrays([_column(part, "id"), *(pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1))], names=["id", *VIEWS])


def _dense(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for row, cols in enumerate(lists):
        out[row, cols] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Lesson:
    """What pseudo-labelled documents add to a view's gradient and curvature, taken at the view's coefficients."""

    def __init__(self, at: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, documents: float):
        self.at, self.gradient, self.curvature, self.documents = at, gradient, curvature, documents


def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log-likelihood; x ends with a column of ones."""
    p = sigmoid(x @ beta)
    return x.T @ (y - p), (x * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ x


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, lesson: Lesson | None = None) -> np.ndarray:
    """Newton's method, in blocks of rows; the last coefficient is the intercept, which isn't shrunk.

    A lesson weighs at most PSEUDO_SHARE as much as the labelled rows, however many documents it sums."""
    penalty = np.full(x.shape[1] + 1, ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1] + 1)
    base = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    beta[-1] = math.log(base / (1 - base))
    weight = min(1.0, PSEUDO_SHARE * len(y) / lesson.documents) if lesson is not None and lesson.documents else 0.0
    for _ in range(12):
        grad, h = -penalty * beta, np.diag(penalty)
        for at in range(0, len(x), BLOCK):
            g, c = sums(with_ones(x[at : at + BLOCK]), y[at : at + BLOCK], beta)
            grad, h = grad + g, h + c
        if weight:
            grad, h = grad + weight * (lesson.gradient - lesson.curvature @ (beta - lesson.at)), h + weight * lesson.curvature
        step = np.linalg.solve(h, grad)
        beta += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return beta


class Head:
    """The model of one head: for each view its columns, coefficients and scale, and the stack of both."""

    def __init__(self, columns: dict[str, np.ndarray], share: float):
        self.columns, self.share = columns, share
        self.beta: dict[str, np.ndarray] = {}
        self.scale: dict[str, list[float]] = {}
        self.stack: list[float] = []

    def logits(self, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {v: x[v][:, self.columns[v]] @ self.beta[v][:-1] + self.beta[v][-1] for v in VIEWS}

    def opinions(self, z: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {v: sigmoid(self.scale[v][0] * z[v] + self.scale[v][1]) for v in VIEWS}

    def both(self, z: dict[str, np.ndarray]) -> np.ndarray:
        return sigmoid(self.stack[0] * z["text"] + self.stack[1] * z["meta"] + self.stack[2])

    def sure(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which documents a view is sure to be of the class, and which not to be."""
        no = self.share / (1 - self.share) / SURE_ODDS
        return p >= SURE, p <= min(no / (1 + no), 1 - SURE)


def _stack(logits: list[np.ndarray], y: np.ndarray) -> list[float]:
    """Coefficients of the logits and the intercept; a view that would count against its own opinion is left out."""
    out = fit_logistic(np.column_stack(logits), y, 0.05).tolist()
    if min(out[:-1]) >= 0:
        return out
    if len(logits) == 1:
        return [0.0, math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))]
    i = 0 if out[0] >= out[1] else 1
    a, c = _stack([logits[i]], y)
    return [a, 0.0, c] if i == 0 else [0.0, a, c]


def _lessons(batches: Iterator[pa.RecordBatch], widths: dict[str, int], heads: dict[str, Head]) -> Iterator[pa.RecordBatch]:
    """One task's sums for each head and view, in strips of the curvature; strip -1 holds the gradient and the number of documents."""
    total: dict[tuple[str, str], list] = {}
    for part in _slices(batches):
        x = {v: _dense(_column(part, v).to_pylist(), widths[v]) for v in VIEWS}
        for name, head in heads.items():
            z = head.logits(x)
            p = head.opinions(z)
            for teacher, pupil in (VIEWS, VIEWS[::-1]):
                yes, no = head.sure(p[teacher])
                rows = np.flatnonzero(yes | no)
                if len(rows):
                    g, h = sums(with_ones(x[pupil][np.ix_(rows, head.columns[pupil])]), yes[rows].astype(float), head.beta[pupil])
                    old = total.setdefault((name, pupil), [0.0, 0.0, 0.0])
                    total[name, pupil] = [old[0] + g, old[1] + h, old[2] + len(rows)]
    out = []
    for (name, view), (g, h, n) in total.items():
        out.append((name, view, -1, [*g.tolist(), float(n)]))
        out += [(name, view, at // STRIP, h[at : at + STRIP].ravel().tolist()) for at in range(0, len(h), STRIP)]
    for row in out:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64())))], names=["head", "view", "strip", "values"])


_LESSON = "head string, view string, strip int, values array<double>"


def _summed(table: pa.Table) -> pa.Table:
    """The sum of one strip over tasks."""
    lists = table.column("values").combine_chunks()
    values = lists.flatten().to_numpy().reshape(len(lists), -1).sum(axis=0).tolist()
    return pa.table({**{c: table.column(c)[:1] for c in ("head", "view", "strip")}, "values": pa.array([values], pa.list_(pa.float64()))})


def lessons(pool: DataFrame, widths: dict[str, int], heads: dict[str, Head]) -> dict[tuple[str, str], Lesson]:
    """What each view teaches the other about all of the pool. A strip has one row for each task, so tasks are few."""
    tasks = 2 * pool.sparkSession.sparkContext.defaultParallelism
    parts = pool.select(*VIEWS).coalesce(tasks).mapInArrow(lambda it: trimmed(_lessons(it, widths, heads)), _LESSON)
    rows = parts.groupBy("head", "view", "strip").applyInArrow(_summed, _LESSON).toArrow().sort_by([("head", "ascending"), ("view", "ascending"), ("strip", "ascending")])
    found: dict[tuple[str, str], list[np.ndarray]] = {}
    for head, view, values in zip(rows["head"].to_pylist(), rows["view"].to_pylist(), rows["values"]):
        found.setdefault((head, view), []).append(values.values.to_numpy())
    out = {}
    for (head, view), (first, *strips) in found.items():
        n = len(first) - 1
        out[head, view] = Lesson(heads[head].beta[view], first[:-1], np.concatenate(strips).reshape(n, n), first[-1])
    return out


def cotrain(x: dict[str, np.ndarray], marks: dict[str, np.ndarray], held: np.ndarray, columns: dict[str, np.ndarray], teach, rounds: int = ROUNDS) -> dict[str, Head | float]:
    """Both heads from coded labelled documents. marks: 1, 0 or nan for each head; teach(heads) gives the lessons of a round."""
    out: dict[str, Head | float] = {}
    heads: dict[str, Head] = {}
    for name in HEADS:
        y = marks[name]
        known = ~np.isnan(y)
        if not known.any():
            out[name] = 0.0
        elif len(set(y[known & ~held])) < 2:
            out[name] = float(y[known].mean())
        else:
            heads[name] = Head({"text": columns[name], "meta": np.arange(x["meta"].shape[1])}, float(y[known].mean()))
    taught: dict[tuple[str, str], Lesson] = {}
    for turn in range(rounds + 1):
        for name, head in heads.items():
            y = marks[name]
            train = np.flatnonzero(~np.isnan(y) & ~held)
            for v, ridge in zip(VIEWS, (RIDGE, META_RIDGE)):
                head.beta[v] = fit_logistic(x[v][np.ix_(train, head.columns[v])], y[train], ridge, taught.get((name, v)))
            use = np.flatnonzero(~np.isnan(y) & held)
            use = use if len(set(y[use])) == 2 else train
            z = head.logits({v: x[v][use] for v in VIEWS})
            head.scale = {v: _stack([z[v]], y[use]) for v in VIEWS}
            head.stack = _stack([z[v] for v in VIEWS], y[use])
        if turn < rounds and heads:
            taught = teach(heads)
    return {**out, **heads}


def _telling(examples: DataFrame, max_words: int) -> dict[str, list[bytes]]:
    """Each head's words whose presence tells most about it: the likelihood ratio of a 2 x 2 table of documents."""
    seen = lambda head, v: F.sum(F.when(F.col(head) == v, 1).otherwise(0)).cast("double")
    marks = [seen(h, v).alias(f"{h}{v}") for h in HEADS for v in (0, 1)]
    train = examples.where(~F.col("held"))
    all_ = train.agg(*marks).first()
    counts = cut(train.select(*HEADS, F.explode("words").alias("word")).groupBy("word").agg(*marks), "words")
    # Among so many words some tell by chance; the bound grows with their number.
    odd = 2 * math.log(max(counts.count(), 3))
    bound = max(12.0, odd - math.log(odd) - 0.45)
    out = {}
    for h in HEADS:
        n0, n1 = all_[f"{h}0"] or 0.0, all_[f"{h}1"] or 0.0
        if not n0 or not n1:
            out[h] = []
            continue
        a, b = F.col(f"{h}1"), F.col(f"{h}0")
        part = lambda cell, of_row, of_col: F.when(cell > 0, cell * F.log(cell * F.lit(n0 + n1) / (of_row * F.lit(of_col)))).otherwise(0.0)
        rest = F.lit(n0 + n1) - a - b
        g = 2 * (part(a, a + b, n1) + part(b, a + b, n0) + part(F.lit(n1) - a, rest, n1) + part(F.lit(n0) - b, rest, n0))
        rows = counts.where(a + b >= 3).select("word", g.alias("g")).where(F.col("g") > bound).orderBy(F.desc("g"), "word").limit(max_words).collect()
        out[h] = [bytes(r.word) for r in rows]
    return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, max_labelled: int) -> DataFrame:
    """id, low, toxic, held, words and numbers of a bounded sample of labelled documents, one row for each id."""
    one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(1 - F.col("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
    chosen = one.where("low is not null or toxic is not null").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(max_labelled)
    chosen = chosen.withColumn("held", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1000)) < 1000 * HELD)
    # At most max_labelled rows of four small columns.
    rows = _rows(docs, id_col, text).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", *HEADS, "held").agg(F.max(F.struct("text", "lang", "source")).alias("d")).select("id", *HEADS, "held", "d.*")
    columns = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*columns, T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("numbers", T.ArrayType(T.DoubleType()))])
    return cut(rows.mapInArrow(lambda it: trimmed(_examples(it)), schema), "examples")


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(text).cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS, rounds: int = ROUNDS) -> tuple[Coder, dict]:
    """The coder and both heads' models: from a bounded sample of labels and all unlabelled documents."""
    spark = docs.sparkSession
    examples = labelled(docs, labels, id_col, text, max_labelled)
    telling = _telling(examples, max_words)
    probs = [k / BINS for k in range(1, BINS)]
    quantiles = examples.agg(*[F.percentile(F.get("numbers", F.lit(i)), probs).alias(f"q{i}") for i in range(N_NUMBERS)]).first()
    edges = [sorted(set(q or [])) for q in quantiles]
    facets = [f"{c}={r[c]}" for c in ("lang", "source") for r in examples.groupBy(c).count().where(F.col("count") >= MIN_FACET).orderBy(c).collect()]
    union = sorted({w for ws in telling.values() for w in ws})
    coder = Coder(union, edges, facets)
    # At most max_labelled rows of small numbers.
    table = examples.mapInArrow(lambda it: trimmed(_recoded(it, coder)), "id long, low int, toxic int, held boolean, text array<int>, meta array<int>").toArrow().sort_by("id")
    if not table.num_rows:
        return coder, {head: 0.0 for head in HEADS}
    x = {v: _dense(table[v].to_pylist(), coder.widths[v]).astype(np.float32) for v in VIEWS}
    marks = {h: np.array([math.nan if m is None else float(m > 0) for m in table[h].to_pylist()]) for h in HEADS}
    columns = {h: np.array([coder.words[w] for w in telling[h]], dtype=np.int64) for h in HEADS}
    pool: list[DataFrame] = []

    def teach(heads: dict[str, Head]) -> dict[tuple[str, str], Lesson]:
        if not pool:  # written only if a head can learn
            ids = cut(labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct(), "ids")
            id_type = docs.schema[id_col].dataType.simpleString()
            coded = _rows(docs, id_col, text).mapInArrow(lambda it: trimmed(_coded(it, coder)), f"id {id_type}, text array<int>, meta array<int>")
            coded = cut(coded, "coded")
            pool.append(coded.where("id is not null").join(ids, "id", "left_anti").select(*VIEWS).unionByName(coded.where("id is null").select(*VIEWS)))
        return lessons(pool[0], coder.widths, heads)

    return coder, cotrain(x, marks, np.array(table["held"].to_pylist()), columns, teach, rounds)


def _recoded(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    """Labelled examples as numbers of words and cells."""
    for part in _slices(batches, 256):
        found = [sorted(coder.words[w] for w in coder.known & set(ws)) for ws in _column(part, "words").to_pylist()]
        cells = [coder.cells(*row) for row in zip(_column(part, "numbers").to_pylist(), _column(part, "lang").to_pylist(), _column(part, "source").to_pylist())]
        kept = [_column(part, c) for c in ("id", *HEADS, "held")]
        kept[0] = kept[0].cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int32())), pa.array(cells, pa.list_(pa.int32()))], names=["id", *HEADS, "held", *VIEWS])


_RESULTS = ("p_text", "p_meta", "p_low", "p_toxic")


def _score(batches: Iterator[pa.RecordBatch], coder: Coder, heads: dict, text: str) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches, 512):
        found = [coder(*row) for row in zip(raw_texts(_column(part, text)), _column(part, "lang").to_pylist(), _column(part, "source").to_pylist())]
        x = {v: _dense([f[k] for f in found], coder.widths[v]) for k, v in enumerate(VIEWS)}
        out = {}
        for name in HEADS:
            head = heads[name]
            if isinstance(head, Head):
                z = head.logits(x)
                views, out[f"p_{name}"] = head.opinions(z), head.both(z)
            else:
                out[f"p_{name}"] = np.full(len(found), head)
                views = dict.fromkeys(VIEWS, out[f"p_{name}"])
            if name == HEADS[0]:
                out |= {f"p_{v}": views[v] for v in VIEWS}
        yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[c], pa.float64()) for c in _RESULTS)], names=[*part.schema.names, *_RESULTS])


def score(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs (with doc_id, lang, source, text) with p_text, p_meta (chance of low quality in either view), p_low, p_toxic, keep."""
    docs = docs.drop(*_RESULTS, "keep")
    coder, heads = fit(docs, labels, text=text, **options)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in _RESULTS)])
    out = docs.mapInArrow(lambda it: trimmed(_score(it, coder, heads, text)), schema)
    return out.withColumn("keep", (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5))
