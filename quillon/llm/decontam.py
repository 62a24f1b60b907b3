"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item, or the whole item where it has fewer
(but not none). Patterns are grouped by length m. Each group has a shift table over blocks of two words: a
block that no pattern holds lets the search jump m - 1 words, a word that no pattern holds m words. Where the
shift is nil, the hash of the last words selects a bucket of patterns, and direct comparison confirms.

Defined results: a null or wordless text has no words and no hits and is not contaminated; null item ids and
null item texts are ignored; items that share an id count once; an empty benchmark hits nothing; repeated
document rows are each scanned. Columns of the documents other than the text pass through untouched; the
columns n_words, n_hit, items, spans and contaminated replace ones of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.memory import trimmed
from quillon.llm.words import raw_texts, words

N = 13
#: UTF-8 bytes of benchmark text in one search table; a larger benchmark is searched in several such blocks.
BLOCK_BYTES = 16 << 20


class WuManber:
    def __init__(self, items: list[tuple[str, bytes]], n: int = N):
        groups: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, raw in items:
            ws = words(raw)
            m = min(n, len(ws))
            for i in range(len(ws) - m + 1) if m else ():
                groups[m][tuple(ws[i : i + m])].add(item)
        self.groups = []
        for m, patterns in sorted(groups.items()):
            shift: dict[bytes, dict[bytes, int]] = defaultdict(dict)
            buckets: dict[int, list] = defaultdict(list)
            suffix = min(4, m)
            for p, ids in patterns.items():
                if m == 1:
                    shift[p[0]] = {}
                for j in range(m):
                    row = shift[p[j]]
                    if j:
                        row[p[j - 1]] = min(row.get(p[j - 1], m - 1), m - 1 - j)
                buckets[hash(p[-suffix:])].append((list(p), ids))
            self.groups.append((m, suffix, dict(shift), dict(buckets)))

    def search(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word spans under any occurrence, and the ids of the items that occur."""
        found: list[tuple[int, int]] = []
        ids: set[str] = set()
        n = len(ws)
        for m, suffix, shift, buckets in self.groups:
            p = m - 1
            while p < n:
                row = shift.get(ws[p])
                if row is None:
                    p += m
                    continue
                if m > 1:
                    jump = row.get(ws[p - 1], m - 1)
                    if jump:
                        p += jump
                        continue
                for pattern, items in buckets.get(hash(tuple(ws[p - suffix + 1 : p + 1])), ()):
                    if ws[p - m + 1 : p + 1] == pattern:
                        found.append((p - m + 1, p + 1))
                        ids |= items
                        break
                p += 1
        return merged(found), ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_TABLES: dict[object, WuManber] = {}
_ADDED = {"_n": pa.int64(), "_spans": pa.list_(pa.int64()), "_items": pa.list_(pa.string())}


def _scan(batches: Iterator[pa.RecordBatch], shared, key: str, n: int, text: str) -> Iterator[pa.RecordBatch]:
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = WuManber(shared.value, n)
    table = _TABLES[key]
    for b in batches:
        # Spark's own batches may hold thousands of long texts: a few at a time bound the memory.
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            counts, spans, items = [], [], []
            names = part.schema.names
            old_spans = part.column(names.index("_spans")).to_pylist() if "_spans" in names else [[]] * part.num_rows
            old_items = part.column(names.index("_items")).to_pylist() if "_items" in names else [[]] * part.num_rows
            for raw, was, had in zip(raw_texts(part.column(names.index(text))), old_spans, old_items):
                ws = words(raw)
                got, ids = table.search(ws)
                got = merged(got + list(zip(was[::2], was[1::2]))) if was else got
                counts.append(len(ws))
                spans.append([x for span in got for x in span])
                items.append(sorted(ids | set(had)))
            columns = {c: part.column(i) for i, c in enumerate(names) if c not in _ADDED}
            columns |= {c: pa.array(v, t) for (c, t), v in zip(_ADDED.items(), (counts, spans, items))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = N, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, items, spans (word offsets, start and end in turn) and contaminated.

    The benchmark goes to the executors in blocks of at most about block_bytes, each from a filtered read; a
    benchmark of one block is searched in one pass, a larger one in a chain of passes without a shuffle."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).dropna()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    added = ("_n", "_spans", "_items", "n_words", "n_hit", "items", "spans", "contaminated")
    out = docs.drop(*added)
    base = out.schema
    schema = T.StructType([*base.fields, T.StructField("_n", T.LongType()), T.StructField("_spans", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.StringType()))])
    for k in range(blocks):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        block = [(r.i, r.t.encode("utf-8", "surrogatepass")) for r in rows.collect()]
        shared = spark.sparkContext.broadcast(block)
        key = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}" if shared._jbroadcast else str(id(shared))
        out = out.mapInArrow(lambda it, shared=shared, key=key: trimmed(_scan(it, shared, key, n, text)), schema)
    hit = F.aggregate(
        F.transform("_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    out = out.withColumn("n_words", F.col("_n")).withColumn("n_hit", hit).withColumn("items", F.col("_items")).withColumn("spans", F.col("_spans"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.drop("_n", "_spans", "_items")
