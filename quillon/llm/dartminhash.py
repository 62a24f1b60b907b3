"""MinHash near-duplicate classes by DartMinHash signatures and banded joining.

A document is the weighted set of its word 5-shingles (lower-cased A-Z, runs of digits, letters and non-ASCII
characters; a text of fewer words, but not none, is one shingle); a shingle's weight is the times it occurs.
Every unit of weight of a shingle is a region of a dart board that reaches up in rank without end. Darts fall on
it as a Poisson process of rate one that only the region's hash decides, so equal regions get equal darts in all
documents. A document keeps darts of rank under t / (its weight), about t of them however long it is. A hash deals
the darts out over k coordinates and the earliest dart of each stays; a document that leaves a coordinate empty
throws again up to twice the rank. Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity.

Bands of r coordinates give buckets. In every bucket all members first meet its two leaders (the least
id and the least in an order hashed anew for each band); an exact comparison of the shingle regions confirms a link,
and the confirmed links' connected components are provisional classes. Then the members of buckets that still hold
several classes meet by an exact prefix filter: with every text's regions in one order, the rarest first, two texts of
the similarity share one among their first few regions, so each such region lists its texts. One pair for every two
classes, from a list's few leaders, is confirmed first and joins classes that many links connect; what is then of
different classes meets in its lists, in pairs of blocks of BLOCK members. So any two texts that share a bucket have met
or share a class; the components of all links are the classes. Of all pairs that meet only those go to the exact
comparison whose sizes, parities and places in the order leave the similarity possible: two sets differ in at least as
many regions as their parity bits do, so no link is lost. Documents of equal text are one node from the start, by a
digest of the text.

Defined results: a null or blank text is alone in its class; texts without words that are equal share a class;
rows of null id take part, and the class id is the least id of the class that isn't null (null if there is none);
repeated rows get the same class; an empty table gives an empty result. Other columns pass through untouched,
whatever their names; only class_id, class_links and is_kept are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.components import components
from quillon.scratch import cut
from quillon.llm.memory import relieve, trimmed
from quillon.llm.words import WORD_BYTES, raw_texts

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 24, 4, 0.8
#: UTF-8 bytes that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Links to one leader that share a task, and the leaders of more that are joined by broadcast.
PER_SALT, BROADCAST_HOT = 500, 100_000
#: Rows of some 50 bytes (nodes, pairs, nodes' classes) that are joined to larger ones by broadcast; more of them by a shuffle.
BROADCAST_WANTED = 200_000
#: Members of a list that are compared with those of another block in one key of a join.
BLOCK = 1024
#: Counters by which regions are ordered, and how many of them stand in a row of a table.
SLOTS, SLOT_ROW = 1 << 20, 4096
#: Regions that one vectorised step puts in order; a text of more is a step of its own.
STEP_REGIONS = 1 << 18
#: 64-bit words of parities: a bit says whether an odd number of the text's regions fall on it.
PARITIES = 16

_U = np.uint64
_P = 0x9E3779B97F4A7C55  # odd, so powers have inverses modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20231).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if base not in cache or len(cache[base]) < n:
        size = max(n, 2 * STEP_BYTES)
        steps = np.full(size, _U(base), dtype=np.uint64)
        steps[0] = _U(1)
        cache[base] = np.cumprod(steps)
    return cache[base][:n]


def token_hashes(buffer: np.ndarray) -> np.ndarray:
    """A hash of each of the tokens that single spaces part."""
    ends = np.append(np.flatnonzero(buffer == 32), len(buffer))
    starts = np.append(0, ends[:-1] + 1)
    sums = np.append(_U(0), np.cumsum(_BYTE[buffer] * _powers(len(buffer), _P)))
    return mix((sums[ends] - sums[starts]) * _powers(len(buffer), _PINV)[starts])


def shingle_cells(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the unit regions of all texts, the text each belongs to, and the regions per text."""
    token_lists = [raw.translate(WORD_BYTES).split() for raw in texts]
    counts = np.array([len(ws) for ws in token_lists], dtype=np.int64)
    if not counts.sum():
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    buffer = np.frombuffer(b" ".join(b" ".join(ws) for ws in token_lists if ws), dtype=np.uint8)
    del token_lists
    ends = np.append(np.flatnonzero(buffer == 32), len(buffer))
    starts = np.append(0, ends[:-1] + 1)
    sums = np.append(_U(0), np.cumsum(_BYTE[buffer] * _powers(len(buffer), _P)))
    per_doc = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), per_doc)
    first_word = np.append(0, np.cumsum(counts)[:-1])
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    left = first_word[doc] + nth
    right = left + np.minimum(counts, width)[doc] - 1
    shingles = mix((sums[ends[right]] - sums[starts[left]]) * _powers(len(buffer), _PINV)[starts[left]])
    order = np.lexsort((shingles, doc))
    sorted_doc, sorted_shingle = doc[order], shingles[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (sorted_doc[1:] != sorted_doc[:-1]) | (sorted_shingle[1:] != sorted_shingle[:-1])
    at = np.arange(len(order))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(sorted_shingle + copy.astype(np.uint64) * _U(0xD1342543DE82EF95)), sorted_doc, per_doc


def dart_signatures(cells: np.ndarray, doc: np.ndarray, weight: np.ndarray, k: int, share: np.ndarray | None = None) -> np.ndarray:
    """(documents x k) earliest darts; share: the filled part of each unit region, for weights that aren't whole.

    Rows of documents without a region are all ones."""
    n = len(weight)
    none = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, k), none, dtype=np.uint64)
    todo, t = weight > 0, k * (math.log(k) + 2.5)
    limit = np.divide(t, weight, out=np.zeros(n), where=weight > 0)
    while todo.any():
        alive = np.flatnonzero(todo[doc])
        rank, nth = np.zeros(len(alive)), 1
        flat = out.reshape(-1)
        while len(alive):
            h = mix(cells[alive] + _U(nth * 0xA0761D6478BD642F % (1 << 64)))
            rank = rank - np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            keep = rank < limit[doc[alive]]
            alive, rank, h = alive[keep], rank[keep], h[keep]
            dart = mix(h ^ _U(0x589965CC75374CC3))
            hit = np.ones(len(alive), bool) if share is None else (mix(h + _U(0x1D8E4E27C47D124F)) >> _U(11)) * 2.0**-53 < share[alive]
            key = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (dart >> _U(32))
            place = doc[alive] * k + (dart & _U(0xFFFFFFFF)).astype(np.int64) % k
            np.minimum.at(flat, place[hit], key[hit])
            nth += 1
        todo = (weight > 0) & (out == none).any(axis=1)
        limit = limit * 2
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix(out ^ signatures[:, r::rows][:, :bands] + _U(r + 1))
    return out.view(np.int64)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about STEP_BYTES of text."""
    texts = raw_texts(batch.column(batch.schema.names.index("text")))
    at, size = 0, 0
    for i, raw in enumerate(texts):
        if size and (size + len(raw) > STEP_BYTES or i - at >= 1024):
            yield batch.slice(at, i - at), texts[at:i]
            at, size = i, 0
        size += len(raw)
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def parities(cells: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n x PARITIES) parity bits of each text's regions."""
    out = np.zeros((n, PARITIES), dtype=np.uint64)
    bit = cells >> _U(32)
    place = doc * PARITIES + ((bit >> _U(6)) % _U(PARITIES)).astype(np.int64)
    np.bitwise_xor.at(out.reshape(-1), place, _U(1) << (bit & _U(63)))
    return out


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(values, kind))


def _sketch(batches: Iterator[pa.RecordBatch], bands: int, rows: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _steps(batch):
            cells, doc, weight = shingle_cells(texts, width)
            hashes = band_hashes(dart_signatures(cells, doc, weight, bands * rows), bands, rows)
            lists = _lists(hashes[weight > 0].reshape(-1), np.where(weight > 0, bands, 0), pa.int64())
            odd = _lists(parities(cells, doc, len(texts)).view(np.int64).reshape(-1), np.full(len(texts), PARITIES), pa.int64())
            regions = _lists((cells >> _U(32)).astype(np.uint32).view(np.int32), weight, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(weight, pa.int64()), odd, regions], names=["id", "digest", "bands", "weight", "odd", "cells"])


def _slot(cells: np.ndarray) -> np.ndarray:
    return (cells.view(np.uint32) % np.uint32(SLOTS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row numbers and counters (SLOT_ROW of 64 bits) of how many of the batches' regions fall on each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        counts += np.bincount(_slot(batch.column(0).flatten().to_numpy()), minlength=SLOTS)
    table = counts.reshape(-1, SLOT_ROW) if SLOTS >= SLOT_ROW else counts.reshape(1, -1)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([table[k].tobytes() for k in used], pa.binary())], names=["row", "counts"])


def _summed(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(raw, np.int64) for raw in rows.column("counts").to_pylist()], axis=0)
    return pa.table({"row": rows.column("row").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def slot_counts(regions: DataFrame, n: int) -> np.ndarray:
    """How many regions of n rows' cells fall on each slot; of a fixed size, whatever the corpus."""
    out = np.zeros((SLOTS // SLOT_ROW, SLOT_ROW), np.uint32)
    rows = regions.select("cells").coalesce(_files(n, 20_000)).mapInArrow(_slots, "row int, counts binary")
    for row in rows.groupBy("row").applyInArrow(_summed, "row int, counts binary").toLocalIterator():
        out[row["row"]] = np.minimum(np.frombuffer(row["counts"], np.int64), 0xFFFFFFFF)
    return out.reshape(-1)


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """node, class, size and place of each text for each of its first regions, the rarest slots' first.

    A text of n regions needs n - ceil(similarity * n) + 1 of them: a partner has at least similarity * n in common."""
    for whole in batches:
        lengths = whole.column(2).value_lengths().to_numpy().astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_REGIONS, "right")))
            batch = whole.slice(at, until - at)
            cells = batch.column(2).flatten().to_numpy()
            doc = np.repeat(np.arange(until - at), lengths[at:until])
            order = np.lexsort((cells, counts[_slot(cells)], doc))
            doc, cells = doc[order], cells[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (cells[1:] != cells[:-1])
            doc, cells = doc[new], cells[new]
            size = np.bincount(doc, minlength=until - at)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            first = place <= (size - np.ceil(similarity * size - 1e-6).astype(np.int64))[doc]
            doc, cells, place = doc[first], cells[first], place[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int32()), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(size[doc], pa.int32()), pa.array(place, pa.int32())],
                names=["region", "node", "class", "size", "place"],
            )
            at = until


def _files(rows: int, each: int = 250_000) -> int:
    """Files of a table of at most so many rows, or made by a join with a table of so many."""
    return max(1, -(-rows // each))


def _nodes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, digest of the text (null if blank), text."""
    t = F.col(text).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.when(~_blank(text), F.unhex(F.md5(t))).alias("digest"), t.alias("text"))


#: Rows of null id stand under numbers below all that are likely to be ids.
_NO_ID = -(1 << 62)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    width: int = SHINGLE,
) -> tuple[DataFrame, DataFrame]:
    """Two tables. Rows: id and digest for each row (null for a blank text). Texts: digest, node, class_id, links for each
    distinct text, a node, which is named by its least id; the class of a node without a link is itself."""
    source = _nodes(docs, id_col, text)
    schema = "id long, digest binary, bands array<long>, weight long, odd array<long>, cells array<int>"
    sketches = cut(source.mapInArrow(lambda it: trimmed(_sketch(it, bands, rows, width)), schema), "sketches")
    stand_in = F.lit(_NO_ID) - F.pmod(F.xxhash64("digest"), F.lit(1 << 60))
    texts = sketches.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.coalesce(F.min("id"), stand_in).alias("node"), F.max("bands").alias("bands"), F.max("weight").alias("weight"), F.max("odd").alias("odd")
    )
    texts = cut(texts, "texts")
    n = texts.count()
    buckets = texts.select("node", F.posexplode("bands").alias("band", "bucket"))
    # Two least values, of the node and of the node under a key of the band, aggregate by hash and without a sort.
    key = F.xxhash64("band")
    leaders = buckets.groupBy("band", "bucket").agg(F.min("node").alias("least"), F.min(F.col("node").bitwiseXOR(key)).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    leaders = cut(leaders.select("band", "bucket", "size", F.array_distinct(F.array("least", F.col("first").bitwiseXOR(key))).alias("leads")), "leaders", _files(n * bands))
    relieve(docs.sparkSession)
    # Both sides grow with the corpus: the join is a merge at every size.
    members = cut(buckets.join(leaders.hint("merge"), ["band", "bucket"]), "members", _files(n * bands))
    pairs = members.select("node", F.explode("leads").alias("lead")).where("node <> lead")
    pairs = cut(pairs.groupBy(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).agg(F.min("lead").alias("lead")), "pairs", _files(2 * members.count()))
    pairs = cut(possible(texts, salted(pairs), similarity), "possible", _files(max(n, pairs.count()), 25_000))
    links = confirmed(sketches, texts, pairs, similarity)
    found = components(links)
    relieve(docs.sparkSession)
    apart = apart_texts(sketches, texts, members, found)
    if not apart.isEmpty():
        lists = region_lists(apart, similarity)
        relieve(docs.sparkSession)
        led = cut(led_pairs(lists, similarity).join(pairs, ["a", "b"], "left_anti").withColumn("lead", F.col("a")), "led", files := _files(apart.count(), 50_000))
        if not led.isEmpty():
            more = confirmed(apart, texts, salted(led), similarity)
            links, found = links.unionByName(more), components(_spokes(found).unionByName(more))
        relieve(docs.sparkSession)
        met = pairs.select("a", "b").unionByName(led.select("a", "b"))
        rest = cut(across_classes(lists, found, similarity, files).join(met, ["a", "b"], "left_anti").withColumn("lead", F.col("a")), "rest")
        if not rest.isEmpty():
            more = confirmed(apart, texts, salted(rest), similarity)
            links, found = links.unionByName(more), components(_spokes(found).unionByName(more))
    relieve(docs.sparkSession)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    classes = texts.select("digest", "node").join(found, "node", "left").join(degree, "node", "left")
    return sketches.select("id", "digest"), cut(classes.select("digest", "node", F.coalesce("root", "node").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "classes", _files(n, 50_000))


def _light(rows: DataFrame) -> DataFrame:
    """rows, whose partner in a join then isn't shuffled if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_WANTED else rows


def _spokes(found: DataFrame) -> DataFrame:
    """Links that give the same classes."""
    return found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def apart_texts(sketches: DataFrame, texts: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes that share a bucket with one of another class that they may not have met, with class and regions.

    A bucket's leaders have met all its members before."""
    members = members.where("size > 3 or size > size(leads) + 1").where(~F.array_contains("leads", F.col("node")))
    files = _files(max(texts.count(), members.count()), 50_000)
    members = cut(members.join(_light(found), "node", "left").select("node", "band", "bucket", F.coalesce("root", "node").alias("class")), "classed", files)
    open_ = members.groupBy("band", "bucket").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1")
    wanted = members.join(open_, ["band", "bucket"]).select("node", "class").distinct()
    return _regions(sketches, texts, cut(wanted, "apart", files), files, "class", "weight", "odd")


def region_lists(apart: DataFrame, similarity: float) -> DataFrame:
    """A row for each text and each of its first regions, of the regions that texts of several classes have first."""
    n = apart.count()
    counts = apart.sparkSession.sparkContext.broadcast(slot_counts(apart, n))
    schema = "region int, node long, class long, size int, place int"
    prefixes = apart.select("node", "class", "cells").mapInArrow(lambda it: trimmed(_prefixes(it, counts.value, similarity)), schema)
    prefixes = cut(prefixes, "prefixes", _files(n, 5_000))
    open_ = prefixes.groupBy("region").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1")
    open_ = cut(open_.select("region"), "open", _files(n, 5_000))
    return cut(prefixes.join(_light(open_), "region").join(apart.select("node", "weight", "odd"), "node"), "lists", _files(n, 5_000))


def led_pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """For every two classes of which one leads a list with the other, their likeliest pair of a leader and a member."""
    leader = F.struct(F.col("class").alias("cy"), F.col("node").alias("y"), F.col("size").alias("sy"), F.col("place").alias("py"), F.col("weight").alias("wy"), F.col("odd").alias("oy"))
    some = F.struct(F.xxhash64("class").alias("h"), leader.alias("of"))
    leads = lists.groupBy("region").agg(F.min(leader).alias("l0"), F.max(leader).alias("l1"), F.min(some).alias("l2"))
    leads = leads.select("region", F.explode(F.array_distinct(F.array("l0", "l1", "l2.of"))).alias("l")).select("region", "l.*")
    both = _one_side(lists).join(leads, "region").where("cx <> cy").where(_fits(similarity)).where(_early(similarity))
    best = both.groupBy(F.least("cx", "cy"), F.greatest("cx", "cy")).agg(F.min(F.struct(_differ(), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).alias("p"))
    return best.select("p.a", "p.b")


def across_classes(lists: DataFrame, found: DataFrame, similarity: float, files: int) -> DataFrame:
    """The pairs of nodes that share a list, aren't of one class yet and whose sizes, parities and places allow the similarity.

    A list's members are dealt to blocks, and every two blocks are a key of their own, so that no task holds a whole list."""
    lists = lists.drop("class").join(_light(found), "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    lists = cut(lists, "reclassed", files)
    open_ = lists.groupBy("region").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("c0 <> c1")
    open_ = cut(open_.select("region", "blocks"), "open", files)
    dealt = lists.join(_light(open_), "region").withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = cut(dealt, "dealt", files)
    dealt = dealt.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Both sides are the same rows by the same keys, so that one shuffle serves them.
    key = [F.least("k", "m").alias("i"), F.greatest("k", "m").alias("j")]
    left, right = _one_side(dealt, *key, F.col("k").alias("kx")), _one_side(dealt, *key, F.col("k").alias("ky"), side="y")
    both = left.join(right, ["region", "i", "j"]).where("(kx < ky or kx = ky and x < y) and cx <> cy").where(_fits(similarity)).where(_early(similarity))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _one_side(lists: DataFrame, *more, side: str = "x") -> DataFrame:
    names = {"node": side, "class": f"c{side}", "size": f"s{side}", "place": f"p{side}", "weight": f"w{side}", "odd": f"o{side}"}
    return lists.select("region", *more, *[F.col(c).alias(name) for c, name in names.items()])


def _early(similarity: float):
    """Whether a region at places px, py of texts of sx, sy regions may be the first that texts of the similarity share."""
    same = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("sx") + F.col("sy")) - 1e-6)
    return (F.col("px") <= F.col("sx") - same) & (F.col("py") <= F.col("sy") - same)


def _differ():
    """Parity bits in which two texts differ."""
    return sum((F.bit_count(F.get("ox", F.lit(i)).bitwiseXOR(F.get("oy", F.lit(i)))) for i in range(PARITIES)), F.lit(0))


def _fits(similarity: float):
    """Whether sizes wx, wy and parities ox, oy of two texts leave the similarity possible."""
    fits = F.least("wx", "wy") >= F.floor(F.lit(similarity) * F.greatest("wx", "wy"))
    # A similarity of s leaves at most (1 - s) / (1 + s) of both sizes to regions of one text only; one more for rounding.
    return fits & (_differ() <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("wx") + F.col("wy")) + 1)


def salted(pairs: DataFrame) -> DataFrame:
    """a, b, lead, other, salt. A pair's lead may stand in very many pairs: a salt is for about PER_SALT of them. The
    other node is a member that meets at most two leaders for each of its buckets."""
    files = _files(pairs.count())
    hot = cut(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PER_SALT), "hot", files)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot
    other = F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    out = pairs.join(hot, "lead", "left").select("a", "b", "lead", other.alias("other"), F.ceil(F.coalesce("n", F.lit(1)) / PER_SALT).alias("salts"))
    return cut(out.withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts"))).drop("salts"), "salted", files)


def _beside(pairs: DataFrame, values: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Salted pairs with values' columns (a row a node) under two names each, of the lead and of the other node."""
    lead = [F.col(c).alias(x) for c, (x, _) in columns.items()]
    other = [F.col(c).alias(y) for c, (_, y) in columns.items()]
    few = pairs.count() <= BROADCAST_WANTED
    heads = pairs.select("lead", "salt").distinct()
    left = (F.broadcast(heads) if few else heads).join(values, F.col("lead") == F.col("node")).select("lead", "salt", *lead)
    right = (F.broadcast(pairs) if few else pairs).join(values, F.col("other") == F.col("node")).select("a", "b", "lead", "other", "salt", *other)
    return right.join(left, ["lead", "salt"])


def possible(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The salted pairs whose sizes and parities leave the similarity possible."""
    both = _beside(pairs, texts.select("node", "weight", "odd"), {"weight": ("wx", "wy"), "odd": ("ox", "oy")})
    return both.where(_fits(similarity)).select(*pairs.columns)


def _regions(sketches: DataFrame, texts: DataFrame, wanted: DataFrame, files: int, *carry: str) -> DataFrame:
    """node, digest, id, regions and the columns to carry, of wanted or texts, for each wanted node."""
    own = [c for c in carry if c not in wanted.columns]
    first = texts.select("node", F.col("digest").alias("d"), *own).join(wanted, "node").withColumn("rep", F.when(F.col("node") > _NO_ID, F.col("node")))
    first = cut(first, "wanted", files)
    n = first.count()
    first = F.broadcast(first) if n <= BROADCAST_WANTED else first
    rows = sketches.where(F.col("digest").isNotNull()).select("digest", "id", "cells")
    cells = rows.join(first, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("rep")))
    # A repeated row stands more than once; one of them is enough, and such rows are equal.
    return cut(cells.groupBy("node", "digest", "id").agg(*[F.max(c).alias(c) for c in ("cells", *carry)]), "regions", _files(n, 5_000))


def confirmed(sketches: DataFrame, texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The salted pairs of nodes whose regions have a Jaccard similarity of at least the given one.

    No text is read again: the first pass wrote the regions, and only those of nodes in a pair are joined."""
    n = pairs.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cells = _regions(sketches, texts, wanted, _files(max(texts.count(), 2 * n), 50_000))
    both = _beside(pairs, cells, {"cells": ("ca", "cb")})
    # Sizes alone rule many pairs out: similarity is at most the smaller over the larger.
    same = F.size(F.array_intersect("ca", "cb"))
    union = F.size(F.array_distinct("ca")) + F.size(F.array_distinct("cb")) - same
    fits = F.least(F.size("ca"), F.size("cb")) >= F.floor(F.lit(similarity) * F.greatest(F.size("ca"), F.size("cb")))
    return cut(both.where(fits).where(same >= F.lit(similarity) * union - 1e-9).select("a", "b"), "links", _files(n, 2_000))


def dedup_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per row of docs: id, class_id and the confirmed links of its text (to leaders, and across classes)."""
    rows, texts = near_duplicates(docs, id_col, text, **options)
    # A class named by a stand-in has another, real name if any of its ids is known; that is its least real id.
    named = texts.where(F.col("class_id") <= _NO_ID).where(F.col("node") > _NO_ID).groupBy(F.col("class_id").alias("stand_in")).agg(F.min("node").alias("name"))
    texts = texts.join(named, F.col("class_id") == F.col("stand_in"), "left")
    name = F.coalesce("name", F.when(F.col("class_id") > _NO_ID, F.col("class_id")))
    out = rows.join(texts.select("digest", name.alias("class_id"), "links"), "digest", "left")
    class_id = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without all but one document of each class: that of the least id stays; blank texts all stay."""
    _, texts = near_duplicates(docs, id_col, text, **options)
    best = texts.groupBy("class_id").agg(F.min(F.struct((F.col("node") <= _NO_ID).alias("unknown"), F.col("node").alias("node"), F.col("digest").alias("digest"))).alias("best"))
    keepers = best.select(F.when(~F.col("best.unknown"), F.col("best.node")).alias("_id"), F.col("best.digest").alias("_digest"), F.lit(True).alias("_keep"))
    rows = docs.where(~_blank(text)).withColumn("_d", F.unhex(F.md5(F.col(text).cast("string"))))
    joined = rows.join(keepers, (F.col("_d") == F.col("_digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("_id")), "left")
    first = Window.partitionBy("_d", id_col).orderBy(F.lit(0))
    kept = joined.where(F.col("_keep")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select(*docs.columns).unionByName(docs.where(_blank(text)))


def _blank(text: str):
    t = F.col(text).cast("string")
    return F.coalesce(F.trim(F.translate(t, "\t\n\u000b\f\r", "     ")) == "", F.lit(True))
