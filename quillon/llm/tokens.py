"""Token counts of whole texts with a public tokenizer, in Arrow functions that return lengths only.

Rows are taken in batches of about SLICE_BYTES of text, and a longer text by itself in segments of that size, so that a
worker holds a bounded part of the texts however long they are. Where the tokenizer's file says that it lower-cases and
drops white space by the known rules (FAST), texts are cut at ASCII white space, which no token joins across, so counts
of the pieces add up to the count of the text. A worker keeps the counts of pieces that it has met (at most MEMO of them;
then it starts anew); unknown pieces are joined by single spaces to batches of about BATCH_BYTES, so that batches weigh
the same however long single texts are, and are encoded together; token offsets tell the piece that a token belongs to.
Pieces of over LONG bytes are encoded by themselves and not kept. Before that, a piece loses the marks that end it if a
letter stands before them (the pre-tokenizer parts letters from marks that follow), and ASCII letters become small ones.
Any other tokenizers file, and a sentencepiece model, counts whole texts as the library does, batch by batch.

Special strings inside texts are left to the library's default.

Defined results: a null text counts as empty, of 0 bytes and 0 tokens; repeated rows are counted alike; an empty
table gives an empty result. Other columns pass through; only n_bytes, n_tokens and over_limit are replaced, unless one
of them holds the text, which is an error.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.words import raw_texts

MEMO, BATCH_BYTES, LONG, SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 15, 256, 1 << 20, 256
#: Marks that can be parted from a letter before them; no apostrophe (contractions) and none of the special strings'.
MARKS = b".,;:!?#$%&*()\""


#: The normalizer and pre-tokenizer of a tokenizers file under which pieces may be counted by themselves.
FAST = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


class Counter:
    """Counts for one tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.fast = None, False
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.fast = (rules["normalizer"], rules["pre_tokenizer"]) == FAST and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in rules["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, int] = {}

    def whole(self, texts: list[bytes]) -> list[int]:
        """Counts as the library gives them."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        if self.model is not None:
            return [len(self.model.encode(t, num_threads=1)) for t in plain]
        return [len(self.tokenizer.encode(t, add_special_tokens=False)) for t in plain]

    def encode(self, pieces: list[bytes]) -> list[int]:
        """Counts of pieces without white space, in batches balanced by bytes."""
        out: list[int] = []
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (size == 0 or size + len(pieces[end]) < BATCH_BYTES):
                size += len(pieces[end]) + 1
                end += 1
            batch = [p.decode("utf-8", "replace") for p in pieces[at:end]]
            encoding = self.tokenizer.encode_batch([" ".join(batch)], add_special_tokens=False)[0]
            starts = np.cumsum([0, *(len(p) + 1 for p in batch[:-1])])
            firsts = np.fromiter((o[0] for o in encoding.offsets), dtype=np.int64, count=len(encoding))
            out += np.bincount(np.searchsorted(starts, firsts, "right") - 1, minlength=len(batch)).tolist()
            at = end
        return out

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.fast:
            return self.whole(texts)
        if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
            return [sum(self.pieces([part])[0] for part in segments(texts[0]))]
        return self.pieces(texts)

    def pieces(self, texts: list[bytes]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        pieces = [raw.split() for raw in texts]
        unknown = {p for ps in pieces for p in ps if p not in memo}
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        cores: set[bytes] = set()
        for p in unknown:
            core = p.rstrip(MARKS)
            tail = p[len(core) :]
            if tail and core[-1:].isalpha():
                # The core may hold any bytes; only its last one, an ASCII letter, matters for the cut.
                parts[p] = (core.lower() if core.isalpha() else core, tail)
            else:
                parts[p] = (p.lower() if p.isalpha() else p, b"")
            cores.update(x for x in parts[p] if x and x not in memo)
        short = sorted(c for c in cores if len(c) <= LONG)
        local = dict(zip(short, self.encode(short)))
        memo.update(local)
        for c in cores:
            if len(c) > LONG:
                local[c] = self.encode([c])[0]
        known = lambda x: local[x] if x in local else memo[x]
        for p, (core, tail) in parts.items():
            n = known(core) + (known(tail) if tail else 0)
            if len(p) <= LONG:
                memo[p] = n
            else:
                local[p] = n
        count = known if any(len(p) > LONG for p in parts) else memo.__getitem__
        return [sum(map(count, ps)) for ps in pieces]


def segments(raw: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A long text in parts of about size bytes, cut at a space or line break."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            ends = [e for e in (raw.find(c, end) for c in (b" ", b"\n")) if e >= 0]
            end = min(ends, default=len(raw))
        yield raw[at:end]
        at = end


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of at most SLICE_ROWS rows and about SLICE_BYTES of text; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_pylist()
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (size + n > SLICE_BYTES or i - at >= SLICE_ROWS):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield batch.slice(at)


_COUNTERS: dict[str, Counter] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[pa.RecordBatch]:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    counter = _COUNTERS[path]
    for batch in batches:
        kept = [c for c in batch.schema.names if c != text]
        for part in slices(batch, text):
            texts = raw_texts(part.column(part.schema.names.index(text)))
            columns = [part.column(part.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(t) for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())], names=[*kept, "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit. path: the tokenizer's file, on every machine."""
    if text in ("n_bytes", "n_tokens", "over_limit"):
        raise ValueError("the text column's name is one of the results'")
    docs = docs.drop("n_bytes", "n_tokens", "over_limit").withColumn(text, F.col(text).cast("string"))
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = docs.mapInArrow(lambda it: _count(it, path, text), schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
