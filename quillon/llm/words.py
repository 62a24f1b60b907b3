"""Byte-level word splitting shared by the operators that run in Arrow functions."""

from __future__ import annotations

import pyarrow as pa

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: A-Z become a-z; digits, letters and every byte of a non-ASCII character stay; the rest becomes a space.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """Maximal runs of characters outside \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F, after lower-casing A-Z."""
    return raw.translate(WORD_BYTES).split()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value without decoding it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type == pa.string():
        column = column.cast(pa.binary())
    elif column.type == pa.large_string():
        column = column.cast(pa.large_binary())
    return [v or b"" for v in column.to_pylist()]
