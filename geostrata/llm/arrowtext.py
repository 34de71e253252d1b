"""Texts of Arrow batches as flat byte arrays, and vectorised words and hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4_000_000


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), off


def chunks(data: np.ndarray, off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about most bytes; a longer text is alone."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: Lower-cases A-Z and maps the six white-space bytes to 0x20.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32
BYTE_VALUE = table64(256, 11)
PLACE_VALUE = table64(4096, 23)


class Words:
    """Words (runs of other than ASCII white space, A-Z lower-cased) of concatenated texts.

    data: folded bytes; start, end: byte ranges of words; row: text of each word;
    first: index of each text's first word, with the end; hash: 64-bit hashes.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data = data = FOLD[data]
        n = len(data)
        inside = data != 32
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        begins = inside & (~before | edge[:-1])
        self.start = np.flatnonzero(begins)
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(off) - 1), self.count)
        length = self.end - self.start
        if len(self.start):
            at = np.flatnonzero(inside)
            place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
            value = BYTE_VALUE[data[at]] * PLACE_VALUE[place & 4095]
            long = place > 4095
            if long.any():
                value[long] = mix64(value[long] + (place[long] >> 12).astype(np.uint64) * BYTE_VALUE[7])
            total = np.add.reduceat(value, np.cumsum(length) - length)
            self.hash = mix64(total + length.astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A string array of byte ranges."""
    length = end - start
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=off[1:])
    at = np.repeat(start - off[:-1], length) + np.arange(off[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[at])))
