"""Texts of an Arrow batch as flat numpy arrays: words and their hashes.

Helpers for tasks only; Spark deals out the rows and shuffles the results.
Work goes in slices of about a megabyte of text, whole documents at a time, so
that temporaries stay small however many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (fixed constants): every bit of ``x`` reaches every bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("A"):ord("Z") + 1] += 32
    return t


LOWER = lower_table()
#: 64 random bits per byte, the same for both cases of A-Z.
BYTE_BITS = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        m = max(n, SLICE_BYTES * 2)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, U64(b), U64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]



#: Bytes of words: anything but ASCII white space; or letters, digits and non-ASCII only.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; NULL texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        yield at, data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document (row of the slice) of every word."""
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    first[filled] = inside[filled]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z read as a-z."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_BITS[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def doc_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each document's words begin in the (sorted) word arrays; n_docs + 1 entries."""
    return np.searchsorted(doc, np.arange(n_docs + 1))
