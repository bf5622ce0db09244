"""Vectorised text kernels over Arrow string columns.

Texts of a batch are worked on as one byte buffer, in blocks of a few
megabytes, so that memory follows the block and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer text is a block of its own).
BLOCK = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the one of the public SplitMix64 generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random value for each byte, from a counter.
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
#: The same with A-Z as a-z.
FOLDED = TABLE.copy()
FOLDED[65:91] = TABLE[97:123]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Letters, digits and all bytes of characters outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number of the first text, bytes and offsets of each block; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that don't cross texts, and each text's first run."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Running polynomial sums, from which any segment's hash follows."""
    powers, _ = _grown(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers[: len(data)], out=out[1:])
    return out


def segment_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _grown(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Segments above this many bytes get a cryptographic hash: sums of powers modulo 2^64 can be made to meet in long texts.
LONG = 128


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = TABLE, folded: np.ndarray | None = None) -> np.ndarray:
    """Hash of each segment; ``folded`` are the bytes that count, where these are not ``data`` itself."""
    out = segment_hash(prefix_hash(data, table), starts, ends)
    at = np.flatnonzero(ends - starts > LONG)
    if len(at):
        body = (data if folded is None else folded).tobytes()
        out[at] = [int.from_bytes(hashlib.blake2b(body[starts[i] : ends[i]], digest_size=8).digest(), "little") for i in at]
    return out


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` and from ``b`` are the same, for each pair."""
    out = np.ones(len(a), bool)
    some = np.flatnonzero(size)
    for part in np.array_split(some, max(1, int(size.sum()) // BLOCK)) if len(some) else ():
        if not len(part):
            continue
        n = size[part]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        step = np.arange(n.sum()) - np.repeat(first, n)
        same = data[np.repeat(a[part], n) + step] == data[np.repeat(b[part], n) + step]
        out[part] = np.logical_and.reduceat(same, first)
    return out


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _U(_BASE) + h[j : j + n]
    return mix(out)


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def in_text(first: np.ndarray) -> np.ndarray:
    """The text that each run belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def small_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches that hold about one block, with the bytes and offsets of ``column``."""
    for batch in batches:
        for at, data, offsets in blocks(batch.column(column)):
            yield batch.slice(at, len(offsets) - 1), data, offsets
