"""Vectorised hashing of words and word shingles over Arrow string buffers.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased. Words are identified by a
64-bit polynomial hash over random byte values, finished with a mixing step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; longer texts are cut at white space.
BLOCK = 1 << 18
U64 = np.uint64
_MULT = 0x9E6C63D0876A9A35
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that isn't used any more back to the system: Python workers outlive their tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable, every: int = 8) -> Callable:
    """``run`` over Arrow batches, releasing memory every so many of them and at the end."""

    def counted(batches):
        for k, batch in enumerate(batches, 1):
            yield batch
            if k % every == 0:
                release()

    @wraps(run)
    def inner(batches):
        try:
            yield from run(counted(batches))
        finally:
            release()

    return inner


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` over the Arrow table of a group, releasing what it needed if that was much."""

    def inner(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > 1 << 22:
            release()
        return out

    return inner


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a public multiplicative hash)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h = h * U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK) + 1024
        for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words of texts whose offsets in ``data`` are ``bounds``."""
    low = _LOWER[data]
    gap = _SPACE[low]
    before, after = np.ones(len(low), dtype=bool), np.ones(len(low), dtype=bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = bounds[(bounds > 0) & (bounds < len(low))]
    before[inner] = True
    after[inner - 1] = True
    word = ~gap
    return low, np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte range [start, end) of ``low``."""
    up, down = _power(len(low) + 1)
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[low] * up[: len(low)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def _one(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, block by block."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):  # back to white space, or on to the next if a word fills the block
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(data), end + BLOCK)
        low, s, e = spans(data[at:end], np.array([0, end - at]))
        parts.append(span_hashes(low, s, e))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def runs(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, offsets of the rows' words), a run of rows at a time."""
    data, offsets = buffers(column)
    for i, j in runs(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j == i + 1 and hi - lo > BLOCK:
            h = _one(data[lo:hi])
            yield i, j, h, np.array([0, len(h)])
            continue
        bounds = offsets[i : j + 1] - lo
        low, s, e = spans(data[lo:hi], bounds)
        h = span_hashes(low, s, e) if len(s) else np.zeros(0, dtype=np.uint64)
        yield i, j, h, np.searchsorted(s, bounds)


def shingle_sets(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, laid end to end, and their offsets.

    A text with fewer words than ``width`` has its whole sequence as one shingle; one without words, none.
    """
    counts = np.diff(offsets)
    total = len(words)
    if not total:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(counts) + 1, dtype=np.int64)
    padded = np.concatenate([words, np.zeros(width, dtype=np.uint64)])
    own = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(total) - offsets[:-1][own]
    left = counts[own] - place
    h = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        h = h * U64(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : total + k], U64(k + 1))
        h ^= h >> U64(31)
    keep = (left >= width) | ((place == 0) & (counts[own] < width))
    h, own = mix(h[keep]), own[keep]
    edges = np.searchsorted(own, np.arange(len(counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        h[a:b].sort()
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    sums = np.zeros(len(h) + 1, dtype=np.int64)
    np.cumsum(first, out=sums[1:])
    return h[first], sums[edges]
