"""Vectorised word work on the byte buffers of Arrow string columns.

All functions see whole texts. Memory is bounded by cutting a batch into runs of documents of about
``CHUNK`` bytes; only a single longer document makes a longer run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
WORDS_PER_SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
SHINGLE_FACTOR = _rng.integers(0, 2**64, WORDS_PER_SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Words are runs of anything but ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers[0].size < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def runs(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of runs of documents; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, texts.offset * 8)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(n, end)
        yield at, end, every[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words do not cross from one document to the next."""
    n = data.size
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    up, down = powers(data.size + 1)
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: data.size], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words of documents, A-Z lower-cased."""
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each document's sorted distinct hashes of five successive words.

    A document of fewer words has its whole sequence as its only shingle, one without words none.
    """
    hashes, rows = word_hashes(data, offsets)
    n, k = len(offsets) - 1, WORDS_PER_SHINGLE
    bounds = np.searchsorted(rows, np.arange(n + 1))
    m = max(0, hashes.size - k + 1)
    rolled = np.full(m, k, np.uint64)
    for i in range(k):
        rolled += hashes[i : i + m] * SHINGLE_FACTOR[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(rolled[a : b - k + 1])
            keep = np.empty(x.size, bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            x = (hashes[a:b] * SHINGLE_FACTOR[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
