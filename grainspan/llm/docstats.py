"""Statistics of whole documents, from one vectorised scan of their bytes.

They describe form, not topic: shares of kinds of characters, lengths and spread of words and lines, and
repetition. Language, source and id play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, mix, runs, span_hashes, word_bounds

NAMES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "short_words", "upper", "lower", "digit", "space", "high", "pipe", "marks", "symbols",
    "brackets", "commas", "stops", "quotes", "caps_words", "title_words", "symbol_words", "digit_words", "pure_symbol_words", "same_as_previous", "distinct_words",
    "top_word", "distinct_pairs", "lines", "mean_line", "line_end_stop", "distinct_lines", "repeated_line_share",
)

_CLASSES = np.zeros((256, 11), bool)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\x0b\x0c", "", "|", "!?", "#$%&*+=<>@^_~\\/", "()[]{}", ",;:", ".")):
    _CLASSES[[ord(c) for c in _chars], _k] = True
_CLASSES[0x80:, 4] = True
_QUOTES = np.zeros(256, bool)
_QUOTES[[ord(c) for c in "\"'`-"]] = True
_SYMBOL = _CLASSES[:, 5] | _CLASSES[:, 6] | _CLASSES[:, 7]


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(flags.size + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: distinct values, the largest count of one, and how many stand in values that repeat."""
    key = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)))
    if not key.size:
        z = np.zeros(n, np.int64)
        return z, z, z
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(first, key.size))
    row = (key[first] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row, counts)
    return np.bincount(row, minlength=n), top, np.bincount(row, np.where(counts > 1, counts, 0), minlength=n).astype(np.int64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, len(NAMES)) floats; an empty document has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    starts, ends, rows = word_bounds(data, offsets)
    bounds = np.searchsorted(rows, np.arange(n + 1))
    words = np.diff(bounds)
    per = np.maximum(words, 1)
    length = ends - starts
    mean = _sums(length, bounds) / per
    sd = np.sqrt(np.maximum(0, _sums(length * length, bounds) / per - mean**2))
    shares = [_sums(_CLASSES[:, k][data], offsets) / some for k in range(11)]
    quotes = _sums(_QUOTES[data], offsets) / some

    def inside(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(data.size + 1, np.int64)
        np.cumsum(flag[data], out=total[1:])
        return total[ends] - total[starts]

    upper, lower, digit, symbol = inside(_CLASSES[:, 0]), inside(_CLASSES[:, 1]), inside(_CLASSES[:, 2]), inside(_SYMBOL)
    first_upper = _CLASSES[:, 0][data[starts]] if starts.size else np.zeros(0, bool)
    share = lambda flags: _sums(flags, bounds) / per
    hashes = span_hashes(LOWER[data], starts, ends)
    again = np.zeros(hashes.size, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    distinct, top, _ = _distinct(rows, hashes, n)
    next_to = np.flatnonzero(rows[1:] == rows[:-1])
    pairs = mix(hashes[next_to] * np.uint64(3) + hashes[next_to + 1])
    distinct_pairs, _, _ = _distinct(rows[next_to], pairs, n)
    # Lines: stretches between newlines.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    line_starts = line_starts[line_starts < data.size]
    line_rows = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], data.size), offsets[line_rows + 1])
    filled = line_ends - (data[np.maximum(line_ends - 1, 0)] == 10) if line_starts.size else line_ends
    keep = filled > line_starts
    line_starts, filled, line_rows = line_starts[keep], filled[keep], line_rows[keep]
    lines = np.bincount(line_rows, minlength=n)
    per_line = np.maximum(lines, 1)
    stop = np.isin(data[filled - 1], [ord(c) for c in ".!?"]) if filled.size else np.zeros(0, bool)
    distinct_lines, _, repeated = _distinct(line_rows, span_hashes(data, line_starts, filled), n)
    cols = [
        np.log1p(size), np.log1p(words), mean, sd, share(length > 15), share(length < 3), *shares, quotes, share((upper > 1) & (lower == 0)), share(first_upper & (lower > 0)),
        share(symbol > 0), share(digit > 0), share(symbol == length), share(again), distinct / per, top / per, distinct_pairs / np.maximum(words - 1, 1), np.log1p(lines),
        np.log1p(size / per_line), np.bincount(line_rows, stop, minlength=n) / per_line, distinct_lines / per_line, repeated / per_line,
    ]
    out = np.stack([np.asarray(c, np.float64) for c in cols], 1)
    out[size == 0] = 0
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats, an array in the order of NAMES, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in runs(batch.column(1)):
                stats = statistics(data, offsets)
                where = pa.array(np.arange(0, stats.size + 1, len(NAMES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(where, pa.array(stats.ravel()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")
