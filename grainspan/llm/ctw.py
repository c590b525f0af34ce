"""Language-model scoring by context-tree weighting over bytes.

A text is its UTF-8 bytes, A-Z lower-cased, then an end mark (0xFF, which UTF-8 never has); DEPTH such marks
stand before it. Each byte is decomposed into eight binary decisions, high bit first. For each of the 255
nodes of that decomposition there is a context tree over the bytes before: a node at depth d holds the
zeros and ones seen after its d bytes, its Krichevsky-Trofimov block probability Pe, and the weighted
probability Pw = Pe at full depth, else (Pe + product of the children's Pw) / 2. A decision is coded with the
mixture of the KT estimates of all depths along its context, the weight of stopping at a depth being
Pe / 2 / Pw. Contexts that training never showed end the path: the last seen depth takes the rest of the weight,
so that the eight decisions always make a proper distribution over bytes.

Training gathers exact counts of all (context, byte) strings of all training texts, first within each task,
then by key. The trees of all contexts that end in the same two bytes are built in one group, whose size is
a number of distinct strings and not of occurrences; depths 1 and 0 are built from their sums, at most 65,535
rows.

Scoring needs the model beside every text. The model is cut into blocks by the two bytes before the predicted
one, each of at most ``BLOCK_ROWS`` rows (some 100 MB of memory) or of one such pair of bytes; texts are scanned once for each block and
the partial sums added, so that a model of any size is used whole. All probabilities are doubles.

The word baseline works likewise: counts of all distinct training words, in blocks of 64-bit hashes.

Defined results: a null text counts as empty and has only the end mark; rows that repeat are scored each and
count as training each time; a null doc_id is held out by the crc32 of an empty text; without any training
text every decision costs one bit. Further columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .textkit import LOWER, runs, word_hashes

DEPTH = 5
END = 0xFF
#: Rows of one block of the model.
BLOCK_ROWS = 6_000_000
#: Distinct strings that a task holds before it passes them on.
HELD = 1_000_000
SCAN_BYTES = 1 << 20
WORD_END = np.uint64(0x656E645F6F665F74)  # stands for the end token among word hashes

_U = np.uint64
_HALF_LOG_PI = 0.5 * np.log(np.pi)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each position's last ``depth`` bytes and its own, packed with the own byte lowest; and where each
    document's positions begin."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    wide = offsets + np.arange(n + 1) * (depth + 1)
    padded = np.full(int(wide[-1]), END, np.uint8)
    padded[np.arange(data.size) + np.repeat(np.arange(n) * (depth + 1) + depth, size)] = LOWER[data]
    key = padded.astype(_U)
    for i in range(1, depth + 1):
        key[i:] |= padded[:-i].astype(_U) << _U(8 * i)
    keep = np.ones(padded.size, bool)
    for i in range(depth):
        keep[wide[:-1] + i] = False
    return key[keep], offsets + np.arange(n + 1)


def count_sorted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the number, or sum of counts, of each."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    if not keys.size:
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, keys.size)) if counts is None else np.add.reduceat(counts, first)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0, to 1e-12: the series after a shift by eight."""
    x = np.asarray(x, np.float64)
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


_small_gamma = [log_gamma(np.arange(4096) + 0.5), log_gamma(np.arange(4096) + 1.0)]


def _gamma_at(n: np.ndarray, k: int) -> np.ndarray:
    out = _small_gamma[k][np.minimum(n, 4095)]
    big = n > 4095
    if big.any():
        out[big] = log_gamma(n[big] + (0.5, 1.0)[k])
    return out


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of the counts."""
    return _gamma_at(zeros, 0) + _gamma_at(ones, 0) - 2 * _HALF_LOG_PI - _gamma_at(zeros + ones, 1)


def _nodes(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, node) pairs at a depth, packed with the node lowest, and their zeros and ones."""
    byte = keys & _U(255)
    context = (keys >> _U(8)) & _U((1 << (8 * depth)) - 1)
    at, bits, times = [], [], []
    for level in range(8):
        at.append((context << _U(8)) | _U(1 << level) | (byte >> _U(8 - level)))
        bits.append((byte >> _U(7 - level)) & _U(1))
        times.append(counts)
    both, n = count_sorted((np.concatenate(at) << _U(1)) | np.concatenate(bits), np.concatenate(times))
    node = both >> _U(1)
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if node.size else np.zeros(0, np.int64)
    zeros, ones = np.zeros(first.size, np.int64), np.zeros(first.size, np.int64)
    which = np.cumsum(np.concatenate([[True], node[1:] != node[:-1]])) - 1 if node.size else np.zeros(0, np.int64)
    bit = (both & _U(1)).astype(bool)
    zeros[which[~bit]] = n[~bit]
    ones[which[bit]] = n[bit]
    return node[first], zeros, ones


def _parent(node: np.ndarray, depth: int) -> np.ndarray:
    """The node with a context shorter by its oldest byte."""
    return (((node >> _U(8)) & _U((1 << (8 * (depth - 1))) - 1)) << _U(8)) | (node & _U(255))


def _weigh(log_pe: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log Pw, and the weight of stopping here."""
    log_pw = np.logaddexp(log_pe, log_children) - np.log(2)
    return log_pw, np.exp(log_pe - np.log(2) - log_pw)


class Tree:
    """The nodes of one group of contexts, depths ``low`` to DEPTH; lists are indexed by depth."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int, depth: int = DEPTH):
        self.depth, self.low = depth, low
        self.node, self.zeros, self.ones, self.stop, self.log_pw = ([None] * (depth + 1) for _ in range(5))
        for d in range(depth, low - 1, -1):
            self.node[d], self.zeros[d], self.ones[d] = _nodes(keys, counts, d)
            pe = kt_block(self.zeros[d], self.ones[d])
            if d == depth:
                self.log_pw[d], self.stop[d] = pe, np.ones(pe.size)
            else:
                up = np.searchsorted(self.node[d], _parent(self.node[d + 1], d + 1))
                self.log_pw[d], self.stop[d] = _weigh(pe, np.bincount(up, self.log_pw[d + 1], minlength=pe.size))

    def mixtures(self, weight: np.ndarray, mixed: np.ndarray) -> list:
        """For each depth, the probability of a one if the path ends at the node. ``weight`` is what the depths
        above ``low`` leave for it and below, ``mixed`` their weighted share, each for the nodes at ``low``."""
        out: list = [None] * (self.depth + 1)
        for d in range(self.low, self.depth + 1):
            kt = (self.ones[d] + 0.5) / (self.zeros[d] + self.ones[d] + 1)
            out[d] = mixed + weight * kt
            if d < self.depth:
                up = np.searchsorted(self.node[d], _parent(self.node[d + 1], d + 1))
                mixed, weight = (mixed + weight * self.stop[d] * kt)[up], (weight * (1 - self.stop[d]))[up]
        return out


def byte_cost(keys: np.ndarray, node: np.ndarray, p: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each string's byte after its context, all nodes being present."""
    byte, context = keys & _U(255), (keys >> _U(8)) & _U((1 << (8 * depth)) - 1)
    out = np.zeros(keys.size)
    for level in range(8):
        q = p[np.searchsorted(node, (context << _U(8)) | _U(1 << level) | (byte >> _U(8 - level)))]
        out += np.log10(np.where((byte >> _U(7 - level)) & _U(1), q, 1 - q))
    return out


class Top:
    """Depths 0 and 1: at most 255 and 65,280 nodes. Gives, for nodes at depth 2, weight and share from above."""

    def __init__(self, rows: pd.DataFrame):
        """rows: node at depth 1 (context byte and node), zeros, ones, log_children."""
        rows = rows.sort_values("node")
        self.node1 = rows["node"].to_numpy().astype(_U)
        zeros, ones = rows["zeros"].to_numpy(), rows["ones"].to_numpy()
        log_pw, self.stop1 = _weigh(kt_block(zeros, ones), rows["log_children"].to_numpy())
        self.kt1 = (ones + 0.5) / (zeros + ones + 1)
        self.node0, up = np.unique(self.node1 & _U(255), return_inverse=True)
        z0, o0 = np.bincount(up, zeros, self.node0.size), np.bincount(up, ones, self.node0.size)
        _, stop0 = _weigh(kt_block(z0.astype(np.int64), o0.astype(np.int64)), np.bincount(up, log_pw, self.node0.size))
        kt0 = (o0 + 0.5) / (z0 + o0 + 1)
        self.p0 = kt0
        taken, rest = stop0 * kt0, 1 - stop0
        self.p1 = (taken[up] + rest[up] * self.kt1) if self.node1.size else np.zeros(0)
        self.taken1 = taken[up] + rest[up] * self.stop1 * self.kt1 if self.node1.size else np.zeros(0)
        self.rest1 = rest[up] * (1 - self.stop1) if self.node1.size else np.zeros(0)

    def above(self, node2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.node1, _parent(node2, 2))
        return self.rest1[at], self.taken1[at]


def turn(x: np.ndarray, depth: int) -> np.ndarray:
    """Packed strings or nodes with the last two context bytes in front, so that a group's stand together."""
    return (((x >> _U(8)) & _U(0xFFFF)) << _U(8 * depth - 8)) | ((x >> _U(24)) << _U(8)) | (x & _U(255))


def turn_back(x: np.ndarray, depth: int) -> np.ndarray:
    rest = x & _U((1 << (8 * depth - 8)) - 1)
    return ((rest >> _U(8)) << _U(24)) | ((x >> _U(8 * depth - 8)) << _U(8)) | (x & _U(255))


class Model:
    """A block of the model as sorted arrays, for contexts whose last two bytes are in ``ends`` (None: any).

    ``gram`` and ``cost`` hold the strings seen and their log10 probabilities; ``nodes`` has, by depth, nodes and
    the probability of a one there. All but the nodes at depths 0 and 1 are turned.
    """

    def __init__(self, gram: np.ndarray, cost: np.ndarray, nodes: list, depth: int = DEPTH, ends: np.ndarray | None = None):
        self.gram, self.cost, self.nodes, self.depth, self.ends = gram, cost, nodes, depth, ends

    def costs(self, turned: np.ndarray) -> np.ndarray:
        """log10 probabilities of distinct turned strings, sorted."""
        out = np.zeros(turned.size)
        at = np.searchsorted(self.gram, turned)
        at[at == self.gram.size] = 0
        known = self.gram[at] == turned if self.gram.size else np.zeros(turned.size, bool)
        out[known] = self.cost[at[known]]
        if not known.all():
            out[~known] = self._unseen(turn_back(turned[~known], self.depth))
        return out

    def _unseen(self, keys: np.ndarray) -> np.ndarray:
        byte = keys & _U(255)
        out = np.zeros(keys.size)
        for level in range(8):
            low = _U(1 << level) | (byte >> _U(8 - level))
            q = np.full(keys.size, 0.5)
            todo = np.arange(keys.size)
            for d in range(self.depth, -1, -1):
                node, p = self.nodes[d]
                if not node.size or not todo.size:
                    continue
                want = (((keys[todo] >> _U(8)) & _U((1 << (8 * d)) - 1)) << _U(8)) | low[todo]
                if d > 1:
                    want = turn(want, d)
                at = np.searchsorted(node, want)
                at[at == node.size] = 0
                hit = node[at] == want
                q[todo[hit]] = p[at[hit]]
                todo = todo[~hit]
            out += np.log10(np.where((byte >> _U(7 - level)) & _U(1), q, 1 - q))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each document, as far as this block gives it."""
        keys, begin = grams(data, offsets, self.depth)
        each = np.zeros(keys.size)
        mine = np.arange(keys.size) if self.ends is None else np.flatnonzero(self.ends[((keys >> _U(8)) & _U(0xFFFF)).astype(np.int64)])
        keys = turn(keys if self.ends is None else keys[mine], self.depth)
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if ordered.size else np.zeros(0, bool)
        each[mine[order]] = self.costs(ordered[new])[np.cumsum(new) - 1]
        return np.add.reduceat(each, begin[:-1])


def training(doc_id) -> object:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def _partial_counts(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """Distinct keys of a partition with their counts, passed on when more than HELD are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        return count_sorted(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

    def out(keys, counts):
        for i in range(0, keys.size, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["key", "n"])

    size = 0
    for batch in batches:
        for _, _, data, offsets in runs(batch.column(0), SCAN_BYTES):
            held.append(count_sorted(keys_of(data, offsets)))
            size += held[-1][0].size
            if size > 2 * HELD:
                held = [merged()]
                size = held[0][0].size
                if size > HELD:
                    yield from out(*held[0])
                    held, size = [], 0
    if held:
        yield from out(*merged())


def _gram_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return grams(data, offsets)[0]


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.concatenate([word_hashes(data, offsets)[0], np.full(len(offsets) - 1, WORD_END, _U)])


def counted(docs: DataFrame, keys_of) -> DataFrame:
    """key and n over all texts of ``docs``."""
    return docs.select("text").mapInArrow(lambda b: _partial_counts(b, keys_of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _below(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's part of the nodes at depth 1."""
    pdf = pdf.sort_values("key")
    tree = Tree(pdf["key"].to_numpy().astype(_U), pdf["n"].to_numpy(), 2)
    return pd.DataFrame({"node": _parent(tree.node[2], 2).astype(np.int64), "zeros": tree.zeros[2], "ones": tree.ones[2], "log_children": tree.log_pw[2]})


def _finished(pdf: pd.DataFrame, top: Top) -> pd.DataFrame:
    """A group's part of the model: for strings (d = -1) log10 probabilities, for nodes mixtures, as packed arrays."""
    pdf = pdf.sort_values("key")
    keys = pdf["key"].to_numpy().astype(_U)
    tree = Tree(keys, pdf["n"].to_numpy(), 2)
    mixed = tree.mixtures(*top.above(tree.node[2]))
    parts = [(-1, turn(keys, DEPTH), byte_cost(keys, tree.node[DEPTH], mixed[DEPTH])), *((d, turn(tree.node[d], d), mixed[d]) for d in range(2, DEPTH + 1))]
    end = int((keys[0] >> _U(8)) & _U(0xFFFF))
    rows = []
    for d, k, v in parts:
        order = np.argsort(k)
        rows.append((end, d, len(k), k[order].tobytes(), v[order].tobytes()))
    return pd.DataFrame(rows, columns=["end", "d", "rows", "keys", "vals"])


class Words:
    """A block of word counts: sorted hashes from ``lo`` to below ``hi`` of all training tokens, with small counts in
    a byte and those of 255 and more apart."""

    def __init__(self, keys: np.ndarray, small: np.ndarray, big: dict[int, int], lo: int, hi: int | None, n: int, v: int):
        self.keys, self.small, self.lo, self.hi, self.n, self.v = keys, small, lo, hi, n, v
        self.big_keys = np.array(sorted(big), _U)
        self.big_counts = np.array([big[k] for k in sorted(big)], np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of distinct hashes."""
        if not self.keys.size:
            return np.zeros(hashes.size, np.int64)
        at = np.searchsorted(self.keys, hashes)
        at[at == self.keys.size] = 0
        out = np.where(self.keys[at] == hashes, self.small[at], 0).astype(np.int64)
        big = np.flatnonzero(out == 255)
        out[big] = self.big_counts[np.searchsorted(self.big_keys, hashes[big])]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens and log10 probability of each document, as far as this block gives them."""
        n = len(offsets) - 1
        hashes, rows = word_hashes(data, offsets)
        hashes, rows = np.concatenate([hashes, np.full(n, WORD_END, _U)]), np.concatenate([rows, np.arange(n)])
        if self.lo or self.hi is not None:
            mine = hashes >= _U(self.lo)
            if self.hi is not None:
                mine &= hashes < _U(self.hi)
            hashes, rows = hashes[mine], rows[mine]
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if ordered.size else np.zeros(0, bool)
        c = np.empty(hashes.size, np.int64)
        c[order] = self.of(ordered[new])[np.cumsum(new) - 1]
        cost = np.log10((c + 1) / (self.n + 1 * (self.v + 1)))
        return np.bincount(rows, minlength=n), np.bincount(rows, c > 0, minlength=n).astype(np.int64), np.bincount(rows, cost, minlength=n)


def _packed(rows: DataFrame, sizes: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Arrays of one block by depth: each group's part is put where it belongs, in the order of groups."""
    out, place = {}, {}
    for d in {r.d for r in sizes}:
        of = sorted((r.end, r.rows) for r in sizes if r.d == d)
        edge = np.concatenate([[0], np.cumsum([n for _, n in of])]).tolist()
        place |= {(e, d): i for (e, _), i in zip(of, edge, strict=False)}
        out[d] = (np.empty(edge[-1], _U), np.empty(edge[-1]))
    for r in rows.toLocalIterator():
        at = place[r.end, r.d]
        out[r.d][0][at : at + r.rows] = np.frombuffer(r["keys"], _U)
        out[r.d][1][at : at + r.rows] = np.frombuffer(r["vals"], np.float64)
    return out


def _tree_blocks(sizes: list, limit: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of two-byte ends, one for each block; together they are all ends, so that contexts which nobody
    saw cost what they cost in just one block."""
    by_end = np.zeros(1 << 16, np.int64)
    for r in sizes:
        by_end[r.end] += r.rows
    starts, size = [0], 0
    for end in np.flatnonzero(by_end).tolist():
        if size and size + by_end[end] > limit:
            starts.append(end)
            size = 0
        size += by_end[end]
    return list(zip(starts, [*(x - 1 for x in starts[1:]), (1 << 16) - 1], strict=True))


def _word_ranges(v: int, limit: int) -> list[tuple[int, int | None]]:
    """Ranges of unsigned hashes, about ``limit`` words each, as hashes are uniform."""
    n = max(1, -(-v // limit))
    edges = [(i << 64) // n for i in range(n)]
    return list(zip(edges, [*edges[1:], None], strict=True))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _in_range(words: DataFrame, lo: int, hi: int | None) -> DataFrame:
    """Rows whose hash, read as unsigned, is in the range."""
    flipped = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    out = words.filter(flipped >= F.lit(_signed(lo ^ (1 << 63)))) if lo else words
    return out.filter(flipped < F.lit(_signed(hi ^ (1 << 63)))) if hi is not None else out


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([batch.column(0).to_numpy().tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy().tobytes()], pa.binary())], ["d", "keys", "vals"]
        )


def scored(docs: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    docs = docs.select(F.col("doc_id"), "text")
    learnt = docs.filter(training(F.col("doc_id")))
    words = scratch.save(counted(learnt, _word_keys))
    strings = scratch.save(counted(learnt, _gram_keys))

    by_end = strings.withColumn("end", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    ones = by_end.groupBy("end").applyInPandas(_below, "node long, zeros long, ones long, log_children double")
    ones = ones.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log_children")))
    top = Top(ones.toPandas())  # at most 65,280 rows
    model = scratch.save(by_end.groupBy("end").applyInPandas(lambda pdf: _finished(pdf, top), "end int, d int, rows long, keys binary, vals binary"))

    n_train, v = words.agg(F.sum("n"), F.count("*")).first()
    n_train = n_train or 0
    sizes = model.select("end", "d", "rows").collect()  # at most 65,536 groups of DEPTH rows
    trees, ranges = _tree_blocks(sizes, limit), _word_ranges(v, limit)
    passes = max(len(trees), len(ranges))
    # Several passes meet by row numbers that a table in the shared folder fixes.
    numbered = scratch.save(docs.select(F.monotonically_increasing_id().alias("k"), "doc_id", "text")) if passes > 1 else None
    parts = []
    for i in range(passes):
        tree = word = None
        if i < len(trees):
            lo, hi = trees[i]
            rows = model.filter(F.col("end").between(lo, hi)) if len(trees) > 1 else model
            got = _packed(rows, [r for r in sizes if lo <= r.end <= hi])
            del rows
            none = (np.zeros(0, _U), np.zeros(0))
            levels = [(top.node0, top.p0), (top.node1, top.p1), *(got.get(d, none) for d in range(2, DEPTH + 1))]
            ends = np.zeros(1 << 16, bool)
            ends[lo : hi + 1] = True
            tree = Model(*got.get(-1, none), levels, DEPTH, ends if len(trees) > 1 else None)
        if i < len(ranges):
            word = Words(*_packed_range(_in_range(words, *ranges[i])), *ranges[i], n_train, v)
        shared = spark.sparkContext.broadcast((tree, word))
        tree = word = got = levels = None

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tree, word = shared.value
            for batch in batches:
                for a, b, data, offsets in runs(batch.column(1), SCAN_BYTES):
                    zero = np.zeros(b - a)
                    tokens, known, base = word.score(data, offsets) if word else (zero.astype(np.int64), zero.astype(np.int64), zero)
                    score = tree.score(data, offsets) if tree else zero
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score)], ["k", "n_tokens", "n_known", "base_score", "score"]
                    )

        rows = "n_tokens long, n_known long, base_score double, score double"
        if passes == 1:
            kind = docs.schema["doc_id"].dataType.simpleString()
            out = docs.mapInArrow(run, f"k {kind}, {rows}").withColumnRenamed("k", "doc_id")
        else:
            part = scratch.save(numbered.select("k", "text").mapInArrow(run, f"k long, {rows}"))
            parts.append(part)
            shared.destroy()
    if passes > 1:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        sums = every.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
        out = numbered.select("k", "doc_id").join(sums, "k").drop("k")
    return out.select("doc_id", (~training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _packed_range(words: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    keys, small, big = [np.zeros(0, _U)], [np.zeros(0, np.uint8)], {}
    for r in words.mapInArrow(_packed_words, "d int, keys binary, vals binary").toLocalIterator():
        k, n = np.frombuffer(r["keys"], _U), np.frombuffer(r["vals"], np.int64)
        keys.append(k)
        small.append(np.minimum(n, 255).astype(np.uint8))
        big |= dict(zip(k[n >= 255].tolist(), n[n >= 255].tolist(), strict=True))
    k = np.concatenate(keys)
    del keys
    order = np.argsort(k)
    return k[order], np.concatenate(small)[order], big


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scored(table(spark, sf_dir, "documents"))
