"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Normalising lower-cases A-Z and keeps the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` as words. A
window is ten consecutive words of an item; an item of fewer words, but not none, is one window. Every
text is scanned once, whole; a word inside any occurrence of a window is hit, and the hits are mapped
back to character offsets in the original text.

Defined results: a null or empty text has no words and no hits; a null item text gives no window; items
that repeat under one id count once, equal texts under several ids count for each; items with a null id
hit words but are in no list of items; columns other than the named ones are passed by. Documents with
equal or null doc_id stay one row each.

Scale: the scan has no shuffle. The benchmark is read to the driver only up to ``AUTOMATON_BYTES`` of
patterns; a larger one is cut into that many automata, each sent out, scanned and written in a pass of its own before the next,
and the passes are united by document, so that memory stays bounded at any size of the benchmark. A worker builds an automaton once.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

WINDOW = 10
#: Bytes of distinct patterns in one automaton: some 30 times as much memory in each Python worker.
AUTOMATON_BYTES = 4 << 20

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(text: str | None) -> set[str]:
    """The patterns of an item, one character a byte, each word between spaces."""
    words = normal_words(text or "")
    if not words:
        return set()
    n = min(WINDOW, len(words))
    return {f" {b' '.join(words[i : i + n]).decode('latin-1')} " for i in range(len(words) - n + 1)}


def automaton(patterns: dict[str, frozenset]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for p, items in patterns.items():
        out.add_word(p, (p.count(" ") - 1, items))
    out.make_automaton()
    return out


def find(text: str, machine) -> tuple[int, np.ndarray, set]:
    """Number of words, the sorted indices of hit words, and the items with occurring windows."""
    words = normal_words(text)
    if not words:
        return 0, np.zeros(0, np.int64), set()
    line = f" {b' '.join(words).decode('latin-1')} "
    ends, sizes, items = [], [], set()
    for end, (size, ids) in machine.iter(line) if len(machine) else ():
        ends.append(end)
        sizes.append(size)
        items |= ids
    if not ends:
        return len(words), np.zeros(0, np.int64), items
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    after = np.searchsorted(spaces, np.array(ends))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, after - np.array(sizes), 1)
    np.add.at(cover, after, -1)
    return len(words), np.flatnonzero(np.cumsum(cover[:-1]) > 0), items


def original_words(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets, end exclusive, of each hit word in the text as it was."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw.translate(_FOLD), np.uint8)
    word = np.concatenate([[False], data != 32, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return list(zip(chars[starts[hit]].tolist(), chars[ends[hit]].tolist(), strict=True))


def in_runs(hit: list[int], spans: list[int]) -> tuple[list[int], list[int]]:
    """Distinct hit words in order, and the offsets of each run of successive ones, from words (in any order, with repeats) and
    their offsets."""
    words = sorted({(k, spans[2 * i], spans[2 * i + 1]) for i, k in enumerate(hit)})
    out: list[int] = []
    for i, (k, start, end) in enumerate(words):
        if i and words[i - 1][0] == k - 1:
            out[-1] = end
        else:
            out += [start, end]
    return [k for k, _, _ in words], out


def pattern_blocks(benchmark: DataFrame, limit: int = AUTOMATON_BYTES) -> Iterator[dict[str, frozenset]]:
    """Blocks of patterns with the ids of their items; a block has at most ``limit`` bytes and one item more.

    Items come to the driver one partition at a time and leave with their block.
    """
    block: dict[str, set] = {}
    size = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        for p in windows(text):
            if p not in block:
                block[p] = set()
                size += len(p)
            if item is not None:
                block[p].add(item)
        if size >= limit:
            yield {p: frozenset(v) for p, v in block.items()}
            block, size = {}, 0
    yield {p: frozenset(v) for p, v in block.items()}


_machine: list = [None, None]


def machine_of(shared, name: str):
    """The automaton of a broadcast, which a worker builds once; of several only the last is kept."""
    if _machine[0] != name:
        _machine[:] = [None, None]
        _machine[:] = [name, automaton(shared.value)]
    return _machine[1]


def scan(docs: DataFrame, shared, spans: bool = False) -> DataFrame:
    """doc_id, text's n_words, the hit words and items of one automaton, whose patterns are broadcast; ``spans`` adds the
    original offsets of the hit words."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(shared, name)
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(1):
                text = text.as_py() or ""
                n, hit, items = find(text, machine)
                for c, v in zip(cols, (n, hit.tolist(), sorted(items), [x for p in original_words(text, hit) for x in p] if spans and hit.size else []), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(cols[0], pa.int64()),
                    pa.array(cols[1], pa.list_(pa.int64())),
                    pa.array(cols[2], pa.list_(pa.string())),
                    pa.array(cols[3], pa.list_(pa.int64())),
                ],
                ["row", "n_words", "hit", "items", "spans"],
            )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select(F.col("doc_id").alias("row"), "text").mapInArrow(
        run, f"row {kind}, n_words long, hit array<long>, items array<string>, spans array<long>"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = AUTOMATON_BYTES, spans: bool = False) -> DataFrame:
    """doc_id, n_words, hit (sorted indices of hit words), items (sorted ids) and, on request, spans
    (start, end, start, end ... in characters of the original)."""
    context = docs.sparkSession.sparkContext
    blocks = pattern_blocks(benchmark, limit)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        found = scan(docs, context.broadcast(first), spans)
        return (_runs(found) if spans else found).withColumnRenamed("row", "doc_id")
    # Several automata: the rows of each pass meet by a row number that is fixed in the shared folder.
    scratch = Scratch(docs.sparkSession, "decontaminate")
    fixed = scratch.save(docs.select(F.monotonically_increasing_id().alias("k"), F.col("doc_id").alias("id"), "text"))
    every = None
    for block in itertools.chain((first, second), blocks):
        shared = context.broadcast(block)
        one = scratch.save(scan(fixed.select(F.col("k").alias("doc_id"), "text"), shared, spans))
        shared.destroy()
        every = one if every is None else every.unionByName(one)
    lists = every.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    lists = _runs(lists) if spans else lists.withColumn("hit", F.sort_array(F.array_distinct("hit")))
    return fixed.select("k", F.col("id").alias("doc_id")).join(lists, F.col("k") == lists.row).select("doc_id", "n_words", "hit", "items", "spans")


def _runs(found: DataFrame) -> DataFrame:
    """The rows of ``scan`` with offsets of runs instead of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [in_runs(hit, spans) for hit, spans in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h for h, _ in made], pa.list_(pa.int64())), batch.column(3), pa.array([s for _, s in made], pa.list_(pa.int64()))], batch.schema.names
            )

    found = found.select("row", "n_words", "hit", "items", "spans")
    return found.mapInArrow(run, found.schema)


def sorted_list(items: Column) -> Column:
    return F.array_join(F.array_sort(items), ",")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(sorted_list("items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit word, all columns as they were."""
    found = contamination(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), benchmark)
    return found.filter(F.size("hit") == 0).select("doc_id.*")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, size, p FROM (
    SELECT item_id, least({WINDOW}, len(w)) AS size, unnest(list_transform(range(1, len(w) - least({WINDOW}, len(w)) + 2), lambda i: array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' '))) AS p
    FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS p FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT dw.doc_id, dw.i, dw.size, win.item_id FROM dw JOIN win ON dw.size = win.size AND dw.p = win.p),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
