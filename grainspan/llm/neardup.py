"""MinHash near-duplicates by an inverted join on signature coordinates.

Documents are sets of distinct five-word shingles; two are linked if 100 * intersection >= 85 * union.

1. One scan makes, for each document, the size of its set, a 128-bit fingerprint of it and a signature of
   ``COORDINATES`` minima. Documents with one fingerprint are one class, which goes on under a number that a written table fixes;
   doc_ids come back at the end.
2. Classes are posted under each coordinate-value pair. A value that only one class has can match nobody,
   so a class with fewer than ``MATCHES`` shared values has no partner and goes.
3. The rest of a class's values are ordered by list length, rarest first. A pair with MATCHES common values
   has one among the first COORDINATES - MATCHES + 1 of each (prefix merging), so only these short lists
   are merged; the long lists are skipped and their values looked up in the signatures (skip merging).
4. A pair whose signatures agree in MATCHES or more coordinates is confirmed on the full sets.

No list is expanded into all pairs: first each list's members meet one hub, the member whose values are
most shared in the whole corpus (in a family of copies, the original), which joins a family of any size
with as many pairs as members. Components that then still share a list have their collisions counted in blocks of signatures of
bounded size, without their largest component's own pairs; members of pairs with MATCHES collisions are then compared on full sets in their
block, so no link between components is lost. What is left quadratic is the number of members of a family that share lists with it and yet are
linked with none of its hubs.

A pair at exactly 0.85 agrees in 54 of 64 coordinates on average and is no candidate below 41; with independent
coordinates that is one in 110,000 such pairs, and one in 1.4 million at 0.87.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; fewer than five
words are one shingle; equal sets are linked; rows that repeat a doc_id keep their rows and share a
component, whatever their texts; a null doc_id is never the smallest of a component, and without others has a null component and is kept.
Further columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import connected
from .scratch import Scratch, table
from .textkit import mix, runs, shingle_sets

COORDINATES = 64
MATCHES = 41
PREFIX = COORDINATES - MATCHES + 1
SAME, OF = 100, 85
#: Documents of a block that is compared at once, and shingles of one step of the comparison.
BLOCK, COLUMNS = 256, 1 << 13
#: Up to so many ids of candidates (16 MB) are broadcast to pick their texts; beyond it they are joined.
BROADCAST_IDS = 1 << 20

_rng = np.random.Generator(np.random.PCG64(64041))
_XOR = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of the non-empty sets, (len(sets), COORDINATES); values differ between coordinates."""
    if not sets:
        return np.zeros((0, COORDINATES), np.uint64)
    x = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([s.size for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    y = np.empty_like(x)
    for j in range(COORDINATES):
        np.bitwise_xor(x, _XOR[j], out=y)
        np.multiply(y, _TIMES[j], out=y)
        out[:, j] = np.minimum.reduceat(y, first)
    return mix(out ^ (_XOR + np.uint64(1)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for a, b, data, offsets in runs(batch.column(1)):
            sets = shingle_sets(data, offsets)
            full = np.flatnonzero([s.size for s in sets])
            sig = signature([sets[k] for k in full])
            where = np.zeros(b - a + 1, np.int32)
            where[full + 1] = COORDINATES
            empty = np.array([not s.size for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([s.size for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.data) if s.size else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(where, dtype=np.int32)), pa.array(sig.view(np.int64).ravel()), mask=pa.array(empty)),
                ],
                ["doc_id", "n_shingles", "fp", "sig"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp and members of the texts that have words; the first column is not used."""
    import xxhash

    for batch in batches:
        for _, _, data, offsets in runs(batch.column(1)):
            sets = [s for s in shingle_sets(data, offsets) if s.size]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.data) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "members"])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, with the text's position given by the caller as the last column, and the fingerprint of their sets."""
    import xxhash

    for batch in batches:
        fps = []
        for _, _, data, offsets in runs(batch.column(batch.num_columns - 1)):
            fps += [xxhash.xxh3_128_digest(s.data) if s.size else None for s in shingle_sets(data, offsets)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.binary())], [*batch.schema.names[:-1], "fp"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs that are linked; both sides are sorted distinct hashes."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        good = []
        for k in range(batch.num_rows):
            x, y = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
            if x.size > y.size:
                x, y = y, x
            # Sizes alone may rule a pair out; the shared ones are found by binary search in the larger set.
            if SAME * x.size < OF * y.size:
                good.append(False)
                continue
            at = np.searchsorted(y, x)
            at[at == y.size] = 0
            common = int((y[at] == x).sum())
            good.append(SAME * common >= OF * (x.size + y.size - common))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def components(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and fp of each row of ``docs``, and fp, root and smallest doc_id of the component of each class that
    has other rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(docs.mapInArrow(_sign, "doc_id long, n_shingles long, fp binary, sig array<long>"))

    # One row for each class; the signature of any member is that of all.
    classes = scratch.save(
        signed.filter("fp is not null")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.any_value("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    posted = classes.select("node", F.explode("sig").alias("key"))
    lengths = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = posted.join(lengths, "key")
    candidates = scratch.save(
        shared.groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists"))  # at most COORDINATES for each class
        .filter(F.size("lists") >= MATCHES)
        .select("node", F.expr(f"transform(slice(lists, 1, size(lists) - {MATCHES - 1}), x -> x.key)").alias("prefix"), F.expr("aggregate(lists, 0L, (a, x) -> a + x.n)").alias("weight"))
    )
    n_candidates = candidates.count()
    if not n_candidates:
        linked = spark.createDataFrame([], "node long, component long")
    else:
        small = n_candidates <= BROADCAST_IDS
        wanted = F.broadcast(candidates.select("node")) if small else candidates.select("node")
        marks = scratch.save(classes.join(wanted, "node", "left_semi").select("fp", "node", "rep"))
        # Of each class one text is read, that of its smallest doc_id; where that id has several texts, all of them are and one stays.
        ids, named = marks.select(F.col("rep").alias("id")).distinct(), marks.select("fp", "node")
        if small:
            ids, named = F.broadcast(ids), F.broadcast(named)
        sets = docs.join(ids, docs.doc_id.eqNullSafe(ids.id), "left_semi").mapInArrow(_full_sets, "fp binary, members binary")
        sets = scratch.save(sets.join(named, "fp").select("node", "members"))
        if sets.count() > n_candidates:
            sets = scratch.save(sets.groupBy("node").agg(F.any_value("members").alias("members")))
        sigs = scratch.save(classes.join(wanted, "node", "left_semi").select("node", "sig"))
        lists = scratch.save(candidates.select("node", "weight", F.explode("prefix").alias("key")))

        hubs = lists.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("hub"))
        stars = lists.join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y")).distinct()
        links = scratch.save(_confirmed(stars, sigs, sets))
        linked = connected(links.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)

        # Components that still share a list are compared member by member, in blocks.
        named = lists.join(linked, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key", "lo")
        named = scratch.save(named.join(mixed, "key").select("node", "component", "lo").distinct())
        if not named.isEmpty():
            families = connected(named.select(F.col("component").alias("a"), F.col("lo").alias("b")), scratch)
            more = scratch.save(_blockwise(named.select("node", "component").distinct(), families, sigs, sets, scratch))
            if not more.isEmpty():
                linked = connected(links.select("x", "y").unionByName(more).select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)

    # Classes that are alone need no answer but their own.
    grouped = classes.join(linked, "node", "left").filter("component is not null or rows > 1").select("fp", "rep", F.coalesce("component", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    return signed.select("doc_id", "n_shingles", "fp"), grouped.join(least, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    signed, grouped = components(docs, scratch or Scratch(docs.sparkSession, "neardup"))
    out = signed.join(grouped.select("fp", "component"), "fp", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose signatures agree in MATCHES coordinates and whose full sets are linked."""
    left, right = sigs.select(F.col("node").alias("x"), F.col("sig").alias("sig_x")), sigs.select(F.col("node").alias("y"), F.col("sig").alias("sig_y"))
    agree = F.expr("aggregate(zip_with(sig_x, sig_y, (a, b) -> if(a = b, 1, 0)), 0, (s, v) -> s + v)")
    likely = pairs.join(left, "x").join(right, "y").filter(agree >= MATCHES).select("x", "y")
    full = likely.join(sets.select(F.col("node").alias("x"), F.col("members").alias("set_x")), "x").join(sets.select(F.col("node").alias("y"), F.col("members").alias("set_y")), "y")
    return full.select("x", "y", "set_x", "set_y").mapInArrow(_confirm, "x long, y long")


def _blockwise(members: DataFrame, families: DataFrame, sigs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (x, y) between different components of a family.

    A family's largest component and the rest of its members are each dealt into blocks of about ``BLOCK`` by hash.
    The rest meets itself and the largest component, block by block; the largest is never compared with
    itself. So a large family that the hubs have joined costs its few other members times its size, in tasks of
    bounded size, and what a task returns is at most one link for each component it sees.
    """
    placed = members.join(families, members.component == families.node).select(members.node, members.component, families.component.alias("family"))
    sizes = placed.groupBy("family", "component").agg(F.count("*").alias("n"))
    totals = scratch.save(sizes.groupBy("family").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    placed = placed.join(totals, "family").select(
        "family", "node", "component", (F.col("component") == F.col("top.component")).alias("main"), blocks(F.col("top.n")).alias("mains"), blocks(F.col("all") - F.col("top.n")).alias("rests")
    )
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    placed = placed.withColumn("own", own)
    # A task is a block of the rest against another of the rest (0 and up) or against one of the largest (-1 and down).
    meets = F.expr(
        "if(main, transform(sequence(0, rests - 1), r -> struct(r as one, -1 - own as two)), "
        "concat(transform(sequence(0, rests - 1), r -> struct(least(r, own) as one, greatest(r, own) as two)), transform(sequence(1, mains), m -> struct(own as one, -m as two))))"
    )
    tasks = placed.select("family", "node", "component", F.explode(meets).alias("task"))
    signed = tasks.join(sigs, "node").select("family", "task.one", "task.two", "node", "component", "sig")
    likely = scratch.save(signed.groupBy("family", "one", "two").applyInPandas(_collisions_in_block, "family long, one int, two int, node long, component long"))
    full = likely.join(sets, "node")
    return full.groupBy("family", "one", "two").applyInPandas(_links_in_block, "x long, y long")


def _collisions_in_block(block):
    """The members of a block that agree with one of another component in MATCHES coordinates."""
    sig = np.array(block["sig"].tolist(), np.int64)
    component = np.unique(block["component"].to_numpy(), return_inverse=True)[1]
    agree = np.zeros((len(sig), len(sig)), np.uint8)
    for j in range(COORDINATES):
        agree += sig[:, j, None] == sig[None, :, j]
    good = ((agree >= MATCHES) & (component[:, None] != component[None, :])).any(1)
    return block.loc[good, ["family", "one", "two", "node", "component"]]


def _links_in_block(block):
    """At most one verified link between any two components in the block, and no more than join them."""
    import pandas as pd

    parts = [np.frombuffer(m, np.uint64) for m in block["members"]]
    node, component = block["node"].to_numpy(), np.unique(block["component"].to_numpy(), return_inverse=True)[1]
    size = np.array([p.size for p in parts])
    row = np.repeat(np.arange(len(parts)), size)
    value = np.concatenate(parts)
    order = np.argsort(value)
    value, row = value[order], row[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    number = np.cumsum(first) - 1
    seen = np.bincount(number)
    keep = seen[number] > 1  # what only one document has is in no intersection
    number, row = np.cumsum(np.concatenate([[True], np.diff(number[keep]) > 0])) - 1 if keep.any() else number[keep], row[keep]
    common = np.zeros((len(parts), len(parts)), np.float32)  # counts stay exact below 2 ** 24
    total = int(number[-1]) + 1 if number.size else 0
    for lo in range(0, total, COLUMNS):
        a, b = np.searchsorted(number, [lo, lo + COLUMNS])
        has = np.zeros((len(parts), min(COLUMNS, total - lo)), np.float32)
        has[row[a:b], number[a:b] - lo] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    good = (SAME * common >= OF * (size[:, None] + size[None, :] - common)) & (component[:, None] != component[None, :])
    xs, ys = np.nonzero(np.triu(good, 1))
    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(xs.tolist(), ys.tolist(), strict=True):
        a, b = find(int(component[i])), find(int(component[j]))
        if a != b:
            root[a] = b
            out.append((int(node[i]), int(node[j])))
    return pd.DataFrame(out, columns=["x", "y"], dtype="int64")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns as they were: that of the smallest doc_id.

    A row is told apart by its doc_id and the fingerprint of its set. Where a doc_id (or its absence) is that of several rows, the
    fingerprint decides, so rows that share an id but not their text are documents of their own; of rows that share both, one
    stays. Rows without words are linked with nothing and all stay.
    """
    spark = docs.sparkSession
    scratch, kept = Scratch(spark, "neardup"), Scratch(spark, "kept")
    signed, grouped = components(docs, scratch)
    rows = signed.join(grouped, "fp", "left").withColumn("first", F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")))
    by_id = kept.save(rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("first").alias("first")))
    single = by_id.filter("rows = 1 and first and doc_id is not null").select("doc_id")
    several = by_id.filter("first and (rows > 1 or doc_id is null)").select("doc_id")
    n = by_id.agg(F.count(F.when(F.col("rows") == 1, 1)), F.count(F.when(F.col("first") & ((F.col("rows") > 1) | F.col("doc_id").isNull()), 1))).first()
    known = docs.withColumn("\x00id", F.col("doc_id").cast("long"))
    out = known.join(F.broadcast(single) if n[0] <= BROADCAST_IDS else single, F.col("\x00id") == single.doc_id, "left_semi").drop("\x00id")
    if n[1]:
        # The fingerprints to keep under each of these ids: of a component, the least of those with its smallest doc_id.
        of = rows.join(several, rows.doc_id.eqNullSafe(several.doc_id), "left_semi").filter("first and fp is not null")
        whose = F.struct("root", F.when(F.col("root").isNull(), F.col("fp")))  # a class that is alone has no root
        marks = kept.save(of.groupBy(whose).agg(F.min("fp").alias("fp"), F.min("doc_id").alias("id")).select("id", "fp"))
        ids = kept.save(several)
        some = known.join(ids, F.col("\x00id").eqNullSafe(ids.doc_id), "left_semi")
        row = some.select(F.struct(*docs.columns).alias("row"), F.col("\x00id").alias("id"), "text")
        printed = kept.save(row.mapInArrow(_fingerprints, StructType([*row.schema.fields[:2], StructField("fp", BinaryType())])))
        blank = printed.filter("fp is null").select("row.*")
        full = printed.join(marks, printed.fp.eqNullSafe(marks.fp) & printed.id.eqNullSafe(marks.id), "left_semi").dropDuplicates(["id", "fp"]).select("row.*")
        out = out.unionByName(blank).unionByName(full)
    scratch.clear()
    return out.select(docs.columns)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5_number(array_to_string(w[i:i + 4], ' ')))) END AS g FROM w),
u AS MATERIALIZED (SELECT doc_id, unnest(g) AS x FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN s i ON i.doc_id = p.a JOIN s j ON j.doc_id = p.b WHERE 100 * c >= 85 * (len(i.g) + len(j.g) - c)),
r AS (SELECT doc_id, doc_id AS z FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.z)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
