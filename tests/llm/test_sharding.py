"""Shards: the row law, slots, the curve, and awkward rows."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from grainspan.llm import sharding

from .helpers import awkward, docs


def check(rows, shards):
    n = len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_laws(spark):
    table = docs(spark, [(i, f"text {i % 5} " * (i % 40)) for i in range(203)] + awkward())
    for shards in (1, 3, 8):
        rows = sharding.sharded(table, shards).collect()
        check(rows, shards)
        order = [(r.curve, r.text_crc32, r.size, -1 if r.doc_id is None else r.doc_id) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)


def test_sizes_and_crc(spark):
    rows = sharding.sharded(docs(spark, awkward())).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in awkward())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_hot_group_is_split(spark):
    rows = sharding.sharded(docs(spark, [(i, "the same text") for i in range(80)])).collect()
    check(rows, 8)


def test_empty_and_clashing_columns(spark):
    assert sharding.sharded(docs(spark, [])).count() == 0
    table = docs(spark, awkward()).withColumns({"slot": F.lit("x"), "size": F.lit(1), "curve": F.lit(2), "shard": F.lit(9)})
    out = sharding.with_places(table)
    assert out.count() == len(awkward())
    check(out.collect(), 8)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "curve", "shard", "slot"]


def test_curve_is_a_hilbert_curve(spark):
    """Successive cells touch, and every cell is visited once."""
    side = 1 << sharding.BITS
    cells = spark.range(side**3).select((F.col("id") % side).cast("int").alias("x0"), ((F.col("id") / side).cast("int") % side).alias("x1"), (F.col("id") / side**2).cast("int").alias("x2"))
    out = cells.select("*", F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("x2").alias("c"))
    for step in sharding.curve_steps():
        out = out.withColumns({name: F.expr(sharding._infix_xor(e)) for name, e in step})
    rows = out.select("a", "b", "c", F.expr(sharding.curve_index()).alias("h")).toPandas().sort_values("h")
    assert rows["h"].tolist() == list(range(side**3))
    d = rows[["a", "b", "c"]].diff().abs().sum(axis=1).to_numpy()[1:]
    assert (d == 1).all()


def test_files(spark, tmp_path):
    table = docs(spark, [(i, f"t{i}") for i in range(50)])
    sharding.write_shards(table, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(50)) and back.select("shard").distinct().count() == 4
