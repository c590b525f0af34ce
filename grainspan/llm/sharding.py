"""Sharding along a Hilbert curve through document metadata; DataFrame and SQL functions only.

Three metadata dimensions are quantised to ``BITS`` bits each: source and language by five bits of their
MD5 (an unordered name has no better quantile), size by the power of two below it. A row's place on the
Hilbert curve through that cube is the sort key; runs of equal row counts are cut from the order, so a
shard, and each sorted file in it, covers a compact box of metadata and others can be skipped.

The law is ``rows``: shard = rank * shards div rows, so counts are at most one apart, and slot counts from 0
in the order of the curve. Ties on the curve go by text_crc32, size and doc_id, so equal texts with equal
metadata stand together, and a hot source or group of copies is split wherever a cut falls; it never sits
in one task, since ranges are cut by the whole key.

The rank takes one range exchange of the metadata (of whole rows where these are asked for, which is then the only time that texts
move): rows are sorted within ranges and written with the row number Spark gives them in their range; the ranges' counts (one row a
range, a number set by configuration) give the offsets. A re-run of a lost task reads the written rows, so
ranks do not change under it.

Defined results: a null text counts no bytes, has size 1 and crc32 0; a null source or lang is a value of
its own; null doc_ids come first among ties; equal rows take successive slots; an empty table gives an empty
result; other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

BITS = 5
DIMENSIONS = 3
SHARDS = 8
ORDER = ("curve", "text_crc32", "size", "doc_id")


def name_level(name: Column) -> Column:
    """BITS bits of a name."""
    digits = F.substring(F.md5(F.coalesce(name, F.lit("\x00")).cast("binary")), 1, 2)
    return F.conv(digits, 16, 10).cast("int") % F.lit(1 << BITS)


def size_level(size: Column) -> Column:
    """The power of two at or below a size of 1 or more: bits - 1, without floating point."""
    return F.least(F.length(F.bin(size.cast("long"))) - 1, F.lit((1 << BITS) - 1)).cast("int")


def curve_steps(bits: int = BITS, n: int = DIMENSIONS) -> list[list[tuple[str, str]]]:
    """Steps that turn coordinates x0, x1 ... into the transposed Hilbert index (Skilling 2004), as SQL over
    the columns of the step before. Each step is one projection, so expressions stay small."""
    steps: list[list[tuple[str, str]]] = []
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if i == 0:
                steps.append([("x0", f"CASE WHEN (x0 & {q}) <> 0 THEN xor(x0, {p}) ELSE x0 END")])
            else:
                # Set bit: invert the low bits of x0; else swap the low bits of x0 and xi.
                steps.append(
                    [
                        ("x0", f"CASE WHEN (x{i} & {q}) <> 0 THEN xor(x0, {p}) ELSE xor(x0, xor(x0, x{i}) & {p}) END"),
                        (f"x{i}", f"CASE WHEN (x{i} & {q}) <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {p}) END"),
                    ]
                )
        q >>= 1
    for i in range(1, n):
        steps.append([(f"x{i}", f"xor(x{i}, x{i - 1})")])
    t = "0"
    q = 1 << (bits - 1)
    while q > 1:
        t = f"xor({t}, CASE WHEN (x{n - 1} & {q}) <> 0 THEN {q - 1} ELSE 0 END)"
        q >>= 1
    steps.append([("t", t)])
    steps.append([(f"x{i}", f"xor(x{i}, t)") for i in range(n)])
    return steps


def curve_index(bits: int = BITS, n: int = DIMENSIONS) -> str:
    """The index of transposed coordinates, as SQL."""
    return " + ".join(f"((x{i} div {1 << b}) % 2) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i in range(n))


def metadata(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32 and curve of each row; ``more`` may be a column row that is carried along."""
    out = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        name_level(F.col("source")).alias("x0"),
        name_level(F.col("lang")).alias("x1"),
        *more,
    ).withColumn("x2", size_level(F.col("size")))
    spark_sql = lambda e: _infix_xor(e)
    for step in curve_steps():
        out = out.withColumns({name: F.expr(spark_sql(e)) for name, e in step})
    return out.select("doc_id", "size", "text_crc32", F.expr(curve_index()).cast("int").alias("curve"), *(["row"] if more else []))


def _infix_xor(e: str) -> str:
    """xor(a, b) as a ^ b, which is how Spark writes it."""
    while (at := e.rfind("xor(")) >= 0:
        depth, comma, k = 0, -1, at + 4
        while depth or e[k] != ")":
            depth += (e[k] == "(") - (e[k] == ")")
            if e[k] == "," and not depth:
                comma = k
            k += 1
        e = f"{e[:at]}(({e[at + 4 : comma]}) ^ ({e[comma + 1 : k]})){e[k + 1 :]}"
    return e


def sharded(docs: DataFrame, shards: int = SHARDS, row: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of each row of ``docs`` (doc_id, text, lang, source), and ``row`` if one is given."""
    scratch = Scratch(docs.sparkSession, "sharding")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = [] if row is None else [row.alias("row")]
    placed = scratch.save(
        metadata(docs, *more).repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER).withColumn("mid", F.monotonically_increasing_id())
    )
    placed = placed.withColumns({"part": F.shiftright("mid", 33), "nth": F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    counts = counts.agg(F.collect_list(F.struct("part", "n")).alias("parts"))  # a row for each of the ranges
    offsets = counts.select(
        F.expr("aggregate(parts, 0L, (a, x) -> a + x.n)").alias("total"),
        F.explode(F.transform("parts", lambda x: F.struct(x.part.alias("part"), F.aggregate(F.filter("parts", lambda y: y.part < x.part), F.lit(0).cast("long"), lambda a, y: a + y.n).alias("before")))).alias("o"),
    ).select("total", "o.part", "o.before")
    ranked = placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("nth"))
    cut = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
    # The first rank of a shard is the least r with r * shards >= shard * total.
    return cut.select(
        "doc_id", "size", "text_crc32", "curve", "shard", F.expr(f"rank - (cast(shard as bigint) * total + {shards - 1}) div {shards}").alias("slot"), *(["row"] if more else [])
    )


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents, with their shard and slot, in a folder for each shard, each file sorted along the curve.

    The rows of ``with_places`` stand in the order of the curve already, so they are written where they are.
    """
    with_places(docs, shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def with_places(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of the documents, then shard and slot (further columns of those names are replaced).

    Whole rows take the one range exchange, so texts move once, and a row never has to be found again by its id.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    return sharded(docs, shards, F.struct(*names)).select("row.*", "shard", "slot")


def _crc32_sql(column: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte through a table, in DuckDB SQL."""
    rows = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        rows.append(c)
    lookup = f"[{', '.join(map(str, rows))}]::UINTEGER[]"
    return (
        f"CAST(xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(octet_length(encode({column}))), lambda k: CAST(('0x' || substr(hex(encode({column})), 2 * k + 1, 2)) AS UINTEGER))), "
        f"lambda a, b: xor(a >> 8, list_extract({lookup}, CAST(xor(a & 255, b) AS INTEGER) + 1))), 4294967295::UINTEGER) AS BIGINT)"
    )


def _op3_sql() -> str:
    level = lambda c: f"(CAST(('0x' || substr(md5(coalesce({c}, chr(0))), 1, 2)) AS INTEGER) % {1 << BITS})"
    # The CRC takes one character list per text; hex once, then a fold over byte values.
    sql = [
        f"""WITH a AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
  {_crc32_sql("coalesce(text, '')")} AS text_crc32, {level("source")} AS x0, {level("lang")} AS x1 FROM documents),
c0 AS (SELECT *, CAST(least(length(ltrim(bin(size), '0')) - 1, {(1 << BITS) - 1}) AS INTEGER) AS x2, 0 AS t FROM a)"""
    ]
    k = 0
    for step in curve_steps():
        sql.append(f"c{k + 1} AS (SELECT * REPLACE ({', '.join(f'{e} AS {name}' for name, e in step)}) FROM c{k})")
        k += 1
    index = curve_index().replace(" div ", " // ")
    sql.append(f"r AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY {index}, text_crc32, size, doc_id NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM c{k})")
    return ",\n".join(sql) + (
        f"\nSELECT doc_id, size, text_crc32, 'rows' AS law, CAST(k * {SHARDS} // n AS INTEGER) AS shard,"
        f" CAST(k - ((k * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM r"
    )


OP3_SQL = _op3_sql()
