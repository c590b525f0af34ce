"""Border modes of an axis, and sums of rectangles by a summed-area table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("constant", "edge", "wrap", "symmetric", "reflect")


def border_index(at: Column, size: Column, mode: str) -> Column:
    """The index within 0 .. size - 1 that stands for ``at``; null where the constant does.

    ``symmetric`` repeats the edge (b a | a b c | c b), ``reflect`` does not (c b | a b c | b a).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "constant":
        return F.when((at >= 0) & (at < size), at).cast("int")
    if mode == "edge":
        return F.greatest(F.lit(0), F.least(at, size - 1)).cast("int")
    if mode == "wrap":
        return F.pmod(at, size).cast("int")
    if mode == "symmetric":
        k = F.pmod(at, 2 * size)
        return F.when(k < size, k).otherwise(2 * size - 1 - k).cast("int")
    k = F.pmod(at, F.greatest(2 * (size - 1), F.lit(1)))
    return F.when(size == 1, 0).when(k < size, k).otherwise(2 * (size - 1) - k).cast("int")


def summed_area(pixels: DataFrame) -> DataFrame:
    """Adds ``area``, the sum of v at or above and at or left of each pixel: sums along rows, then down columns."""
    row = Window.partitionBy("image_id", "channel", "r").orderBy("c")
    column = Window.partitionBy("image_id", "channel", "c").orderBy("r")
    return pixels.withColumn("along", F.sum("v").over(row)).withColumn("area", F.sum("along").over(column)).drop("along")


def rect_sum(area: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Sums over rectangles (image_id, channel, r0, c0, r1, c1, ends included) from four corners of a summed-area table."""
    out = rectangles
    for name, r, c in (("a", "r1", "c1"), ("b", F.col("r0") - 1, "c1"), ("d", "r1", F.col("c0") - 1), ("e", F.col("r0") - 1, F.col("c0") - 1)):
        corner = area.select("image_id", "channel", F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("area").alias(name))
        r, c = (F.col(x) if isinstance(x, str) else x for x in (r, c))
        out = out.withColumns({"_r": r, "_c": c}).join(corner, ["image_id", "channel", "_r", "_c"], "left").drop("_r", "_c")
    total = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)) - F.coalesce("d", F.lit(0)) + F.coalesce("e", F.lit(0))
    return out.select("image_id", "channel", "r0", "c0", "r1", "c1", total.cast("bigint").alias("total"))
