"""Circular local binary patterns: a relational plan, whose codes are for tables of up to ``PLANE_PIXELS`` pixels, and the tile plan for all others.

A pixel meets its P neighbour points in one explode; the four corners of a point are looked up in the array of the pixel's
block, which has a halo as wide as the largest radius, so ``samples`` takes tables of any size. Codes of more pixels than that bound, all images and
channels together, are left to the tile plan (``grainspan.operators.tiles``). All points of a pixel stand
together and stay in their block's partition, where they are aggregated.

The bilinear value is taken from absolute coordinates and in one fixed order, two horizontal steps and then the
vertical one; a corner outside of the image counts as 0 on its own; a point equal to the centre gives a one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import Run, offsets
from .masks import with_patch
from .tiles import EDGE, edge_of, halo_of, included_by_tile, pixel_codes, tiles_of_pixels

#: Pixels up to which codes take the relational plan.
PLANE_PIXELS = 1 << 22
#: Edge of a block of the relational plan, without its halo.
BLOCK = 128
#: Ones of a pixel are packed in a 64-bit integer; more points take the tile plan.
PACKED_POINTS = 62
METHODS = ("default", "ror", "uniform", "nri_uniform", "var")
PIXEL = ("image_id", "channel", "r", "c")
BLOCK_KEYS = ("image_id", "channel", "br", "bc")


def blocks(pixels: DataFrame, halo: int, edge: int = BLOCK) -> DataFrame:
    """image_id, channel, br, bc and flat (row after row, with the halo) of each block; positions without a pixel are 0."""
    wide = edge + 2 * halo
    span = lambda x: F.expr(f"sequence(cast(floor(({x} - {halo}) / {edge}) as int), cast(floor(({x} + {halo}) / {edge}) as int))")
    at = pixels.select("image_id", "channel", "r", "c", "v", F.explode(span("r")).alias("br"), span("c").alias("bcs"))
    at = at.select("image_id", "channel", "r", "c", "v", "br", F.explode("bcs").alias("bc")).filter("v <> 0")
    place = (F.col("r") - F.col("br") * edge + halo) * wide + F.col("c") - F.col("bc") * edge + halo
    grouped = at.withColumn("place", place.cast("int")).groupBy(*BLOCK_KEYS).agg(F.collect_list("place").alias("place"), F.collect_list("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                flat = np.zeros(wide * wide, np.int32)
                flat[batch.column(4)[k].values.to_numpy()] = batch.column(5)[k].values.to_numpy()
                ends = pa.array([0, flat.size], pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:4]), pa.ListArray.from_arrays(ends, pa.array(flat))], [*BLOCK_KEYS, "flat"])

    return grouped.mapInArrow(pack, "image_id string, channel int, br int, bc int, flat array<int>")


def point_array(of: Sequence[Run]) -> Column:
    """radius_idx, npoints, i, dy and dx of all points of all runs."""
    return F.array(*[F.struct(F.lit(r.index).alias("radius_idx"), F.lit(r.npoints).alias("npoints"), F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for r in of for i, (dy, dx) in enumerate(offsets(r))])


def samples(pixels: DataFrame, of: Sequence[Run], centres: DataFrame | None = None, edge: int = BLOCK) -> DataFrame:
    """image_id, channel, r, c, v, the block br and bc, radius_idx, npoints, i and t, the bilinear value of each point of ``centres`` (all pixels)."""
    halo = halo_of(of)
    own = lambda x: F.floor(F.col(x) / edge).cast("int")
    centres = (pixels if centres is None else centres).select(*PIXEL, "v", own("r").alias("br"), own("c").alias("bc"))
    near = centres.join(blocks(pixels, halo, edge), list(BLOCK_KEYS), "left")  # a block of zeros has no array
    every = near.select("*", F.explode(point_array(of)).alias("p"))
    at = every.select("*", (F.col("r") + F.col("p.dy")).alias("y"), (F.col("c") + F.col("p.dx")).alias("x"))
    at = at.withColumns({"y0": F.floor("y"), "y1": F.ceil("y"), "x0": F.floor("x"), "x1": F.ceil("x"), "a": F.col("y") - F.floor("y"), "b": F.col("x") - F.floor("x")})
    corner = lambda y, x: f"coalesce(get(flat, cast(({y} - br * {edge} + {halo}) * {edge + 2 * halo} + {x} - bc * {edge} + {halo} as int)), 0)"
    top = f"((1 - b) * {corner('y0', 'x0')} + b * {corner('y0', 'x1')})"
    bottom = f"((1 - b) * {corner('y1', 'x0')} + b * {corner('y1', 'x1')})"
    return at.select(*PIXEL, "v", "br", "bc", F.col("p.radius_idx").alias("radius_idx"), F.col("p.npoints").alias("npoints"), F.col("p.i").alias("i"), F.expr(f"(1 - a) * {top} + a * {bottom}").alias("t"))


def transitions(bits: Column, npoints: Column) -> Column:
    """Changes between successive points, without the step from the last to the first."""
    mask = F.expr("shiftleft(1L, npoints - 1)") - 1
    return F.bit_count(bits.bitwiseXOR(F.shiftright(bits, 1)).bitwiseAND(mask))


def _rotation_minimum(p: int) -> str:
    turn = [f"(shiftright(bits, {j}) | (shiftleft(bits, {p - j}) & {(1 << p) - 1}L))" for j in range(p)]
    return f"least({', '.join(turn)})" if p > 1 else "bits"


def code_of(of: Sequence[Run], method: str) -> Column:
    """The code from bits, ones, first_one, first_zero and npoints."""
    k, p = F.col("ones"), F.col("npoints")
    steps = transitions(F.col("bits"), p)
    if method == "uniform":
        return F.when(steps <= 2, k).otherwise(p + 1).cast("int")
    if method == "default":
        return F.col("bits")
    if method == "ror":
        out = F.lit(None).cast("bigint")
        for n in {r.npoints for r in of}:
            out = F.when(p == n, F.expr(_rotation_minimum(n))).otherwise(out)
        return out
    turn = F.when(F.col("bits").bitwiseAND(F.lit(1)) == 1, k - F.col("first_zero")).otherwise(p - F.col("first_one"))
    return F.when(k == 0, 0).when(k == p, p * (p - 1) + 1).when(steps > 2, p * (p - 1) + 2).otherwise(1 + (k - 1) * p + turn).cast("int")


def check(of: Sequence[Run], method: str) -> str:
    """The method's name. Codes of ``default`` and ``ror`` have a bit for each point, at most 31."""
    method = method.lower()
    if method not in METHODS:
        raise KeyError(method)
    if method in ("default", "ror") and any(r.npoints > 31 for r in of):
        raise ValueError(f"{method!r} takes at most 31 points")
    return method


def _tiled(pixels: DataFrame, of: Sequence[Run], method: str, mask: DataFrame | None, patch_mask: DataFrame | None, patch_size: int | None, edge: int) -> DataFrame:
    sizes = pixels.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    side = edge_of(patch_size or 1, edge)
    tiles = tiles_of_pixels(pixels, sizes, side, halo_of(of))
    keys = ["image_id", "r0", "c0"]
    if mask is None and patch_mask is None:
        return pixel_codes(tiles, of, method)
    on, patches = F.lit(None).cast("binary").alias("on"), F.lit(None).cast("array<struct<patch_r:int,patch_c:int,edge:int>>").alias("patches")
    if mask is not None:
        if patch_mask is not None:
            raise ValueError("one mask at a time")
        flags = mask.select("image_id", F.lit(0).alias("channel"), "r", "c", (F.col("m") != 0).cast("int").alias("v"))
        gates = tiles_of_pixels(flags, sizes, side, 0).select(*keys, F.col("data").alias("on"), patches)
    else:
        gates = included_by_tile(patch_mask, side, patch_size).select(*keys, on, "patches")
    tiles = tiles.join(gates, keys, "left").select(*tiles.columns, "on", "patches").withColumn("gate", F.lit(True))
    return pixel_codes(tiles, of, method)


def lbp_codes(pixels: DataFrame, of: Sequence[Run], method: str = "uniform", mask: DataFrame | None = None, patch_mask: DataFrame | None = None, patch_size: int | None = None, plan: str = "auto", edge: int = EDGE) -> DataFrame:
    """image_id, channel, radius_idx, r, c and code of every pixel.

    ``plan`` is "native", "tiled" or "auto" (by the number of pixels and points); both give the same codes.

    ``mask`` (image_id, r, c, m): only pixels with m <> 0 are computed, others have code 0 but remain neighbours. ``patch_mask``
    (image_id, patch_r, patch_c, included) does the same by whole patches of ``patch_size``. The variance method has a
    double, NaN where it is exactly 0.
    """
    method = check(of, method)
    if plan not in ("auto", "native", "tiled"):
        raise ValueError(f"unknown plan {plan!r}")
    chosen = plan
    if plan == "auto":
        plan = "native" if all(r.npoints <= PACKED_POINTS for r in of) and pixels.count() <= PLANE_PIXELS else "tiled"
    if plan == "tiled":
        return _tiled(pixels, of, method, mask, patch_mask, patch_size, edge)
    if any(r.npoints > PACKED_POINTS for r in of):
        raise ValueError(f"the relational plan takes at most {PACKED_POINTS} points")
    if chosen == "native" and (size := pixels.count()) > PLANE_PIXELS:
        raise ValueError(f"there are {size} pixels, the relational plan takes {PLANE_PIXELS}; use the tile plan")
    centres = pixels
    if mask is not None:
        centres = centres.join(mask.filter("m <> 0").select("image_id", "r", "c"), ["image_id", "r", "c"], "left_semi").select(pixels.columns)
    if patch_mask is not None:
        on = patch_mask.filter("included <> 0").select("image_id", "patch_r", "patch_c")
        centres = with_patch(centres, patch_size).join(on, ["image_id", "patch_r", "patch_c"], "left_semi").select(pixels.columns)
    points = samples(pixels, of, centres)
    keys = (*PIXEL, "radius_idx")
    if method == "var":
        t = F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x.t)
        made = points.groupBy(*keys, "br", "bc").agg(t.alias("t"))
        total = "aggregate(t, cast(0 as double), (a, x) -> a + x)"
        squares = "aggregate(t, cast(0 as double), (a, x) -> a + x * x)"
        made = made.select(*keys, F.expr(f"({squares} - {total} * {total} / size(t)) / size(t)").alias("var"))
        made = made.select(*keys, F.when(F.col("var") == 0, F.lit(float("nan"))).otherwise(F.col("var")).alias("code"))
    else:
        s = points.withColumn("s", (F.col("t") - F.col("v") >= 0).cast("int"))
        made = s.groupBy(*keys, "br", "bc", "npoints").agg(
            F.sum(F.expr("shiftleft(cast(s as bigint), i)")).alias("bits"),
            F.sum("s").cast("int").alias("ones"),
            F.min(F.when(F.col("s") == 1, F.col("i"))).alias("first_one"),
            F.min(F.when(F.col("s") == 0, F.col("i"))).alias("first_zero"),
        )
        made = made.select(*keys, code_of(of, method).alias("code"))
    if mask is None and patch_mask is None:
        return made.select("image_id", "channel", "radius_idx", "r", "c", "code")
    every = pixels.select(*PIXEL, F.explode(F.array(*[F.lit(r.index) for r in of])).alias("radius_idx"))
    zero = F.lit(0).cast(made.schema["code"].dataType)
    return every.join(made, list(keys), "left").select("image_id", "channel", "radius_idx", "r", "c", F.coalesce("code", zero).alias("code"))
