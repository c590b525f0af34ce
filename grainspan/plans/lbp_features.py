"""The flagship query: multi-radius, multi-channel texture features of all patches of images."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import Run, features_per_channel
from ..operators.features import LONG, PATCH, check_complete, dense, image_sizes, patch_histogram, patches, to_vectors
from ..operators.lbp import PACKED_POINTS, PLANE_PIXELS, lbp_codes
from ..operators.masks import KEYS, complete, patch_mask
from ..operators.tiles import EDGE, edge_of, halo_of, histograms, included_by_tile, masked_tiles, sides, tiles_of_bands, tiles_of_cells, tiles_of_pixels

log = logging.getLogger(__name__)

#: Samples (pixels times points) from which the tile plan is taken.
TILED_FROM = 5_000_000


@dataclass(frozen=True)
class Features:
    """The result: features, and the mask of patches if there was a mask of pixels."""

    features: DataFrame
    patch_mask: DataFrame | None


def lbp_features(
    pixels: DataFrame, of: Sequence[Run], patch_size: int, mask: DataFrame | None = None, mask_method: str = "any", plan: str = "auto", output: str = "long", edge: int = EDGE,
    sizes: DataFrame | None = None,
) -> Features:
    """Features of a pixel table (image_id, channel, r, c, v), of records of image rows (``plan`` "bands"), or of some positions with
    a value for each channel (``plan`` "cells": image_id, r, c, v0, v1, ..., others are 0) and ``sizes`` (image_id, h, w, channels).

    Every complete patch has every feature. A patch that the mask leaves out has zeros; one that it includes is computed
    whole. ``plan`` is "native", "tiled", "bands", "cells" or "auto" (by size); all give the same counts. ``output`` is "long" or
    "vector".
    """
    if patch_size < 1:
        raise ValueError("patch_size must be 1 or more")
    if plan not in ("auto", "native", "tiled", "bands", "cells") or output not in ("long", "vector"):
        raise ValueError("unknown plan or output")
    if (plan == "cells") != (sizes is not None):
        raise ValueError("sizes are given for cells, and only for them")
    if plan == "bands":
        sizes = pixels.groupBy("image_id").agg(F.max("height").alias("h"), F.max("width").alias("w"), F.max("channels").alias("channels"))
    elif plan != "cells":
        sizes = image_sizes(pixels)
    found = sizes.agg(F.max("channels").alias("k"), F.max("h").alias("h"), F.max("w").alias("w"), F.sum(F.col("h").cast("long") * F.col("w") * F.col("channels")).alias("n")).first()
    channels, total = found["k"] or 1, found["n"] or 0  # of all images
    if plan == "auto":
        small = total * sum(r.npoints for r in of) < TILED_FROM and total <= PLANE_PIXELS and all(r.npoints <= PACKED_POINTS for r in of)
        plan = "native" if small else "tiled"
    if mask is not None:
        check_mask(sizes, mask)
    log.info("texture features: %d pixels, %d runs, patches of %d, plan %s", total, len(of), patch_size, plan)
    included = patch_mask(mask, patch_size, mask_method) if mask is not None else None
    every = patches(sizes, patch_size)
    if plan == "native":
        codes = lbp_codes(pixels, of, "uniform", patch_mask=included, patch_size=patch_size)
        codes = complete(codes.join(sizes.select("image_id", "h", "w"), "image_id"), patch_size, F.col("h"), F.col("w"))
        counted = patch_histogram(codes, patch_size)
        if included is not None:
            counted = counted.join(included.filter("included <> 0"), list(KEYS), "left_semi")
        long = dense(counted, every, channels, of)
        return Features(long if output == "long" else to_vectors(long), included)
    side, halo = edge_of(patch_size, edge), halo_of(of)
    if plan == "cells":
        h, w = found["h"] or 0, found["w"] or 0
        rows, cols = sides(patch_size, edge, max(h, 1), max(w, 1)) if included is None else (side, side)
        tiles = tiles_of_cells(pixels, sizes, rows, cols, halo, h, w, channels)
    else:
        tiles = tiles_of_bands(pixels, side, halo) if plan == "bands" else tiles_of_pixels(pixels, sizes, side, halo)
    if included is not None:
        tiles = masked_tiles(tiles, included, side, patch_size)
    counts = histograms(tiles, of, patch_size)
    if output == "vector":
        return Features(_vectors(counts, every, channels, of), included)
    without = None
    if included is not None:  # the patches of tiles that were dropped
        per = side // patch_size
        at = every.withColumns({"r0": F.expr(f"(patch_r div {per}) * {side}").cast("int"), "c0": F.expr(f"(patch_c div {per}) * {side}").cast("int")})
        without = at.join(included_by_tile(included, side, patch_size), ["image_id", "r0", "c0"], "left_anti").select(*PATCH)
    return Features(_long(counts, without, channels, of), included)


def check_mask(sizes: DataFrame, mask: DataFrame) -> None:
    """An error unless every image has a mask of its own height and width, with values of a byte."""
    own = mask.groupBy("image_id").agg((F.max("r") + 1).alias("mh"), (F.max("c") + 1).alias("mw"), F.count("*").alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    bad = sizes.join(own, "image_id", "left").filter("mh is null or mh <> h or mw <> w or n <> cast(h as bigint) * w or lo < 0 or hi > 255").select("image_id").first()
    if bad is not None:
        raise ValueError(f"the mask of {bad.image_id!r} must have the image's height and width and values from 0 to 255")


def _long(counts: DataFrame, without: DataFrame | None, channels: int, of: Sequence[Run]) -> DataFrame:
    """Kernel rows are dense, so nothing is shuffled; patches that no kernel saw (``without``) have zeros."""
    per = features_per_channel(of)
    first = F.element_at(F.array(*[F.lit(r.offset) for r in of]), F.col("radius_idx") + 1)
    keys = [*PATCH, "channel", "radius_idx"]
    rows = counts.select(*keys, "counts")
    if without is not None:
        runs = F.array(*[F.struct(F.lit(ch).alias("channel"), F.lit(r.index).alias("radius_idx"), F.lit(r.bins).alias("bins")) for ch in range(channels) for r in of])
        zeros = without.select(*PATCH, F.explode(runs).alias("b")).select(*PATCH, "b.channel", "b.radius_idx", F.expr("array_repeat(0L, b.bins)").alias("counts"))
        rows = rows.unionByName(zeros)
    joined = rows.select(*keys, F.posexplode("counts").alias("lbp_code", "count"))
    return joined.withColumn("feature_number", (F.col("channel") * per + first + F.col("lbp_code")).cast("int")).select(*LONG)


def _vectors(counts: DataFrame, every: DataFrame, channels: int, of: Sequence[Run]) -> DataFrame:
    """One shuffle of whole histograms by patch."""
    parts = F.array_sort(F.collect_list(F.struct("channel", "radius_idx", "counts")))
    made = counts.groupBy(*PATCH).agg(F.flatten(F.transform(parts, lambda x: x["counts"])).alias("features"))
    total = channels * features_per_channel(of)
    return every.join(made, list(PATCH), "left").select(*PATCH, F.coalesce("features", F.expr(f"array_repeat(0L, {total})")).alias("features"))


def content_key(pixels: DataFrame, of: Sequence[Run], patch_size: int, mask: DataFrame | None = None, mask_method: str = "any") -> str:
    """A name for a result: a hash of the pixels, the mask and all parameters, in any order of rows."""

    def total(df: DataFrame) -> str:
        h = F.xxhash64(*sorted(df.columns))
        row = df.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first()
        return repr(tuple(row))

    words = [total(pixels), repr([(r.radius, r.npoints) for r in of]), str(patch_size), mask_method if mask is not None else "", total(mask) if mask is not None else ""]
    return hashlib.sha256(";".join(words).encode()).hexdigest()[:16]


def cached_features(spark: SparkSession, folder: str, pixels: DataFrame, of: Sequence[Run], patch_size: int, mask: DataFrame | None = None, mask_method: str = "any", **how) -> DataFrame:
    """Features from a Parquet store keyed by content, computed and written once; vectors have a table of their own."""
    vector = how.get("output") == "vector"
    path = f"{folder.rstrip('/')}/{content_key(pixels, of, patch_size, mask, mask_method)}{'-vector' if vector else ''}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        out = lbp_features(pixels, of, patch_size, mask, mask_method, **how).features.write.mode("overwrite")
        (out if vector else out.partitionBy("channel", "radius_idx")).parquet(path)
    return spark.read.parquet(path).select(*((*PATCH, "features") if vector else LONG))


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a feature table. An existing one is an error, or is kept ("ignore") or replaced ("overwrite")."""
    features.write.mode(mode).parquet(path)


def write_manifest(jobs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The job table as CSV with a header, if it is complete."""
    check_complete(jobs).write.mode(mode).option("header", True).csv(path)


def export_npy(vectors: DataFrame, path: str, overwrite: bool = True) -> str:
    """One image's vectors as a (rows, columns, features) array file; rows come to the driver one partition at a time."""
    import os

    import numpy as np

    from ..sources.npy import array_path, write_array

    if not overwrite and os.path.exists(array_path(path)):
        raise FileExistsError(array_path(path))
    size = vectors.agg((F.max("patch_r") + 1).alias("nr"), (F.max("patch_c") + 1).alias("nc"), F.max(F.size("features")).alias("n"), F.countDistinct("image_id").alias("images")).first()
    if size["images"] != 1:
        raise ValueError("one image at a time")
    cube = np.zeros((size["nr"], size["nc"], size["n"]), np.uint32)
    for row in vectors.toLocalIterator():
        cube[row.patch_r, row.patch_c] = row.features
    return write_array(path, cube)


def features_to_npy(
    pixels: DataFrame, of: Sequence[Run], patch_size: int, path: str, mask: DataFrame | None = None, mask_method: str = "any", plan: str = "auto", overwrite: bool = False
) -> tuple[str, DataFrame | None, bool]:
    """Path of the feature file, patch mask, and whether it was written: a file that exists is kept, and nothing is computed."""
    import os

    from ..sources.npy import array_path

    out = array_path(path)
    if os.path.exists(out) and not overwrite:
        log.error("%s exists and is kept", out)
        return out, None, False
    made = lbp_features(pixels, of, patch_size, mask, mask_method, plan, "vector")
    return export_npy(made.features, out), made.patch_mask, True
