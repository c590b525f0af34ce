"""The texture queries by name, over the star-schema tables read as images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionary, names, params
from ..operators import borders, features, lbp, masks
from ..sources import pixels
from .lbp_features import lbp_features

PATCH_SIZE = 16
LADDER = params.runs(params.radii(5))
SMALL = params.runs([1, 2])
R1 = LADDER[:1]
#: Eight points on the unit circle, the classical neighbourhood.
EIGHT = params.runs([1], [8])
ALL_RADII = params.runs(params.radii(15))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.from_embeddings(_table(spark, sf_dir, "embeddings"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.from_lineitem(_table(spark, sf_dir, "lineitem"))


def bright(image: DataFrame) -> DataFrame:
    """A mask with values over 1: how far pixels are above 124."""
    return image.filter("channel = 0").select("image_id", "r", "c", F.greatest(F.col("v") - 124, F.lit(0)).alias("m"))


def _dictionary(frame: DataFrame) -> DataFrame:
    return frame.drop("radius_idx")


def _rectangles(image: DataFrame) -> DataFrame:
    """A 9 by 17 rectangle at each pixel, cut at the image's ends."""
    size = features.image_sizes(image).select("image_id", "h", "w")
    at = image.join(size, "image_id")
    return at.select("image_id", "channel", F.col("r").alias("r0"), F.col("c").alias("c0"), F.least(F.col("r") + 8, F.col("h") - 1).alias("r1"), F.least(F.col("c") + 16, F.col("w") - 1).alias("c1"))


def _border_modes(spark: SparkSession) -> DataFrame:
    cells = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(6))).alias("size")).select("size", F.explode(F.sequence(F.lit(-14), F.lit(14))).alias("pos"))
    return cells.select("size", "pos", *[borders.border_index(F.col("pos"), F.col("size"), m).alias(m) for m in borders.MODES])


def _samples(image: DataFrame) -> DataFrame:
    return lbp.samples(image, R1).select("image_id", "channel", "radius_idx", "r", "c", "i", F.floor(F.col("t") * 1e6).alias("t_micro"))


def _var(image: DataFrame, plan: str = "auto") -> DataFrame:
    codes = lbp.lbp_codes(image, EIGHT, "var", plan=plan)
    micro = F.when(~F.isnan("code"), F.floor(F.col("code") * 1e6))
    return codes.select("image_id", "channel", "radius_idx", "r", "c", micro.alias("code_micro"))


def _histogram(image: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    sizes = features.image_sizes(image).select("image_id", "h", "w")
    codes = lbp.lbp_codes(image, R1)
    codes = masks.complete(codes.join(sizes, "image_id"), PATCH_SIZE, F.col("h"), F.col("w"))
    out = features.patch_histogram(codes, PATCH_SIZE)
    if mask is not None:
        on = masks.patch_mask(mask, PATCH_SIZE, "any").filter("included = 1")
        out = out.join(on, ["image_id", "patch_r", "patch_c"], "left_semi")
    return out


def right_half(image: DataFrame) -> DataFrame:
    """A mask that leaves the left half of the columns out."""
    return image.filter("channel = 0").select("image_id", "r", "c", (F.col("c") >= 32).cast("int").alias("m"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform codes at radius 1 in patch histograms of the embeddings image, zeros included."""
    return lbp_features(embeddings(spark, sf_dir), R1, PATCH_SIZE, plan="native").features


def _multichannel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels of the line items' image, from their positions: the dense table is not made."""
    cells, sizes = pixels.lineitem_cells(_table(spark, sf_dir, "lineitem"))
    return lbp_features(cells, SMALL, 7, plan="cells", sizes=sizes).features


def _joined(vectors: DataFrame) -> DataFrame:
    """Vectors with their counts as text."""
    return vectors.select("image_id", "patch_r", "patch_c", F.array_join(F.col("features").cast("array<string>"), ",").alias("features"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbp_features(embeddings(spark, sf_dir), LADDER, PATCH_SIZE, plan="tiled", output="vector").features


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", names.image_name(F.col("url")).alias("image_name"), names.file_name(names.image_name(F.col("url"))).alias("file_name"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.jobs(spark, 3, LADDER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "radii_ladder": lambda s, d: params.radii_df(s, 15),
    "npoints_ladder": lambda s, d: params.npoints_df(s, 15),
    "neighbour_offsets": lambda s, d: params.offsets_df(s, ALL_RADII).select("radius_idx", "i", (F.col("dy") + 0.0).alias("dy"), (F.col("dx") + 0.0).alias("dx")),
    "feature_dictionary": lambda s, d: _dictionary(dictionary.feature_dict(s, 3, LADDER)),
    "feature_lookup": lambda s, d: _dictionary(dictionary.feature_lookup(s, 3, LADDER, 200)),
    "feature_dictionary_reduced": lambda s, d: _dictionary(dictionary.reduced_feature_dict(s, 3, LADDER, "reduced")),
    "feature_dictionary_minimal": lambda s, d: _dictionary(dictionary.reduced_feature_dict(s, 3, LADDER, "minimal")),
    "code_groups_reduced": lambda s, d: dictionary.code_groups(s, ALL_RADII, "reduced"),
    "code_groups_minimal": lambda s, d: dictionary.code_groups(s, ALL_RADII, "minimal"),
    "reduction_map": lambda s, d: dictionary.reduction_map(s, 3, LADDER, "reduced"),
    "pixels_embeddings": embeddings,
    "pixels_lineitem": lineitem,
    "pixels_events": lambda s, d: pixels.from_events(_table(s, d, "events")),
    "pixels_synthetic": lambda s, d: pixels.synthetic(s, 97, 61, 3, "noise").unionByName(pixels.synthetic(s, 97, 61, 3, "ramp")),
    "patch_extract": lambda s, d: masks.get_patch(embeddings(s, d), PATCH_SIZE, 3, 2),
    "patch_mask_any": lambda s, d: masks.patch_mask(bright(embeddings(s, d)), 2, "any"),
    "patch_mask_all": lambda s, d: masks.patch_mask(bright(embeddings(s, d)), 2, "all"),
    "mask_edit_any": lambda s, d: masks.edit_mask(bright(embeddings(s, d)), 3, "any"),
    "mask_edit_all": lambda s, d: masks.edit_mask(bright(embeddings(s, d)), 3, "all"),
    "bilinear_samples": lambda s, d: _samples(embeddings(s, d)),
    "lbp_uniform_r1": lambda s, d: lbp.lbp_codes(embeddings(s, d), LADDER[:1]),
    "lbp_uniform_r2": lambda s, d: lbp.lbp_codes(embeddings(s, d), LADDER[1:2]),
    "lbp_uniform_r3": lambda s, d: lbp.lbp_codes(embeddings(s, d), LADDER[2:3]),
    "lbp_uniform_pixel_masked": lambda s, d: lbp.lbp_codes(embeddings(s, d), R1, mask=bright(embeddings(s, d))),
    "lbp_uniform_patch_masked": lambda s, d: lbp.lbp_codes(embeddings(s, d), R1, patch_mask=masks.patch_mask(bright(embeddings(s, d)), 2, "all"), patch_size=2),
    "lbp_default": lambda s, d: lbp.lbp_codes(embeddings(s, d), EIGHT, "default"),
    "lbp_ror": lambda s, d: lbp.lbp_codes(embeddings(s, d), EIGHT, "ror"),
    "lbp_nri_uniform": lambda s, d: lbp.lbp_codes(embeddings(s, d), EIGHT, "nri_uniform"),
    "lbp_var": lambda s, d: _var(embeddings(s, d)),
    "patch_histogram": lambda s, d: _histogram(embeddings(s, d)),
    "patch_histogram_masked": lambda s, d: _histogram(embeddings(s, d), right_half(embeddings(s, d))),
    "lbp_features_r1": flagship,
    "lbp_features_long": lambda s, d: lbp_features(embeddings(s, d), LADDER, PATCH_SIZE, plan="native").features,
    "lbp_features_tiled": lambda s, d: lbp_features(embeddings(s, d), LADDER, PATCH_SIZE, plan="tiled").features,
    "lbp_features_masked": lambda s, d: lbp_features(embeddings(s, d), R1, PATCH_SIZE, right_half(embeddings(s, d)), plan="native").features,
    "lbp_features_multichannel": _multichannel,
    "reduce_features_reduced": lambda s, d: features.reduce_features(lbp_features(embeddings(s, d), LADDER, PATCH_SIZE, plan="tiled").features, 1, LADDER, "reduced"),
    "reduce_features_minimal": lambda s, d: features.reduce_features(lbp_features(embeddings(s, d), LADDER, PATCH_SIZE, plan="tiled").features, 1, LADDER, "minimal"),
    "jobs_manifest": lambda s, d: _jobs(s, d).drop("job_rank"),
    "jobs_longest_first": lambda s, d: _jobs(s, d).select("channel", "radius_idx", "radius", "npoints", "job_rank"),
    "rect_sum_integral": lambda s, d: borders.rect_sum(borders.summed_area(embeddings(s, d)), _rectangles(embeddings(s, d))),
    **{f"lbp_{m}_tiled": (lambda s, d, m=m: lbp.lbp_codes(embeddings(s, d), EIGHT, m, plan="tiled")) for m in ("default", "ror", "nri_uniform")},
    "lbp_var_tiled": lambda s, d: _var(embeddings(s, d), "tiled"),
    "lbp_uniform_r3_tiled": lambda s, d: lbp.lbp_codes(embeddings(s, d), LADDER[2:3], plan="tiled"),
    "lbp_uniform_pixel_masked_tiled": lambda s, d: lbp.lbp_codes(embeddings(s, d), R1, mask=bright(embeddings(s, d)), plan="tiled"),
    "lbp_uniform_patch_masked_tiled": lambda s, d: lbp.lbp_codes(embeddings(s, d), R1, patch_mask=masks.patch_mask(bright(embeddings(s, d)), 2, "all"), patch_size=2, plan="tiled"),
    "lbp_features_masked_tiled": lambda s, d: lbp_features(embeddings(s, d), R1, PATCH_SIZE, right_half(embeddings(s, d)), plan="tiled", edge=32).features,
    "lbp_features_vector": lambda s, d: _joined(_vectors(s, d)),
    "reduce_vectors_reduced": lambda s, d: _joined(features.reduce_vectors(_vectors(s, d), 1, LADDER, "reduced")),
    "image_names": _names,
    "jobs_complete": lambda s, d: features.incomplete(_jobs(s, d)),
    "border_modes": lambda s, d: _border_modes(s),
}
