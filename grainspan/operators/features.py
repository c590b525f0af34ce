"""Patch histograms of codes, dense feature tables and vectors, and their reduction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dictionary import MIN_FEATURES, feature_dict, reduction_map
from ..functions.params import Run, features_per_channel, runs_df
from .masks import with_patch

PATCH = ("image_id", "patch_r", "patch_c")
LONG = (*PATCH, "channel", "radius_idx", "lbp_code", "feature_number", "count")


def patch_histogram(codes: DataFrame, patch_size: int) -> DataFrame:
    """image_id, channel, radius_idx, patch_r, patch_c, lbp_code and count of the codes that occur in patches."""
    keyed = with_patch(codes, patch_size)
    return keyed.groupBy("image_id", "channel", "radius_idx", "patch_r", "patch_c", F.col("code").cast("int").alias("lbp_code")).agg(F.count("*").alias("count"))


def image_sizes(pixels: DataFrame) -> DataFrame:
    """image_id, h, w and channels."""
    return pixels.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), (F.max("channel") + 1).alias("channels"))


def patches(sizes: DataFrame, patch_size: int) -> DataFrame:
    """image_id, patch_r and patch_c of all complete patches."""
    full = sizes.select("image_id", F.floor(F.col("h") / patch_size).cast("int").alias("nr"), F.floor(F.col("w") / patch_size).cast("int").alias("nc")).filter("nr > 0 and nc > 0")
    rows = full.select("image_id", "nc", F.explode(F.expr("sequence(0, nr - 1)")).alias("patch_r"))
    return rows.select("image_id", "patch_r", F.explode(F.expr("sequence(0, nc - 1)")).alias("patch_c"))


def dense(histogram: DataFrame, every_patch: DataFrame, channels: int, of: Sequence[Run]) -> DataFrame:
    """The long feature table: each patch has every feature, with 0 for codes that did not occur."""
    per = features_per_channel(of)
    bins = F.array(*[F.struct(F.lit(ch).alias("channel"), F.lit(r.index).alias("radius_idx"), F.lit(r.bins).alias("bins"), F.lit(ch * per + r.offset).alias("first")) for ch in range(channels) for r in of])
    full = every_patch.select(*PATCH, F.explode(bins).alias("b")).select(*PATCH, "b.*", F.explode(F.expr("sequence(0, b.bins - 1)")).alias("lbp_code"))
    keys = [*PATCH, "channel", "radius_idx", "lbp_code"]
    joined = full.join(histogram, keys, "left")
    return joined.select(*keys, (F.col("first") + F.col("lbp_code")).cast("int").alias("feature_number"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count")).select(*LONG)


def to_vectors(long: DataFrame) -> DataFrame:
    """image_id, patch_r, patch_c and features, in the order of feature numbers."""
    pairs = F.array_sort(F.collect_list(F.struct("feature_number", "count")))
    return long.groupBy(*PATCH).agg(F.transform(pairs, lambda x: x["count"]).alias("features"))


def from_vectors(vectors: DataFrame, channels: int, of: Sequence[Run]) -> DataFrame:
    """The long table of vectors."""
    names = feature_dict(vectors.sparkSession, channels, of).select("feature_number", "channel", "radius_idx", "lbp_code")
    long = vectors.select(*PATCH, F.posexplode("features").alias("feature_number", "count"))
    return long.join(F.broadcast(names), "feature_number").select(*LONG)


def reduce_features(long: DataFrame, channels: int, of: Sequence[Run], method: str = "reduced", min_features: int = MIN_FEATURES) -> DataFrame:
    """image_id, patch_r, patch_c, feature_number and count after merging codes by group."""
    to = reduction_map(long.sparkSession, channels, of, method, min_features)
    merged = long.join(F.broadcast(to), "feature_number").groupBy(*PATCH, "new_feature_number").agg(F.sum("count").alias("count"))
    return merged.select(*PATCH, F.col("new_feature_number").alias("feature_number"), "count")


def reduce_vectors(vectors: DataFrame, channels: int, of: Sequence[Run], method: str | None = "reduced", min_features: int = MIN_FEATURES) -> DataFrame:
    """Vectors after merging, without a shuffle: each new position sums its old ones. No method: unchanged."""
    if method is None:
        return vectors
    from ..functions.dictionary import reduced_size

    at, sums = 0, []
    for _ in range(channels):
        for run, size in zip(of, reduced_size(of, method, min_features), strict=True):
            groups: list[list[int]] = [[] for _ in range(size)]
            for code in range(run.bins):
                groups[code if size == run.bins else _group(code, run.npoints, method)].append(at + code)
            sums += [" + ".join(f"features[{k}]" for k in g) if g else "0L" for g in groups]
            at += run.bins
    return vectors.select(*PATCH, F.expr(f"array({', '.join(sums)})").alias("features"))


def _group(code: int, p: int, method: str) -> int:
    fifth = 5 if code == p + 1 else next((j - 1 for j in range(1, 5) if code <= j * p // 5), 4)
    return fifth if method == "reduced" else (0, 1, 2, 1, 0, 3)[fifth]


def jobs(spark, channels: int, of: Sequence[Run]) -> DataFrame:
    """The work of a query by channel and run, with its features' place and a rank by cost: large radii first."""
    from pyspark.sql import Window

    per = features_per_channel(of)
    out = runs_df(spark, of).select(F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"), "radius_idx", "radius", "npoints", "feature_offset")
    out = out.select("channel", "radius_idx", "radius", "npoints", (F.col("npoints") + 2).alias("nfeatures"), (F.col("channel") * per + F.col("feature_offset")).cast("int").alias("output_offset"), F.lit(channels * per).alias("total_nfeatures"))
    order = Window.orderBy(F.desc("radius"), F.desc("channel"), F.desc("radius_idx"))  # channels * runs rows
    return out.withColumn("job_rank", F.row_number().over(order))


def incomplete(jobs: DataFrame) -> DataFrame:
    """n_jobs and n_incomplete: rows, and those with a null in any column."""
    some = F.lit(False)
    for c in jobs.columns:
        some = some | F.col(c).isNull()
    return jobs.agg(F.count("*").alias("n_jobs"), F.count_if(some).alias("n_incomplete"))


def check_complete(jobs: DataFrame) -> DataFrame:
    """The job table; an error if a job lacks a value."""
    bad = incomplete(jobs).first()["n_incomplete"]
    if bad:
        raise ValueError(f"{bad} jobs lack a value")
    return jobs
