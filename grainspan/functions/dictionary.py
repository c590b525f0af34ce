"""Names and groups of features: what each position of a feature vector means, and how positions are merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .params import Run, features_per_channel, runs_df

MIN_FEATURES = 12
#: Groups of codes by method, in the order of the reduced vector.
GROUPS = {
    "reduced": ("flat_lo", "corner_lo", "edge", "corner_hi", "flat_hi", "nonuniform"),
    "minimal": ("flat", "corner", "edge", "nonuniform"),
}


def _method(method: str) -> str:
    if method not in GROUPS:
        raise ValueError(f"method must be one of {sorted(GROUPS)}, not {method!r}")
    return method


def feature_dict(spark: SparkSession, channels: int, of: Sequence[Run]) -> DataFrame:
    """One row a feature: channel after channel, run after run, code after code."""
    per = features_per_channel(of)
    codes = runs_df(spark, of).withColumn("lbp_code", F.explode(F.expr("sequence(0, npoints + 1)")))
    every = spark.range(channels).select(F.col("id").cast("int").alias("channel")).crossJoin(F.broadcast(codes))
    number = (F.col("channel") * per + F.col("feature_offset") + F.col("lbp_code")).cast("int")
    return every.select(
        number.alias("feature_number"),
        "channel",
        "radius_idx",
        "radius",
        "npoints",
        "lbp_code",
        F.format_string("%d_ch%d_r%s_p%d_lbp%d", number, "channel", "radius_label", "npoints", "lbp_code").alias("label"),
    )


def feature_lookup(spark: SparkSession, channels: int, of: Sequence[Run], number: int) -> DataFrame:
    """The row of one feature."""
    total = channels * features_per_channel(of)
    if not 0 <= number < total:
        raise ValueError(f"feature numbers go from 0 to {total - 1}")
    return feature_dict(spark, channels, of).filter(F.col("feature_number") == number)


def group_index(code: Column, npoints: Column, method: str) -> Column:
    """The group of a code: fifths of the circle by the number of ones, then what is not uniform."""
    at = lambda j: F.floor(npoints * j / 5)
    fifth = F.when(code == npoints + 1, 5).when(code <= at(1), 0).when(code <= at(2), 1).when(code <= at(3), 2).when(code <= at(4), 3).otherwise(4)
    if method == "reduced":
        return fifth.cast("int")
    return F.element_at(F.array(*[F.lit(g) for g in (0, 1, 2, 1, 0, 3)]), fifth + 1).cast("int")


def code_groups(spark: SparkSession, of: Sequence[Run], method: str = "reduced", min_features: int = MIN_FEATURES) -> DataFrame:
    """npoints, lbp_code, group_idx and group_name of every distinct number of points.

    Runs with fewer than ``min_features`` bins are not merged: each code is its own group, without a name.
    """
    names = F.array(*[F.lit(g) for g in GROUPS[_method(method)]])
    points = runs_df(spark, of).select("npoints").distinct().withColumn("lbp_code", F.explode(F.expr("sequence(0, npoints + 1)")))
    whole = F.col("npoints") + 2 < min_features
    group = group_index(F.col("lbp_code"), F.col("npoints"), method)
    return points.select("npoints", "lbp_code", F.when(whole, F.col("lbp_code")).otherwise(group).cast("int").alias("group_idx"), F.when(~whole, F.element_at(names, group + 1)).alias("group_name"))


def reduced_size(of: Sequence[Run], method: str, min_features: int = MIN_FEATURES) -> list[int]:
    return [r.bins if r.bins < min_features else len(GROUPS[_method(method)]) for r in of]


def reduced_runs(spark: SparkSession, of: Sequence[Run], method: str, min_features: int) -> DataFrame:
    rows, offset = [], 0
    for r, n in zip(of, reduced_size(of, method, min_features), strict=True):
        rows.append((r.index, offset))
        offset += n
    return spark.createDataFrame(rows, "radius_idx int, new_offset int")


def reduction_map(spark: SparkSession, channels: int, of: Sequence[Run], method: str = "reduced", min_features: int = MIN_FEATURES) -> DataFrame:
    """feature_number to new_feature_number: the sparse form of a block-diagonal reduction."""
    per = sum(reduced_size(of, method, min_features))
    joined = (
        feature_dict(spark, channels, of)
        .join(F.broadcast(code_groups(spark, of, method, min_features)), ["npoints", "lbp_code"])
        .join(F.broadcast(reduced_runs(spark, of, method, min_features)), "radius_idx")
    )
    return joined.select("feature_number", (F.col("channel") * per + F.col("new_offset") + F.col("group_idx")).cast("int").alias("new_feature_number"))


def reduced_feature_dict(spark: SparkSession, channels: int, of: Sequence[Run], method: str = "reduced", min_features: int = MIN_FEATURES) -> DataFrame:
    """One row a feature after reduction; merged ones have a type, others a code."""
    per = sum(reduced_size(of, method, min_features))
    groups = code_groups(spark, of, method, min_features).select("npoints", "group_idx", "group_name").distinct()
    rows = runs_df(spark, of).join(F.broadcast(groups), "npoints").join(F.broadcast(reduced_runs(spark, of, method, min_features)), "radius_idx")
    every = spark.range(channels).select(F.col("id").cast("int").alias("channel")).crossJoin(F.broadcast(rows))
    number = (F.col("channel") * per + F.col("new_offset") + F.col("group_idx")).cast("int")
    code = F.when(F.col("group_name").isNull(), F.col("group_idx"))
    tail = F.when(F.col("group_name").isNull(), F.col("group_idx").cast("string")).otherwise(F.concat(F.lit("_"), "group_name"))
    return every.select(
        number.alias("feature_number"),
        "channel",
        "radius_idx",
        "radius",
        "npoints",
        code.alias("lbp_code"),
        F.col("group_name").alias("lbp_code_type"),
        F.format_string("%d_ch%d_r%s_p%d_lbp%s", number, "channel", "radius_label", "npoints", tail).alias("label"),
    )
