"""Radii, numbers of points, neighbour offsets and runs: the small parameter relations of a texture query."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_POINTS = 65_529


@dataclass(frozen=True)
class Run:
    """One (radius, points) pair; ``offset`` is where its bins begin within a channel's features.

    ``label`` is the radius as it was given, for feature names.
    """

    index: int
    radius: float
    npoints: int
    offset: int
    label: str

    @property
    def bins(self) -> int:
        return self.npoints + 2


def radii(n: int = 15) -> list[int]:
    """A geometric ladder of radii."""
    return [round(1.499 * 1.327**x) for x in range(n)]


def npoints(radius: float | Iterable[float]) -> int | list[int]:
    """Points for a radius, one for each unit of circumference; a list for several radii."""
    if isinstance(radius, str) or not isinstance(radius, int | float | np.number | Iterable):
        raise TypeError("a radius is a number")
    if isinstance(radius, Iterable):
        return [npoints(r) for r in radius]
    return math.ceil(2 * math.pi * radius)


def runs(radius: Sequence[float], points: Sequence[int] | None = None) -> list[Run]:
    """Runs in the order given; equal radii stay apart by their index."""
    points = npoints(radius) if points is None else points
    if len(radius) != len(points) or not len(radius):
        raise ValueError("as many numbers of points as radii are needed, one at least")
    out, offset = [], 0
    for k, (r, p) in enumerate(zip(radius, points, strict=True)):
        if not 0 < p <= MAX_POINTS or r <= 0:
            raise ValueError(f"run {k}: the radius must be positive and the points from 1 to {MAX_POINTS}")
        out.append(Run(k, float(r), int(p), offset, str(r)))
        offset += int(p) + 2
    return out


def offsets(run: Run) -> list[tuple[float, float]]:
    """(dy, dx) of the points, counter-clockwise from the east, rounded to five decimals."""
    angle = 2 * np.pi * np.arange(run.npoints, dtype=np.float64) / run.npoints
    dy, dx = np.round(-run.radius * np.sin(angle), 5), np.round(run.radius * np.cos(angle), 5)
    return list(zip(dy.tolist(), dx.tolist(), strict=True))


def features_per_channel(of: Sequence[Run]) -> int:
    return sum(run.bins for run in of)


def radii_df(spark: SparkSession, n: int = 15) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("radius_idx"), F.round(1.499 * F.pow(F.lit(1.327), F.col("id"))).cast("int").alias("radius"))


def npoints_df(spark: SparkSession, n: int = 15) -> DataFrame:
    return radii_df(spark, n).withColumn("npoints", F.ceil(2 * F.pi() * F.col("radius")).cast("int"))


def runs_df(spark: SparkSession, of: Sequence[Run]) -> DataFrame:
    rows = [(r.index, r.radius, r.npoints, r.offset, r.label) for r in of]
    return spark.createDataFrame(rows, "radius_idx int, radius double, npoints int, feature_offset int, radius_label string")


def offsets_df(spark: SparkSession, of: Sequence[Run]) -> DataFrame:
    """radius_idx, i, dy and dx, from the runs by SQL functions."""
    turn = 2 * F.pi() * F.col("i") / F.col("npoints")
    points = runs_df(spark, of).select("radius_idx", "radius", "npoints", F.explode(F.sequence(F.lit(0), F.col("npoints") - 1)).alias("i"))
    return points.select("radius_idx", "i", F.round(-F.col("radius") * F.sin(turn), 5).alias("dy"), F.round(F.col("radius") * F.cos(turn), 5).alias("dx"))
