"""NumPy array files as a Spark data source: rows of an array are read in bands by different tasks.

A uint8 file is an image, and its records are image rows. A file of three dimensions and wider integers is a feature cube (rows of
patches, columns of patches, features), and its records are the vectors of patches. The option ``as`` ("image" or "features") decides for
files that could be either.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BAND_BYTES = 16 << 20


class Band(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


IMAGE = "image_id string, r0 int, height int, width int, channels int, data binary"
FEATURES = "image_id string, patch_r int, patch_c int, features array<bigint>"


def kind_of(path: str, wanted: str | None = None) -> str:
    """``image`` or ``features``."""
    array = np.load(path, mmap_mode="r", allow_pickle=False)
    kind = wanted or ("image" if array.dtype == np.uint8 else "features")
    if kind == "image" and (array.ndim not in (2, 3) or array.dtype != np.uint8):
        raise ValueError("an image file must hold uint8 in two or three dimensions")
    if kind == "features" and (array.ndim != 3 or array.dtype.kind not in "iu"):
        raise ValueError("a feature file must hold integers in three dimensions")
    return kind


class NpyReader(DataSourceReader):
    def __init__(self, path: str, band_bytes: int, kind: str):
        self.path, self.band_bytes, self.kind = path, band_bytes, kind

    def partitions(self):
        array = np.load(self.path, mmap_mode="r", allow_pickle=False)
        step = max(1, self.band_bytes // max(1, array[:1].nbytes))
        return [Band(self.path, a, min(len(array), a + step)) for a in range(0, len(array), step)]

    def read(self, partition):
        array = np.load(partition.path, mmap_mode="r", allow_pickle=False)
        name = os.path.basename(self.path)
        part = np.ascontiguousarray(array[partition.start : partition.end])
        if self.kind == "image":
            yield (name, partition.start, array.shape[0], array.shape[1], 1 if array.ndim == 2 else array.shape[2], part.tobytes())
            return
        for r, row in enumerate(part.astype(np.int64)):
            for c, vector in enumerate(row):
                yield (name, partition.start + r, c, vector.tolist())


class NpyDataSource(DataSource):
    """``spark.read.format("npy").load(path)``: records of image rows, as ``bands`` makes them, or vectors of patches. The
    path is in a folder that all executors share."""

    @classmethod
    def name(cls):
        return "npy"

    def _path(self):
        return self.options["path"].removeprefix("file://")

    def schema(self):
        return IMAGE if kind_of(self._path(), self.options.get("as")) == "image" else FEATURES

    def reader(self, schema):
        return NpyReader(self._path(), int(self.options.get("bandBytes", BAND_BYTES)), kind_of(self._path(), self.options.get("as")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyDataSource)


def array_path(path: str) -> str:
    """The absolute path; a name without the ending gets it."""
    return os.path.abspath(path if path.endswith(".npy") else f"{path}.npy")


def write_array(path: str, array: np.ndarray) -> str:
    """Writes an array; a name without the ending gets it. Returns the absolute path."""
    path = array_path(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    np.save(path, array, allow_pickle=False)
    return path
