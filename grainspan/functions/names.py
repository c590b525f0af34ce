"""Names of images and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_name(name: Column) -> Column:
    """A name without dots and hyphens, which stand for endings and parameters: each becomes an underscore."""
    return F.translate(name, ".-", "__")


def file_name(name: Column) -> Column:
    """A file's name with the ending of an array file."""
    return F.when(F.endswith(name, F.lit(".npy")), name).otherwise(F.concat(name, F.lit(".npy")))
