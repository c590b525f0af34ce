"""Masks of pixels and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("image_id", "patch_r", "patch_c")


def _method(method: str) -> str:
    if method not in ("any", "all"):
        raise ValueError(f"method must be 'any' or 'all', not {method!r}")
    return method


def with_patch(pixels: DataFrame, patch_size: int) -> DataFrame:
    """Adds patch_r and patch_c."""
    return pixels.withColumns({"patch_r": F.expr(f"r div {patch_size}").cast("int"), "patch_c": F.expr(f"c div {patch_size}").cast("int")})


def complete(pixels: DataFrame, patch_size: int, height, width) -> DataFrame:
    """The pixels of complete patches. ``height`` and ``width`` are columns or numbers."""
    h, w = (x if not isinstance(x, int) else F.lit(x) for x in (height, width))
    return pixels.filter((F.col("r") < F.floor(h / patch_size) * patch_size) & (F.col("c") < F.floor(w / patch_size) * patch_size))


def _stats(mask: DataFrame, patch_size: int) -> DataFrame:
    """Counts by complete patch: a patch is complete if it has all of its pixels."""
    keyed = with_patch(mask, patch_size)
    return keyed.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(F.col("m") == 0).alias("n_zero")).filter(F.col("n") == patch_size * patch_size)


def _included(method: str):
    return (F.col("n_zero") < F.col("n") if _method(method) == "any" else F.col("n_zero") == 0).cast("int")


def patch_mask(mask: DataFrame, patch_size: int, method: str = "any") -> DataFrame:
    """image_id, patch_r, patch_c and included (0 or 1) of a dense pixel mask (image_id, r, c, m).

    ``any``: a patch is included if some pixel is not 0; ``all``: if none is 0. Incomplete patches have no row.
    """
    return _stats(mask, patch_size).select(*KEYS, _included(method).alias("included"))


def edit_mask(mask: DataFrame, patch_size: int, method: str = "any") -> DataFrame:
    """The pixel mask with every complete patch made uniform: wholly set patches keep their values, others become 1
    if included, else 0; pixels outside complete patches keep theirs."""
    stats = _stats(mask, patch_size).select(*KEYS, "n_zero", _included(method).alias("included"))
    joined = with_patch(mask, patch_size).join(stats, list(KEYS), "left")
    m = F.when(F.col("n_zero").isNull() | (F.col("n_zero") == 0), F.col("m")).otherwise(F.col("included"))
    return joined.select("image_id", "r", "c", m.cast("int").alias("m"))


def get_patch(pixels: DataFrame, patch_size: int, patch_r: int, patch_c: int) -> DataFrame:
    """The pixels of one patch; the filter is on r and c, so that it reaches the scan."""
    r, c = patch_r * patch_size, patch_c * patch_size
    return pixels.filter(F.col("r").between(r, r + patch_size - 1) & F.col("c").between(c, c + patch_size - 1))
