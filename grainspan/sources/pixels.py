"""Dense pixel tables (image_id, channel, r, c, v): from tables, arrays, image files and arithmetic.

A pixel table is dense: every position of a height * width rectangle has one row in each channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "image_id string, channel int, r int, c int, v int"
COLUMNS = ("image_id", "channel", "r", "c", "v")
#: Rows of an array that travel in one record.
BAND_ROWS = 64


def _pixels(df: DataFrame, image_id: str, channel: Column, r: Column, c: Column, v: Column) -> DataFrame:
    return df.select(F.lit(image_id).alias("image_id"), channel.cast("int").alias("channel"), r.cast("int").alias("r"), c.cast("int").alias("c"), v.cast("int").alias("v"))


def grid(spark: SparkSession, height: int, width: int, channels: int = 1) -> DataFrame:
    """channel, r and c of every position: rows are dealt out, a row's positions are made where it is."""
    out = spark.range(height).select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c"))
    return out.select(F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"), "r", "c")


def densify(some: DataFrame, image_id: str, height: int, width: int, channels: int = 1) -> DataFrame:
    """A pixel table from channel, r, c and v of some positions; others are 0."""
    joined = grid(some.sparkSession, height, width, channels).join(some, ["channel", "r", "c"], "left")
    return _pixels(joined, image_id, F.col("channel"), F.col("r"), F.col("c"), F.coalesce("v", F.lit(0)))


def from_embeddings(vectors: DataFrame) -> DataFrame:
    """A vector is an image row: r is its id, c the component, -1..1 becomes 0..255."""
    parts = vectors.select("vec_id", F.posexplode("embedding").alias("c", "e"))
    return _pixels(parts, "embeddings", F.lit(0), F.col("vec_id"), F.col("c"), F.floor((F.col("e").cast("double") + 1.0) * 127.5))


def _lineitem_values() -> list[Column]:
    return [F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")]


def _lineitem_height(lineitem: DataFrame) -> int:
    return lineitem.agg(F.max("l_orderkey")).first()[0] + 1


def from_lineitem(lineitem: DataFrame, rows: int | None = None) -> DataFrame:
    """Orders down, lines across; channels are quantity, discount and tax in per cent. ``rows`` limits the image's height."""
    if rows is not None:
        lineitem = lineitem.filter(F.col("l_orderkey") < rows)
    height = rows if rows is not None else _lineitem_height(lineitem)
    cell = lineitem.groupBy(F.col("l_orderkey").cast("int").alias("r"), (F.col("l_linenumber") - 1).cast("int").alias("c")).agg(*[F.max(v).alias(f"v{k}") for k, v in enumerate(_lineitem_values())])
    some = cell.select("r", "c", F.posexplode(F.array("v0", "v1", "v2")).alias("channel", "v"))
    return densify(some, "lineitem", int(height), 7, 3)


def lineitem_cells(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The image of ``from_lineitem`` as positions with a value for each channel (image_id, r, c, v0, v1, v2), where the largest
    of a position counts and others are 0, and its size (image_id, h, w, channels)."""
    r, c = F.col("l_orderkey").cast("int").alias("r"), (F.col("l_linenumber") - 1).cast("int").alias("c")
    cells = lineitem.select(F.lit("lineitem").alias("image_id"), r, c, *[F.coalesce(v, F.lit(0)).alias(f"v{k}") for k, v in enumerate(_lineitem_values())])
    size = f"'lineitem' as image_id, {int(_lineitem_height(lineitem))} as h, 7 as w, 3 as channels"
    return cells, lineitem.sparkSession.range(1).selectExpr(*size.split(", "))


def from_events(events: DataFrame) -> DataFrame:
    """Users down, hours since 2024 across, 60 for each event up to 255."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000).cast("int")
    some = events.groupBy(F.col("user_id").cast("int").alias("r"), hour.alias("c")).agg(F.least(F.lit(255), 60 * F.count("*")).cast("int").alias("v"))
    size = some.agg(F.max("r"), F.max("c")).first()
    return densify(some.select(F.lit(0).alias("channel"), "r", "c", "v"), "events", size[0] + 1, size[1] + 1)


def synthetic(spark: SparkSession, height: int, width: int, channels: int = 1, kind: str = "noise") -> DataFrame:
    """A deterministic image from integer arithmetic: ``noise`` or ``ramp``."""
    values = {
        "noise": "cast(((cast(r as bigint) * 1103515245 + cast(c as bigint) * 1664525 + cast(r as bigint) * c * 22695477 + cast(channel as bigint) * 2654435761) div 65536) % 256 as int)",
        "ramp": "(3 * r + 5 * c + 17 * channel) % 256",
    }
    if kind not in values:
        raise ValueError(f"kind must be one of {sorted(values)}")
    return _pixels(grid(spark, height, width, channels), f"synthetic_{kind}", F.col("channel"), F.col("r"), F.col("c"), F.expr(values[kind]))


def disk_mask(spark: SparkSession, height: int, width: int, radius: int, image_id: str) -> DataFrame:
    """image_id, r, c and m: 1 within ``radius`` of the middle."""
    inside = (F.col("r") - height // 2) * (F.col("r") - height // 2) + (F.col("c") - width // 2) * (F.col("c") - width // 2) < radius * radius
    return grid(spark, height, width).select(F.lit(image_id).alias("image_id"), "r", "c", inside.cast("int").alias("m"))


def bands(spark: SparkSession, array: np.ndarray, image_id: str) -> DataFrame:
    """An (h, w) or (h, w, channels) uint8 array as records of image rows."""
    array = np.asarray(array)
    if array.dtype != np.uint8 or array.ndim not in (2, 3):
        raise TypeError("an image is a uint8 array of two or three dimensions")
    if array.ndim == 2:
        array = array[:, :, None]
    h, w, k = array.shape
    rows = [(image_id, r0, h, w, k, np.ascontiguousarray(array[r0 : r0 + BAND_ROWS]).tobytes()) for r0 in range(0, h, BAND_ROWS)]
    return spark.createDataFrame(rows, "image_id string, r0 int, height int, width int, channels int, data binary")


def from_bands(of: DataFrame) -> DataFrame:
    """A pixel table from records of image rows, channels interleaved, in SQL: a byte's two hex digits."""
    n = F.octet_length("data").cast("int")
    at = of.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).filter(n > 0)
    v = F.conv(F.hex(F.expr("substring(data, k + 1, 1)")), 16, 10).cast("int")
    r = F.col("r0") + F.expr("k div (width * channels)")
    return at.select("image_id", F.expr("cast(k % channels as int)").alias("channel"), r.cast("int").alias("r"), F.expr("cast((k div channels) % width as int)").alias("c"), v.alias("v"))


def from_numpy(spark: SparkSession, array: np.ndarray, image_id: str = "array") -> DataFrame:
    return from_bands(bands(spark, array, image_id))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Records of whole images from files that Spark's image source decodes; channels in the order red, green, blue."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    name = F.element_at(F.split("origin", "/"), -1)
    records = raw.select(name.alias("image_id"), F.lit(0).alias("r0"), "height", "width", F.col("nChannels").alias("channels"), "data")
    return records.mapInArrow(_red_first, "image_id string, r0 int, height int, width int, channels int, data binary")


def _red_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The source gives blue, green, red."""
    for batch in batches:
        out = []
        for k, data in zip(batch.column(4).to_pylist(), batch.column(5), strict=True):
            a = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, k).copy()
            if k >= 3:
                a[:, [0, 2]] = a[:, [2, 0]]
            out.append(a.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], batch.schema.names)


def write_sample_image(spark: SparkSession, path: str, height: int, width: int, channels: int = 1) -> str:
    """Writes synthetic noise as one ``.npy`` file, if it is not there yet, and returns the path.

    ``channels`` is 1 or 3; the noise is arithmetic, so that every run has the same.
    """
    from .npy import write_array

    if channels not in (1, 3):
        raise ValueError("channels must be 1 or 3")
    import os

    if not os.path.exists(path):
        write_array(path, _noise(height, width, channels))
    return os.path.abspath(path)


def _noise(height: int, width: int, channels: int) -> np.ndarray:
    r, c, k = np.meshgrid(np.arange(height, dtype=np.int64), np.arange(width, dtype=np.int64), np.arange(channels, dtype=np.int64), indexing="ij")
    return (((r * 1103515245 + c * 1664525 + r * c * 22695477 + k * 2654435761) // 65536) % 256).astype(np.uint8)


def create_sample_image(spark: SparkSession, height: int, width: int, channels: int, kind: str, folder: str) -> str:
    """Writes synthetic noise as an image file (png, jpg or tiff) of one or three channels, if it is not there yet, by the JVM's own
    codecs. Returns the absolute path."""
    import os

    if kind not in ("png", "jpg", "tiff"):
        raise ValueError("kind must be png, jpg or tiff")
    if channels not in (1, 3):
        raise ValueError("channels must be 1 or 3")
    path = os.path.abspath(f"{folder}/img_{'rgb' if channels == 3 else 'gray'}_{height}x{width}.{kind}")
    if os.path.exists(path):
        return path
    os.makedirs(os.path.dirname(path), exist_ok=True)
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 5 if channels == 3 else 10)  # 3BYTE_BGR, BYTE_GRAY
    # Data elements are in the order of bands: red, green, blue.
    image.getRaster().setDataElements(0, 0, width, height, _noise(height, width, channels).tobytes())
    if not jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(path)):
        raise OSError(f"no codec for {kind}")
    return path


def load_sample_image(spark: SparkSession, height: int, width: int, channels: int, kind: str, folder: str, create: bool = True) -> DataFrame:
    """Records of the sample image, which is written first if it is missing and ``create`` is set."""
    import os

    path = f"{folder}/img_{'rgb' if channels == 3 else 'gray'}_{height}x{width}.{kind}"
    if create:
        path = create_sample_image(spark, height, width, channels, kind, folder)
    elif not os.path.exists(path):
        raise FileNotFoundError(path)
    return read_images(spark, path)
