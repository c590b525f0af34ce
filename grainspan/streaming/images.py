"""Texture features of images as they arrive in a folder: the same tile plan, batch after batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.params import Run
from ..plans.lbp_features import lbp_features

BANDS = "image_id string, r0 int, height int, width int, channels int, data binary"


def read_band_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Records of image rows from Parquet files that appear in a folder; a file holds whole images."""
    return spark.readStream.schema(BANDS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start_features(bands: DataFrame, of: Sequence[Run], patch_size: int, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the features of each batch to its own folder, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        lbp_features(batch, of, patch_size, plan="bands").features.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return bands.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
