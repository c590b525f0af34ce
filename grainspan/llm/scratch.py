"""Shared-folder tables that cut lineage, and reading of the input tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests, local mode) a temporary folder of this machine is set.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='grainspan-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_made = threading.local()


@contextlib.contextmanager
def collecting() -> Iterator[list]:
    """A list that gets all scratch folders which this thread makes meanwhile, so that who runs an operator can clear them."""
    outer, _made.now = getattr(_made, "now", None), []
    try:
        yield _made.now
    finally:
        if outer is not None:
            outer.extend(_made.now)
        _made.now = outer


class Scratch:
    """Tables of one run of an operator, written as Parquet to the shared folder.

    A written table survives the loss of executors and cuts the lineage before it. ``drop`` removes
    one that later steps no longer read; whatever is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if getattr(_made, "now", None) is not None:
            _made.now.append(self)
        atexit.register(self._quiet_drop, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def clear(self) -> None:
        """Removes all tables; for results that are written elsewhere."""
        self._drop(self.root)

    def drop(self, df: DataFrame) -> None:
        self._drop(df.scratch_path)

    def _drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _quiet_drop(self, path: str) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._drop(path)
            except Exception:  # the JVM may have ended before the driver's Python
                return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
