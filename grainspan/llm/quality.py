"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. One scan computes the statistics of every whole text (docstats.py); nothing else is an input of a score.
2. The labelled rows to learn from are those whose crc32(doc_id as text) mod 4 is not 2. Statistics are
   standardised by their mean and deviation over these rows.
3. ``FEATURES`` random cosines approximate a Gaussian kernel. Every partition sums its part of the normal
   equations Z'Z and Z'y, apart for each of ``FOLDS`` folds; sums meet in a tree with a fixed fan-in, so
   the driver receives a fixed number of matrices whatever the size of the input. All labelled rows count.
4. A ridge solution for all folds scores documents; solutions that leave a fold out score that fold's rows, and
   isotonic regression of the labels on those scores, pooled in ``BINS`` bins, calibrates them to 0..1.

Defined results: a null or empty text has statistics of zero and a score like any other; a label that is null
or whose document is missing is not learnt from; a document with several labels counts once for each; a
null doc_id is scored and held out as crc32 of an empty text; without any labels, or with one class only,
every score is the share of label 1, or 1 where there are none. Further columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .docstats import NAMES, statistics, with_statistics
from .scratch import Scratch, table
from .textkit import runs

FEATURES = 192
BANDWIDTH = 5.0
RIDGE = 1e-2
FOLDS = 4
BINS = 512
FAN_IN = 16
THRESHOLD = 0.7
#: Standardised statistics are kept within so many deviations, so that outliers stay near the data.
REACH = 4.0

_rng = np.random.Generator(np.random.PCG64(8192))
_W = _rng.normal(size=(len(NAMES), FEATURES)) / BANDWIDTH
_B = _rng.uniform(0, 2 * np.pi, FEATURES)


def bucket(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def expand(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A constant, the standardised statistics and the random cosines."""
    x = np.clip((stats - mean) / scale, -REACH, REACH)
    return np.concatenate([np.ones((len(x), 1)), x * 0.3, np.sqrt(2 / FEATURES) * np.cos(x @ _W + _B)], 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partial_sums(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    m = 1 + len(NAMES) + FEATURES
    total = np.zeros((FOLDS, m + 1, m + 1))
    for batch in batches:
        z = expand(matrix(batch.column(0)), mean, scale)
        zy = np.concatenate([z, batch.column(1).to_numpy()[:, None]], 1)
        fold = batch.column(2).to_numpy()
        for k in range(FOLDS):
            part = zy[fold == k]
            total[k] += part.T @ part
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            part = np.frombuffer(x.as_buffer(), np.float64)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the nondecreasing fit, scores in ascending order."""
    blocks: list[list[float]] = []
    for s, y, w in zip(score.tolist(), label.tolist(), weight.tolist(), strict=True):
        blocks.append([y, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, _, hi = blocks.pop()
            y1, w1, lo, _ = blocks.pop()
            blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    knots, values = [], []
    for y, _, lo, hi in blocks:
        knots += [lo, hi]
        values += [y, y]
    return np.array(knots), np.array(values)


class Model:
    """Means, scales, ridge weights and calibration knots: a few KB."""

    def __init__(self, mean, scale, weights, knots, values):
        self.mean, self.scale, self.weights, self.knots, self.values = mean, scale, weights, knots, values

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return expand(stats, self.mean, self.scale) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def ridge(sums: np.ndarray) -> np.ndarray:
    a, b = sums[:-1, :-1], sums[:-1, -1]
    penalty = RIDGE * max(1.0, a[0, 0]) * 1e-2 * np.eye(len(a)) + RIDGE * np.eye(len(a))
    penalty[0, 0] = 1e-9
    return np.linalg.solve(a + penalty, b)


def fit(labelled: DataFrame) -> Model:
    """Learns from stats, label (0 or 1) and fold of ``labelled``, a table that can be read again."""
    n = len(NAMES)
    moments = labelled.select(
        F.count("*").alias("n"),
        F.avg("label").alias("share"),
        *[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(n)],
        *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(n)],
    ).first()
    if not moments["n"] or moments["share"] in (0.0, 1.0):
        flat = 1.0 if not moments["n"] else moments["share"]
        return Model(np.zeros(n), np.ones(n), np.zeros(1 + n + FEATURES), np.zeros(1), np.array([flat]))
    mean = np.array([moments[f"m{k}"] for k in range(n)])
    scale = np.array([max(moments[f"s{k}"], 1e-6) for k in range(n)])
    sums = labelled.select("stats", F.col("label").cast("double"), "fold").mapInArrow(lambda b: _partial_sums(b, mean, scale), "sums binary")
    parts = sums.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(_add_up, "sums binary")
    m = 1 + n + FEATURES
    by_fold = sum(np.frombuffer(r.sums, np.float64).reshape(FOLDS, m + 1, m + 1) for r in sums.toLocalIterator())
    total = by_fold.sum(0)
    model = Model(mean, scale, ridge(total), np.zeros(1), np.zeros(1))
    without = [ridge(total - f) for f in by_fold]

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, fold = matrix(batch.column(0)), batch.column(2).to_numpy()
            raw = np.zeros(len(stats))
            for k in range(FOLDS):
                raw[fold == k] = model.raw(stats[fold == k], without[k])
            bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(raw), pa.array(batch.column(1).to_numpy())], ["bin", "raw", "label"])

    pooled = (
        labelled.select("stats", F.col("label").cast("double"), "fold")
        .mapInArrow(out_of_fold, "bin long, raw double, label double")
        .groupBy("bin")
        .agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count("*").alias("n"))
        .orderBy("bin")
        .collect()  # at most BINS rows
    )
    model.knots, model.values = isotonic(*(np.array([r[c] for r in pooled], np.float64) for c in ("raw", "label", "n")))
    return model


def learnt(stats: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """The model, from doc_id and stats of all documents."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    marked = marked.filter((bucket(F.col("doc_id"), 4) != 2) & F.col("label").isin(0, 1))
    fold = F.floor(bucket(F.col("doc_id"), 4 * FOLDS) / 4).cast("long")
    return fit(scratch.save(stats.join(marked, "doc_id").select("stats", "label", fold.alias("fold"))))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``; learns from ``labels`` (doc_id, quality)."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(with_statistics(docs))
    model = learnt(stats, labels, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))))], ["doc_id", "score"])

    out = stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all columns as they were.

    One scan works out the statistics and writes them beside their rows; rows are then picked by them, so that no text is
    shuffled or scanned for statistics again.
    """
    scratch = Scratch(docs.sparkSession, "accepted")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in runs(batch.column(0).field(at)):
                stats = statistics(data, offsets)
                where = pa.array(np.arange(0, stats.size + 1, len(NAMES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(where, pa.array(stats.ravel()))], ["row", "stats"])

    fixed = scratch.save(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("stats", ArrayType(DoubleType()))])))
    model = learnt(fixed.select(F.col("row.doc_id").cast("long").alias("doc_id"), "stats"), labels, scratch)

    @F.arrow_udf(returnType=DoubleType())
    def score(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(stats)))

    return fixed.filter(score("stats") >= THRESHOLD).select("row.*")
