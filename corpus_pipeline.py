"""A corpus from raw documents: quality, near-duplicates, decontamination, mixing, shards.

Each stage works on all that the stage before kept, which is written as Parquet to the shared folder and read
again, so a lost executor repeats no earlier stage. A run owns its tables: it removes those of a stage once the stage's rows are
written, and never those of another run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainspan.llm import decontaminate, mixing, neardup, quality, sharding
from grainspan.llm.scratch import Scratch, collecting, table


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate towards the target weights says: plain ones once, toxic ones down to their target."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), mixing.FILTERED_TARGETS, domain=mixing.FILTERED_DOMAIN)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot."""
    return sharding.with_places(docs)


STAGES = [
    ("quality classifier", by_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", to_target_mix),
    ("sharding", in_shards),
]

#: Trained stages have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, work) in enumerate(STAGES[:-1]):
        before = docs
        with collecting() as made:
            docs = scratch.save(work(spark, docs, sf_dir))
        for s in made:
            s.clear()
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
