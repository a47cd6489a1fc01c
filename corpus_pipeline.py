"""The corpus pipeline: good pages, without repeated lines, near copies and benchmark texts, as pieces."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import cotrain, jaccard_join, line_dedup, qgram_decon, sp_sample
from lodeseek.workspace import saved, work_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Bytes of an Arrow batch, which a task holds as it fills it and its worker as it reads it;
# by Spark's own 64 MB they take as much memory as what the stages do with them.
BATCH = "8m"

# What a step has shuffled goes when it is written. Else it lies on the executors' disks until
# the driver happens to collect its garbage, which many steps of a large run come before.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def in_small_batches(stage: Stage) -> Stage:
    """The stage with smaller Arrow batches, and shuffled rows that go with the step they are for.

    The session keeps both settings, results do not depend on them.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(CLEANUP, "true")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views do not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.accepted(docs, cotrain.learn(docs, labels))


@in_small_batches
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has, and without those left empty by that."""
    return line_dedup.dedup_lines(docs, work_path(spark, "pipeline-lines"), drop_empty=True)


@in_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Copies have lost the lines they share by now, so groups are small and one round of
    pivots is enough before the rest is compared; the result is the same for any number.
    """
    return jaccard_join.representatives(docs, work_path(spark, "pipeline-near"), rounds=1)


@in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark text."""
    return qgram_decon.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, where it has as many."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    drawn = sp_sample.sample(docs, model, ["doc_id"])
    return drawn.withColumn("n_pieces", F.size("ids"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", as_pieces),
]

#: Trained views, components and sampling have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each on what the one before it wrote."""
    folder = work_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
