"""Batches as files in batch order, so that one batch is read without the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"


def write_batches(df: DataFrame, path: str, batch_size: int = 16, batches_per_group: int = 64, batch: str = BATCH) -> None:
    """Store a batched table by ranges of the batch, each file in order of it.

    A row group holds at most ``batches_per_group`` batches of ``batch_size`` rows, so a
    reader of one batch opens one or two row groups: the statistics of the others rule them
    out. One range exchange; a batch never lies in two files.
    """
    dealt = df.repartitionByRange(batch).sortWithinPartitions(batch)
    # Parquet's own limits: rows of a group, and how often its size is looked at
    rows = str(batch_size * batches_per_group)
    dealt.write.option("parquet.block.row.count.limit", rows).parquet(path)


def read_batch(spark: SparkSession, path: str, number: int, batch: str = BATCH) -> DataFrame:
    """The rows of one batch."""
    return spark.read.parquet(path).where(F.col(batch) == number)


def read_steps(spark: SparkSession, path: str, first: int, last: int, batch: str = BATCH) -> DataFrame:
    """The rows of a run of batches, both ends included."""
    return spark.read.parquet(path).where(F.col(batch).between(first, last))
