"""Where written intermediates go, and how many partitions a shuffle has."""

from __future__ import annotations

from pyspark.sql import SparkSession

from scopeflow.storage import kept, kept_at, remove, scratch, shared_dir, unused, written

__all__ = ["bounded_batches", "kept", "kept_at", "parallelism", "remove", "scratch", "shared_dir", "unused", "written"]


BATCH_BYTES = 8 << 20


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_batches(spark: SparkSession) -> None:
    """From now on, batches that go to Python hold BATCH_BYTES at most, or one row: with ten thousand rows, their size would grow with the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64m"):  # nobody has chosen another
        spark.conf.set(key, str(BATCH_BYTES))
