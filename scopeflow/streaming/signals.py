"""Leak signals as a stream, and drift between two snapshots of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def leak_windows(signals: DataFrame, width: str = "1 day", late: str = "1 hour", systems: int = 100) -> DataFrame:
    """Signals per system and window. On a stream, repeated events within the lateness count once and windows close after it."""
    rows = signals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if signals.isStreaming else signals
    rows = rows.dropDuplicatesWithinWatermark(["event_id"]) if signals.isStreaming else rows.dropDuplicates(["event_id"])
    rows = rows.withColumn("system", F.concat(F.lit("S"), F.pmod(F.col("user_id"), F.lit(systems))))
    return rows.groupBy(F.window("ts", width).alias("w"), "system").agg(F.count("*").alias("signals")).select(F.col("w.start").alias("window_start"), "system", "signals")


def scope_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): systems that entered or left scope between two lists of ids."""
    b, a = before.select("id", F.lit(1).alias("b")), after.select("id", F.lit(1).alias("a"))
    return b.join(a, "id", "full_outer").where("a is null or b is null").select("id", F.when(F.col("a").isNull(), "left").otherwise("entered").alias("change"))
