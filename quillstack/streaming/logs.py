"""The log as a stream: new lines of a folder of log files, parsed and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import at_least, parsed


def log_stream(spark: SparkSession, folder: str, level: str = "debug") -> DataFrame:
    """Entries of `level` or above, as files come into the folder."""
    return parsed(spark.readStream.text(folder)).where(at_least(level))


def level_counts(entries: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Entries for each window and level; entries later than `late` are dropped by the watermark, so the state stays bounded."""
    return entries.withWatermark("ts", late).groupBy(F.window("ts", window), "level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "level", "n")
