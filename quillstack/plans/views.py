"""The driver's tables as a ledger and a catalog, for the registered queries; the operators themselves run unchanged on them.

ledger: every event, its id as the order. The name of an event that ends in 0 and isn't an error is that of a script, the name of any
other one is its own: so there are executed scripts, pending ones (their event is an error) and ledger rows without a script.
catalog: every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _migration() -> Column:
    own = (F.col("event_id") % 10 != 0) | F.coalesce(F.col("event_type") == "error", F.lit(False))
    return F.when(own, F.concat(F.lit("evt_"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("mig_"), F.floor(F.col("event_id") / 10).cast("string")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        _migration().alias("migration"),
        (F.floor(F.col("event_id") / 100) + 1).cast("int").alias("batch"),
        F.col("ts").alias("executed_at"),
        F.floor("value").cast("int").alias("execution_time"),
        F.sha2("props", 256).alias("checksum"),
    )


def untimed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, without a time where the event is an error."""
    errors = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("bad"))
    rows = ledger(spark, sf_dir)
    return rows.join(errors, "id").select(*(F.when(~F.col("bad"), F.col(c)).alias(c) if c == "executed_at" else c for c in rows.columns))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("mig_"), F.col("doc_id").cast("string")).alias("name"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("filename"), F.sha2("text", 256).alias("checksum"))


def drifting_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, with the catalog's own checksum for rows of small value, so that some scripts drift and others don't."""
    own = catalog(spark, sf_dir).select(F.col("name").alias("migration"), F.col("checksum").alias("own"))
    rows = table(spark, sf_dir, "events").select(_migration().alias("migration"), "value", F.sha2("props", 256).alias("other"))
    return rows.join(own, "migration").select("migration", F.when(F.col("value") < 50, F.col("own")).otherwise(F.col("other")).alias("checksum"))


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the file of a script (filepath, content): its text is the Up section, which goes on after the Down section."""
    d = table(spark, sf_dir, "documents")
    stem = F.concat(F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("doc_id")), "yyyy_MM_dd_HHmmss"), F.lit("_doc_"), F.col("doc_id").cast("string"))
    bad = F.when(F.col("lang") == "de", F.concat(F.lit("x"), stem)).otherwise(stem)  # the German ones have no valid name
    text = F.concat(F.lit("-- head\n-- +migrate Up\n"), F.coalesce("text", F.lit("")), F.lit("\n  -- +migrate Down, if need be\nDROP doc_"), F.col("doc_id").cast("string"), F.lit("\n-- +migrate Up\nlast"))
    return d.select(F.concat(F.lit("scripts/"), F.col("source"), F.lit("/"), bad, F.lit(".sql")).alias("filepath"), F.encode(text, "UTF-8").alias("content"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schemas.EVENTS of all events: each user's scripts applied, reverted (an error) or only intended (a view)."""
    e = table(spark, sf_dir, "events")
    what = F.when(F.col("event_type") == "error", "reverted").when(F.col("event_type") == "view", "intent:up").otherwise("applied")
    return e.select(
        F.col("event_id").alias("seq"), what.alias("event"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("migration"), (F.floor(F.col("event_id") / 100) + 1).cast("int").alias("batch"),
        F.col("ts").alias("executed_at"), F.floor("value").cast("int").alias("execution_time"), F.sha2("props", 256).alias("checksum"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line of the log (value); clicks have another form."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("value") < 20, "DEBUG").when(F.col("value") < 50, "warning").otherwise("INFO")
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), level, F.lit("] ["), F.col("event_type"), F.lit("] "), F.coalesce("props", F.lit("")))
    return e.select(F.when(F.col("event_type") == "click", F.concat(F.lit("no "), line)).otherwise(line).alias("value"))
