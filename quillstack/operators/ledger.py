"""Queries over a catalog of scripts and a ledger of what was applied: DataFrames in, DataFrames out, nothing is collected.

catalog has at least name and filename, ledger has quillstack.schemas.LEDGER. Both may be empty. The side that Catalyst broadcasts is
its own choice, by size; no hints are given, so a ledger or catalog of any size works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import short_checksum
from ..functions.times import display_timestamp

_PLACE = "filepath"


def _order(catalog: DataFrame) -> list[str]:
    """filename, with filepath for equal ones in several folders."""
    return ["filename", *([_PLACE] if _PLACE in catalog.columns else [])]


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, so that extra columns of theirs never clash with it."""
    known = {c.lower() for df in frames for c in df.columns}
    while name in known:
        name += "_"
    return name


def listing(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(*_order(catalog))


def executed(ledger: DataFrame) -> DataFrame:
    return ledger.select("id", "migration", "batch", "executed_at", "execution_time", "checksum").orderBy("id")


def one_per_name(catalog: DataFrame) -> DataFrame:
    """The last script, in order, of each name."""
    w = Window.partitionBy("name").orderBy(*(F.desc(c) for c in _order(catalog)))
    place = fresh("place", catalog)
    return catalog.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def pending(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Scripts that aren't in the ledger, in order; names that come twice are both kept."""
    done = fresh("done", catalog)
    return catalog.join(ledger.select(F.col("migration").alias(done)), F.col("name") == F.col(done), "left_anti").orderBy(*_order(catalog))


def orphans(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows without a script, the latest first. An addition: rollbacks drop these without a word."""
    known = fresh("known", ledger)
    return ledger.join(catalog.select(F.col("name").alias(known)), F.col("migration") == F.col(known), "left_anti").orderBy(F.desc("id"))


def status(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every script, with executed and the ledger's executed_at, batch and execution_time (null if it isn't executed); columns of the
    catalog with one of these names are left out."""
    mine = ("executed", "executed_at", "batch", "execution_time")
    scripts = catalog.select(*(f"`{c}`" for c in catalog.columns if c.lower() not in mine))
    key = fresh("done", scripts)
    out = scripts.join(ledger.select(F.col("migration").alias(key), *mine[1:]), F.col("name") == F.col(key), "left")
    return out.select(*(f"`{c}`" for c in scripts.columns), F.col(key).isNotNull().alias("executed"), *mine[1:]).orderBy(*_order(scripts))


def status_table(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """status() as text for people."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    s = status(catalog, ledger)
    return s.select("name", F.when(F.col("executed"), "Executed").otherwise("Pending").alias("status"), text(F.col("batch")).alias("batch"), text(display_timestamp(F.col("executed_at"))).alias("executed_at"))


def listing_table(catalog: DataFrame) -> DataFrame:
    return listing(catalog).select("name", "filename", short_checksum(F.col("checksum")).alias("checksum"))


def drift(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Executed scripts whose checksum isn't the recorded one, in order: name, filename, stored, current."""
    scripts = catalog.select("name", *_order(catalog), F.col("checksum").alias("current"))
    out = scripts.join(ledger.select(F.col("migration").alias("done"), F.col("checksum").alias("stored")), F.col("name") == F.col("done"))
    return out.where(F.col("stored") != F.col("current")).orderBy(*_order(catalog)).select("name", "filename", "stored", "current")


def last_batch(ledger: DataFrame) -> DataFrame:
    """One row, 0 for an empty ledger."""
    return ledger.agg(F.coalesce(F.max("batch"), F.lit(0)).alias("last_batch"))


def next_batch(ledger: DataFrame) -> DataFrame:
    """One row: the batch that the next run gets."""
    return last_batch(ledger).select((F.col("last_batch") + 1).cast("int").alias("next_batch"))


def progress(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: how many scripts there are, how many of them are executed and pending, and whether nothing is pending."""
    s = status(catalog, ledger)
    out = s.agg(F.count("*").alias("scripts"), F.count_if("executed").alias("executed"), F.count_if(~F.col("executed")).alias("pending"))
    return out.withColumn("up_to_date", F.col("pending") == 0)


def other_sessions(sessions: DataFrame, database: str, own: int) -> DataFrame:
    """Sessions (pid, datname) of a database but one's own: those that must end before it can be dropped."""
    return sessions.where((F.col("datname") == database) & (F.col("pid") != own))


def by_batch(ledger: DataFrame, batch: int | Column) -> DataFrame:
    return ledger.where(F.col("batch") == batch).orderBy(F.desc("id"))


def by_name(ledger: DataFrame, name: str) -> DataFrame:
    return ledger.where(F.col("migration") == name)


def history(ledger: DataFrame) -> DataFrame:
    """The latest first; rows without a time before all others; equal times by id."""
    return ledger.orderBy(F.desc_nulls_first("executed_at"), F.desc("id"))


def history_table(ledger: DataFrame) -> DataFrame:
    return history(ledger).select("migration", "batch", display_timestamp(F.col("executed_at")).alias("executed_at"), F.concat(F.col("execution_time").cast("string"), F.lit("ms")).alias("execution_time"))


def repeated_names(ledger: DataFrame) -> DataFrame:
    """Names that break the ledger's uniqueness, with their counts: an empty result is a sound ledger."""
    return ledger.groupBy("migration").agg(F.count("*").alias("n")).where("n > 1")


def exists(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: whether any row fulfils the condition. Reads no further than the first one in each partition."""
    return rows.where(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def script_names(files: DataFrame) -> DataFrame:
    """Files (filename) that are scripts: `.sql` at the end, as it is written."""
    return files.where(F.col("filename").endswith(".sql"))


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows; a limit of 0 or less means all."""
    return rows.limit(limit) if limit > 0 else rows


def column_problems(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Columns (name, type) that are missing or of another type: name, expected, found."""
    f = found.select(F.col("name").alias("there"), F.col("type").alias("found"))
    e = expected.select("name", F.col("type").alias("expected"))
    out = e.join(f, F.lower("name") == F.lower("there"), "left").where(F.col("found").isNull() | (F.lower("found") != F.lower("expected")))
    return out.select("name", "expected", "found").orderBy("name")
