"""Which scripts a run or a rollback would take, and in what order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import fresh, last_batch, limited, one_per_name, pending


def run_plan(catalog: DataFrame, ledger: DataFrame, limit: int = 0) -> DataFrame:
    """Pending scripts in order, with the batch that they will all get; a limit of 0 or less means all."""
    batch = last_batch(ledger).select((F.col("last_batch") + 1).alias("batch"))
    return limited(pending(catalog, ledger), limit).crossJoin(F.broadcast(batch))  # one row on that side


def _with_scripts(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ledger rows that have a script, the latest first; the script's checksum is `current`."""
    scripts = one_per_name(catalog)
    taken = {c.lower() for c in rows.columns} - {"checksum"}  # an extra column of the ledger wins over one of the catalog
    scripts = scripts.select(*(F.col(f"`{c}`").alias("current" if c == "checksum" else c) for c in scripts.columns if c == "name" or c.lower() not in taken))
    return rows.join(scripts, F.col("migration") == F.col("name")).orderBy(F.desc("id"))


def rollback_batch(catalog: DataFrame, ledger: DataFrame, batch: int | None = None) -> DataFrame:
    """Of one batch, the last one by default. Ledger rows without a script are left out."""
    if batch is not None:
        return _with_scripts(ledger.where(F.col("batch") == batch), catalog)
    last = last_batch(ledger)
    return _with_scripts(ledger.join(F.broadcast(last), F.col("batch") == F.col("last_batch"), "left_semi"), catalog)  # one row on that side


def rollback_steps(catalog: DataFrame, ledger: DataFrame, steps: int) -> DataFrame:
    """The latest `steps` ledger rows (0 or less: all), those with a script: rows without one use up steps too."""
    return _with_scripts(limited(ledger.orderBy(F.desc("id")), steps), catalog)


def rollback_all(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    return _with_scripts(ledger, catalog)


def rollback_to(catalog: DataFrame, ledger: DataFrame, name: str) -> DataFrame:
    """All that came after the script `name`, which itself stays; nothing if it isn't in the ledger."""
    place = fresh("after", ledger)
    after = ledger.where(F.col("migration") == name).agg(F.max("id").alias(place))
    return _with_scripts(ledger.join(F.broadcast(after), F.col("id") > F.col(place), "left_semi"), catalog)  # one row on that side
