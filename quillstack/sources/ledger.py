"""The stored ledger: an append-only table of events, of which the live ledger is a query.

Parquet tables can't delete rows, so a revert is an event too. A script is in the ledger if its latest event is `applied`; its id is that
event's seq. There is one writer at a time, as the ledger has no lock; it checks that names stay unique.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import MigrationFailed
from ..functions.strings import quoted
from ..schemas import EVENTS


def live(events: DataFrame) -> DataFrame:
    """The ledger (schemas.LEDGER) of a table of events."""
    w = Window.partitionBy("migration").orderBy(F.desc("seq"))
    latest = events.where(F.col("event").isin("applied", "reverted")).withColumn("_place", F.row_number().over(w)).where("_place = 1 AND event = 'applied'")
    return latest.select(F.col("seq").alias("id"), "migration", "batch", "executed_at", "execution_time", "checksum")


def unfinished(events: DataFrame) -> DataFrame:
    """Scripts whose latest event is an intent: neither applied, nor reverted, nor taken back since."""
    last = events.groupBy("migration").agg(F.max_by("event", "seq").alias("event"), F.max("seq").alias("seq"))
    return last.where(F.col("event").startswith("intent:")).orderBy("seq")


class Ledger:
    def __init__(self, spark: SparkSession, table: str = "schema_migrations"):
        self.spark, self.table = spark, table
        self.name = ".".join(quoted(p) for p in table.split("."))

    def create(self) -> None:
        """Makes the table if there is none; there are no indexes to make."""
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENTS.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def events(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        return live(self.events())

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.insertInto(self.table)

    def _next(self) -> int:
        return (self.events().agg(F.max("seq")).first()[0] or 0) + 1

    def record(self, migration: str, batch: int, execution_time: int, checksum: str, executed_at: datetime | None = None) -> int:
        """Appends an applied script, with the client's time; returns its id."""
        if len(migration) > 255 or len(checksum) > 64:
            raise MigrationFailed("The ledger takes no such entry", "a name has 255 characters at most, a checksum 64", migration)
        if self.rows().where(F.col("migration") == migration).limit(1).count():
            raise MigrationFailed("The ledger takes no second entry", "the script is recorded already", migration)
        seq = self._next()
        self._append([(seq, "applied", migration, batch, executed_at or datetime.now(UTC).replace(tzinfo=None), execution_time, checksum)])
        return seq

    def remove(self, migration: str) -> None:
        """Takes a script out; one that isn't in does no harm."""
        self._append([(self._next(), "reverted", migration, None, None, None, None)])

    def intend(self, migration: str, what: str) -> int:
        """Notes that a script is about to run, so that a run that breaks off can be seen; see unfinished()."""
        seq = self._next()
        self._append([(seq, f"intent:{what}", migration, None, None, None, None)])
        return seq

    def undone(self, migration: str) -> None:
        """Ends an intent whose script failed and was taken back."""
        self._append([(self._next(), "undone", migration, None, None, None, None)])

    def unfinished(self) -> DataFrame:
        return unfinished(self.events())
