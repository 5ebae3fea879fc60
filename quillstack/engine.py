"""The engine: runs scripts of a catalog against a Spark catalog, and keeps the ledger.

Spark has no transaction over several statements. Before a script runs, its intent is noted; if a statement fails, the other section is
run as well as it goes, and the error names the statement. A run that was killed shows in Ledger.unfinished().
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from .errors import ConnectionFailed, LedgerError, MigrationFailed, PermissionFailed, ValidationFailed
from .functions.strings import quoted
from .functions.times import Timer
from .operators import ledger as ops
from .plans import rollbacks
from .plans.scripts import rewritten, split_statements
from .plans.templates import write_script
from .policy import Policy
from .schemas import EVENTS
from .sources.catalog import catalog, one_script
from .sources.config import Config, validate
from .sources.ledger import Ledger
from .sources.logs import Log


@dataclass
class Done:
    """What a run did: names in order, and the batch of a migrate."""

    names: list[str]
    batch: int | None = None


class Engine:
    def __init__(self, spark: SparkSession, config: Config, policy: Policy | None = None, log: Log | None = None, compat: bool = False):
        """compat: statements are split and skipped by the plain rules, see plans.scripts.split_statements."""
        self.spark, self.config, self.compat = spark, config, compat
        self.policy = policy or Policy(config.is_production)
        self.log = log or Log(os.path.join(config.logs_path(), config.logging.filename) if config.logging.enabled else None, config.logging.level)
        self.database = config.database.database
        self.ledger = Ledger(spark, f"{self.database}.{config.migration.table}" if self.database else config.migration.table)

    # databases and tables

    def create_database(self) -> None:
        if self.database:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(self.database)}")

    def database_exists(self) -> bool:
        return self.spark.catalog.databaseExists(self.database or "default")

    def drop_database(self, confirmed: bool = False) -> None:
        self.policy.require("drop", confirmed)
        self.spark.sql(f"DROP DATABASE IF EXISTS {quoted(self.database)} CASCADE")
        self.log.write("WARNING", "Database", f"dropped {self.database}")

    def reset_database(self, confirmed: bool = False) -> None:
        self.policy.require("reset-database", confirmed)
        self.spark.sql(f"DROP DATABASE IF EXISTS {quoted(self.database)} CASCADE")
        self.create_database()

    def tables(self) -> list[str]:
        """Names of the tables, sorted; views aren't listed."""
        return sorted(t.name for t in self.spark.catalog.listTables(self.database or None) if not t.isTemporary and t.tableType != "VIEW")

    def columns(self, table: str) -> list[tuple[str, str]]:
        """Name and type of a table's columns, in order."""
        return [(f.name, f.dataType.simpleString()) for f in self.spark.table(self._name(table)).schema.fields]

    def database_bytes(self) -> int:
        """Size of all tables' files."""
        total = 0
        for t in self.tables():
            self.spark.sql(f"ANALYZE TABLE {self._name(t)} COMPUTE STATISTICS NOSCAN")
            for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self._name(t)}").where("col_name = 'Statistics'").collect():
                total += int(r["data_type"].split()[0])
        return total

    def drop_all_tables(self) -> None:
        """The ledger too. Not atomic."""
        for t in self.tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(t)}")

    def _name(self, table: str) -> str:
        return f"{quoted(self.database)}.{quoted(table)}" if self.database else quoted(table)

    # lifecycle

    def initialize(self) -> None:
        try:
            self.create_database()
            self.ledger.create()
        except LedgerError:
            raise
        except Exception as e:
            raise ConnectionFailed("Database and ledger can't be made ready", str(e)) from e

    def setup(self) -> None:
        validate(self.config)
        self.initialize()

    def scaffold(self, folder: str) -> list[str]:
        """Makes the folders and a settings file where there is none; returns what was made."""
        made = []
        for path in (folder, os.path.join(folder, "config"), os.path.join(folder, self.config.migration.directory), os.path.join(folder, self.config.logging.directory)):
            if not os.path.isdir(path):
                os.makedirs(path)
                made.append(path)
        path = os.path.join(folder, "config", "database.yaml")
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                for part in ("database", "migration", "logging"):
                    f.write(f"{part}:\n")
                    for k, v in vars(getattr(self.config, part)).items():
                        f.write(f"  {k}: {str(v).lower() if isinstance(v, bool) else v!r}\n".replace("'", '"'))
                f.write(f"environment: {self.config.environment}\n")
            made.append(path)
        return made

    def catalog(self) -> DataFrame:
        return catalog(self.spark, "file://" + self.config.migrations_path())

    def create_migration(self, name: str) -> str:
        return write_script(self.config.migrations_path(), name, self.config.migration.timezone)

    # queries

    def status(self) -> DataFrame:
        self.initialize()
        return ops.status(self.catalog(), self.ledger.rows())

    def list(self) -> DataFrame:
        return ops.listing(self.catalog())

    def history(self) -> DataFrame:
        self.initialize()
        return ops.history(self.ledger.rows())

    def orphans(self) -> DataFrame:
        return ops.orphans(self.catalog(), self.ledger.rows())

    def query(self, sql: str, *args, **named) -> DataFrame:
        """Any query; positional (?) or named (:name) parameters."""
        return self.spark.sql(sql, args=named or list(args) or None)

    # runs

    def migrate(self, steps: int = 0) -> Done:
        """Pending scripts in order, at most `steps` of them (0: all), as one batch. Stops at the first failure; those before it stay."""
        self.initialize()
        scripts, ledger = self.catalog(), self.ledger.rows()
        if first := ops.drift(scripts, ledger).first():  # also if nothing is pending
            raise ValidationFailed("An executed script was edited", f"{first['name']}: its checksum was {first['stored']} and is {first['current']}")
        done = Done([])
        todo = rollbacks.run_plan(scripts, ledger, steps).orderBy("filename", "filepath").select("name", "filepath", "checksum", "batch")
        for r in todo.collect():  # names and places: they run one by one, and each body is read when its turn comes
            done.batch = r["batch"]
            body = self._body(r)
            self._run(r["name"], body["up_sql"], body["down_sql"], "up", lambda ms, r=r: self.ledger.record(r["name"], r["batch"], ms, r["checksum"]))
            done.names.append(r["name"])
        return done

    def _body(self, script: Row) -> Row:
        """Both sections of one script, which must still be what the plan saw."""
        r = one_script(self.spark, script["filepath"])
        if r is None or ("checksum" in script and r["checksum"] != script["checksum"]):
            raise ValidationFailed("A script changed during the run", script["name"])
        return r

    def rollback(self, batch: int | None = None, confirmed: bool = False) -> Done:
        """The last batch by default."""
        self.policy.require("rollback", confirmed)
        self.initialize()
        return self._revert(rollbacks.rollback_batch(self.catalog(), self.ledger.rows(), batch))

    def rollback_steps(self, steps: int, confirmed: bool = False) -> Done:
        self.policy.require("rollback", confirmed)
        self.initialize()
        return self._revert(rollbacks.rollback_steps(self.catalog(), self.ledger.rows(), steps))

    def rollback_to(self, name: str, confirmed: bool = False) -> Done:
        """All that came after the script `name`."""
        self.policy.require("rollback", confirmed)
        self.initialize()
        return self._revert(rollbacks.rollback_to(self.catalog(), self.ledger.rows(), name))

    def reset(self, confirmed: bool = False) -> Done:
        self.policy.require("reset", confirmed)
        self.initialize()
        return self._revert(rollbacks.rollback_all(self.catalog(), self.ledger.rows()))

    def fresh(self, confirmed: bool = False) -> Done:
        """Drops all tables, then migrates."""
        self.policy.require("fresh", confirmed)
        self.initialize()
        self.drop_all_tables()
        return self.migrate()

    def refresh(self, confirmed: bool = False) -> Done:
        """Reset, then migrate."""
        self.policy.require("refresh", confirmed)
        self.reset(confirmed=True)
        return self.migrate()

    def _revert(self, plan: DataFrame) -> Done:
        done = Done([])
        for r in plan.select("name", "filepath").collect():
            body = self._body(r)
            self._run(r["name"], body["down_sql"], body["up_sql"], "down", lambda ms, r=r: self.ledger.remove(r["name"]))
            done.names.append(r["name"])
        return done

    def execute(self, script: str, name: str = "") -> int:
        """Runs a script's statements in order; returns how many did something. The error of one that fails has its number."""
        ran = 0
        for k, statement in enumerate(split_statements(script, self.compat), 1):
            spark_sql = rewritten(statement)
            if spark_sql is None:
                self.log.write("WARNING", "Migration", f"{name}: nothing to do for: {statement[:80]}")
                continue
            try:
                if self.database:
                    self.spark.catalog.setCurrentDatabase(self.database)
                self.spark.sql(spark_sql)
            except Exception as e:
                raise MigrationFailed(f"Statement {k} failed", str(e), name) from e
            ran += 1
        return ran

    def _run(self, name: str, script: str, back: str, what: str, record) -> None:
        """Runs a section and records it. Whatever fails, an Up section is taken back as well as it goes, by the Down section."""
        self.ledger.intend(name, what)
        timer = Timer()
        try:
            self.execute(script, name)
            record(timer.milliseconds())
        except Exception as e:
            self.log.write("ERROR", "Migration", f"{name}: {e}")
            if what == "up" and self._taken_back(name, back):
                self.ledger.undone(name)
            if isinstance(e, LedgerError):
                raise
            raise MigrationFailed("The script ran, but wasn't recorded" if what == "up" else "The script was taken back, but the ledger doesn't show it", str(e), name) from e
        self.log.write("SUCCESS", "Migration", f"{name}: {what} in {timer.milliseconds()} ms")

    def _taken_back(self, name: str, back: str) -> bool:
        try:
            self.execute(back, name)
        except Exception as second:
            self.log.write("ERROR", "Migration", f"{name}: couldn't be taken back: {second}")
            return False
        return True

    # checks

    def check(self) -> DataFrame:
        """What is wrong with the ledger's table, a row for each column: name, expected, found. Raises if database or table is missing."""
        if not self.database_exists():
            raise ValidationFailed("No such database", self.database)
        if not self.ledger.exists():
            raise ValidationFailed("The ledger has no table yet", self.ledger.table)
        columns = lambda fields: self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "name string, type string")
        return ops.column_problems(columns(EVENTS.fields), columns(self.ledger.events().schema.fields))

    def check_permissions(self) -> None:
        """Makes and drops a table of its own in the database."""
        name = self._name(f"quillstack_probe_{uuid.uuid4().hex[:12]}")
        try:
            self.spark.sql(f"CREATE TABLE {name} (id INT) USING parquet")
            self.spark.sql(f"DROP TABLE {name}")
        except Exception as e:
            raise PermissionFailed("Tables can't be made here", str(e)) from e

    def check_connection(self) -> None:
        """Asks the session for one row."""
        try:
            self.spark.sql("SELECT 1").first()
        except Exception as e:
            raise ConnectionFailed("The session doesn't answer", str(e)) from e


class Client:
    """The same by the names of a small client, for programs."""

    def __init__(self, spark: SparkSession, config: Config, policy: Policy | None = None):
        validate(config)
        self.config, self.engine = config, Engine(spark, config, policy)

    def CreateMigration(self, name: str) -> str:  # noqa: N802
        return self.engine.create_migration(name)

    def Migrate(self) -> Done:  # noqa: N802
        return self.engine.migrate()

    def MigrateSteps(self, steps: int) -> Done:  # noqa: N802
        return self.engine.migrate(steps)

    def Rollback(self) -> Done:  # noqa: N802
        return self.engine.rollback(confirmed=True)

    def RollbackSteps(self, steps: int) -> Done:  # noqa: N802
        return self.engine.rollback_steps(steps, confirmed=True)

    def Reset(self) -> Done:  # noqa: N802
        return self.engine.reset(confirmed=True)

    def Fresh(self) -> Done:  # noqa: N802
        return self.engine.fresh(confirmed=True)

    def Status(self) -> list[Row]:  # noqa: N802
        return self.engine.status().collect()

    def List(self) -> list[Row]:  # noqa: N802
        return self.engine.list().collect()

    def History(self) -> list[Row]:  # noqa: N802
        return self.engine.history().collect()

    def GetConfig(self) -> Config:  # noqa: N802
        return self.config

    def Close(self) -> None:  # noqa: N802
        """The session belongs to the caller: nothing to close."""


__all__ = ["Client", "Done", "Engine", "PermissionFailed"]
