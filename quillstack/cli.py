"""python -m quillstack.cli COMMAND: the engine on the command line. Exit codes are those of quillstack.errors."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import LedgerError
from .operators.ledger import history_table, listing_table, status_table
from .policy import Policy
from .sources.config import load, validate

COMMANDS = ["init", "setup", "make:migration", "migrate", "rollback", "status", "list", "history", "reset", "fresh", "refresh", "db:create", "db:drop", "db:reset", "config:show", "config:validate"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstack", description="Schema scripts and their ledger on Spark.")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("name", nargs="?", help="of a new script, for make:migration")
    p.add_argument("--config")
    p.add_argument("--step", "-s", type=int, default=0, help="how many scripts; 0: all (migrate) or the last batch (rollback)")
    p.add_argument("--to", help="rollback: the script to go back to; it stays")
    p.add_argument("--yes", action="store_true", help="don't ask")
    p.add_argument("--compat", action="store_true", help="split scripts at every semicolon")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if (a.command == "make:migration") != (a.name is not None):
        print("make:migration takes a name, and no other command does", file=sys.stderr)
        return 4
    try:
        config = load(a.config)
        if a.command == "config:show":
            shown = asdict(config)
            shown["database"]["password"] = "***" if config.database.password else ""
            print(shown)
            return 0
        validate(config)
        if a.command == "config:validate":
            return 0
        spark = spark or SparkSession.builder.appName("quillstack").getOrCreate()
        e = Engine(spark, config, Policy(config.is_production, input), compat=a.compat)
        show = lambda df: df.show(10_000, truncate=False)
        todo = {
            "init": lambda: e.scaffold("."),
            "setup": e.setup,
            "make:migration": lambda: print(e.create_migration(a.name)),
            "migrate": lambda: e.migrate(a.step),
            "rollback": lambda: e.rollback_to(a.to, a.yes) if a.to else e.rollback_steps(a.step, a.yes) if a.step > 0 else e.rollback(confirmed=a.yes),
            "status": lambda: (e.initialize(), show(status_table(e.catalog(), e.ledger.rows()))),
            "list": lambda: show(listing_table(e.catalog())),
            "history": lambda: (e.initialize(), show(history_table(e.ledger.rows()))),
            "reset": lambda: e.reset(a.yes),
            "fresh": lambda: e.fresh(a.yes),
            "refresh": lambda: e.refresh(a.yes),
            "db:create": e.create_database,
            "db:drop": lambda: e.drop_database(a.yes),
            "db:reset": lambda: e.reset_database(a.yes),
        }
        todo[a.command]()
        return 0
    except LedgerError as error:
        print(error, file=sys.stderr)
        return error.exit_code


if __name__ == "__main__":
    sys.exit(main())
