"""Whole runs over a folder of scripts and a table in the session's catalog."""

import hashlib
from datetime import datetime

import pytest
from quillstack import cli
from quillstack.engine import Client, Engine
from quillstack.errors import FileFailed, LedgerError, MigrationFailed, PermissionFailed, ValidationFailed
from quillstack.functions.strings import quoted
from quillstack.plans import templates
from quillstack.plans.scripts import rewritten, split_statements
from quillstack.policy import Policy
from quillstack.sources.catalog import catalog
from quillstack.sources.config import Config, Database, Logging, Migration

SCRIPTS = {
    "2024_01_01_000001_make_a.sql": "-- +migrate Up\nCREATE TABLE a (x INT) USING parquet;\nINSERT INTO a VALUES (1);\n-- +migrate Down\nDROP TABLE a;\n",
    "2024_01_01_000002_make_b.sql": "-- +migrate Up\nCREATE TABLE b (y STRING) USING parquet;\nINSERT INTO b VALUES ('p;q');\n-- +migrate Down\nDROP TABLE b;\n",
}


@pytest.fixture
def engine(spark, tmp_path, request):
    folder = tmp_path / "migrations"
    folder.mkdir()
    for name, text in SCRIPTS.items():
        (folder / name).write_text(text)
    database = "t" + hashlib.sha1(str(tmp_path).encode()).hexdigest()[:10]
    config = Config(database=Database(database=database, username="u"), migration=Migration(directory=str(folder)), logging=Logging(directory=str(tmp_path / "logs")))
    made = Engine(spark, config)
    made.initialize()
    spark.sql(f"USE {database}")
    yield made
    spark.sql("USE default")
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


def test_migrate_status_and_rollback(engine, spark):
    assert engine.migrate(1).names == ["make_a"]
    done = engine.migrate()
    assert (done.names, done.batch) == (["make_b"], 2)
    assert engine.migrate().names == []
    assert [r["executed"] for r in engine.status().orderBy("filename").collect()] == [True, True]
    assert spark.table("b").first()["y"] == "p;q"
    assert engine.rollback(confirmed=True).names == ["make_b"]
    assert not spark.catalog.tableExists("b")
    assert [r["migration"] for r in engine.history().collect()] == ["make_a"]
    assert engine.rollback_to("make_a", confirmed=True).names == []
    assert engine.reset(confirmed=True).names == ["make_a"]
    assert engine.history().count() == 0
    assert engine.refresh(confirmed=True).names == ["make_a", "make_b"]


@pytest.mark.parametrize("steps", [1, 0])
def test_an_edited_script_stops_the_run_whether_or_not_others_are_pending(engine, tmp_path, steps):
    engine.migrate(steps)
    at = tmp_path / "migrations" / "2024_01_01_000001_make_a.sql"
    at.write_text(at.read_text() + "-- edited\n")
    with pytest.raises(ValidationFailed):
        engine.migrate()


def test_a_failed_script_is_named_and_not_recorded(engine, tmp_path):
    (tmp_path / "migrations" / "2024_01_01_000003_bad.sql").write_text("-- +migrate Up\nSELECT no_such_column FROM a;\n-- +migrate Down\nSELECT 1;\n")
    with pytest.raises(MigrationFailed):
        engine.migrate()
    assert sorted(r["migration"] for r in engine.history().collect()) == ["make_a", "make_b"]


def test_production_refuses(engine, spark):
    safe = Engine(spark, engine.config, Policy(production=True))
    for run in (safe.reset, safe.fresh, safe.refresh, safe.drop_database):
        with pytest.raises(PermissionFailed):
            run(confirmed=True)
    with pytest.raises(PermissionFailed):
        safe.rollback()


def test_catalog_faults(spark, tmp_path):
    with pytest.raises(FileFailed):
        catalog(spark, f"file://{tmp_path}/none")
    (tmp_path / "bad.sql").write_text("SELECT 1")
    with pytest.raises(ValidationFailed):
        catalog(spark, f"file://{tmp_path}")


def test_statements_keep_literals_whole():
    assert split_statements("INSERT INTO b VALUES ('p;q'); SELECT 1;") == ["INSERT INTO b VALUES ('p;q')", "SELECT 1"]
    assert issubclass(MigrationFailed, LedgerError)


def test_new_script_is_in_the_catalog(engine):
    engine.create_migration("create_order_table")
    assert "create_order_table" in [r["name"] for r in engine.list().collect()]


@pytest.mark.parametrize(
    ("statement", "wanted"),
    [
        ("CREATE TABLE notes (id UUID PRIMARY KEY, text TEXT, uuid UUID, json JSONB)", "CREATE TABLE notes (id STRING, text STRING, uuid STRING, json STRING) USING parquet"),
        ('CREATE TABLE t ("unique" TEXT UNIQUE, "primary key" INT, "a,b" UUID)', "CREATE TABLE t (`unique` STRING, `primary key` INT, `a,b` STRING) USING parquet"),
        ("CREATE TABLE t (a INT) -- x", "CREATE TABLE t (a INT) USING parquet"),
        ("CREATE TABLE t (a TEXT DEFAULT 'text, (uuid)' NOT NULL, PRIMARY KEY (a))", "CREATE TABLE t (a STRING DEFAULT 'text, (uuid)' NOT NULL) USING parquet"),
        ("CREATE TABLE t (u BIGINT REFERENCES users(id) ON DELETE CASCADE, tags TEXT[], v VARCHAR(9), UNIQUE (u))", "CREATE TABLE t (u BIGINT, tags ARRAY<STRING>, v VARCHAR(9)) USING parquet"),
        ("CREATE TABLE t (using INT, serial SERIAL)", "CREATE TABLE t (using INT, serial INT) USING parquet"),
        ("ALTER TABLE t ADD COLUMN text TEXT", "ALTER TABLE t ADD COLUMN text STRING"),
        ("ALTER TABLE t ALTER COLUMN uuid TYPE UUID", "ALTER TABLE t ALTER COLUMN uuid TYPE STRING"),
        ("INSERT INTO text VALUES ('uuid -- no', NOW())", "INSERT INTO text VALUES ('uuid -- no', current_timestamp())"),
        ("DROP TABLE IF EXISTS t CASCADE", "DROP TABLE IF EXISTS t"),
        ("CREATE INDEX a ON b (c)", None),
    ],
)
def test_types_are_rewritten_only_where_types_stand(statement, wanted):
    assert rewritten(statement) == wanted


def test_scripts_of_the_usual_shape_run(engine, spark, tmp_path):
    body = """-- Script: create_{0}_table

-- +migrate Up
CREATE TABLE {0} (
    id UUID PRIMARY KEY DEFAULT gen_random_uuid(),
    created_at TIMESTAMP WITH TIME ZONE DEFAULT NOW(),
    text TEXT,
    deleted_at TIMESTAMP WITH TIME ZONE
);

-- An index, which does nothing here
CREATE INDEX idx_{0}_created_at ON {0}(created_at);

-- +migrate Down
DROP INDEX IF EXISTS idx_{0}_created_at;
DROP TABLE IF EXISTS {0};
"""
    for k, name in enumerate(("authors", "books", "author_books")):
        (tmp_path / "migrations" / f"2025_01_01_00000{k}_create_{name}_table.sql").write_text(body.format(name))
    assert len(engine.migrate().names) == 5
    assert spark.table("books").columns == ["id", "created_at", "text", "deleted_at"]
    spark.sql("INSERT INTO books (id, text) VALUES ('1', 'x')")
    assert spark.table("books").first()["created_at"] is not None
    assert engine.rollback_steps(1, confirmed=True).names == ["create_author_books_table"]
    assert engine.reset(confirmed=True).names[:2] == ["create_books_table", "create_authors_table"]


def test_a_script_that_runs_but_is_not_recorded_is_taken_back(engine, spark, monkeypatch):
    def broken(*args, **kwargs):
        raise RuntimeError("disk full")

    monkeypatch.setattr(engine.ledger, "record", broken)
    with pytest.raises(MigrationFailed):
        engine.migrate(1)
    assert not spark.catalog.tableExists("a") and engine.history().count() == 0
    assert engine.ledger.unfinished().count() == 0


def test_a_broken_off_run_shows(engine):
    engine.ledger.intend("make_a", "up")
    assert [r["migration"] for r in engine.ledger.unfinished().collect()] == ["make_a"]


@pytest.mark.parametrize("name", ["_x.sql", ".x.sql", "_in/2024_01_01_000009_x.sql"])
def test_scripts_that_spark_would_skip_fail_the_catalog(spark, tmp_path, name):
    (tmp_path / name).parent.mkdir(exist_ok=True)
    (tmp_path / name).write_text("-- +migrate Up\nSELECT 1")
    (tmp_path / "2024_01_01_000001_ok.sql").write_text("-- +migrate Up\nSELECT 1")
    with pytest.raises(ValidationFailed):
        catalog(spark, f"file://{tmp_path}")


def test_checks_of_the_ledger(engine, spark):
    assert engine.check().count() == 0
    engine.check_connection()
    engine.check_permissions()
    spark.sql(f"DROP TABLE {engine.ledger.name}")
    with pytest.raises(ValidationFailed):
        engine.check()
    spark.sql(f"CREATE TABLE {engine.ledger.name} (seq INT, event STRING) USING parquet")
    assert {r["name"] for r in engine.check().collect()} == {"seq", "migration", "batch", "executed_at", "execution_time", "checksum"}


def test_client_and_fresh(engine, spark):
    client = Client(spark, engine.config)
    assert client.MigrateSteps(1).names == ["make_a"] and client.Migrate().names == ["make_b"]
    assert [r["name"] for r in client.Status()] == ["make_a", "make_b"] and len(client.List()) == 2 and len(client.History()) == 2
    assert client.RollbackSteps(1).names == ["make_b"] and client.Rollback().names == ["make_a"]
    assert client.Fresh().names == ["make_a", "make_b"] and client.Reset().names == ["make_b", "make_a"]
    assert client.GetConfig() is engine.config and client.CreateMigration("add_x").endswith("_add_x.sql")
    assert engine.config.migration.table in engine.tables()
    assert [c for c, _ in engine.columns(engine.config.migration.table)][:2] == ["seq", "event"] and engine.database_bytes() > 0
    assert engine.query("SELECT :a AS x", a=3).first()["x"] == 3
    client.Close()


def test_setup_scaffold_and_reset_of_the_database(engine, spark, tmp_path):
    made = engine.scaffold(str(tmp_path / "new"))
    assert str(tmp_path / "new" / "config" / "database.yaml") in made and engine.scaffold(str(tmp_path / "new")) == []
    engine.setup()
    engine.migrate()
    engine.reset_database(confirmed=True)
    assert engine.database_exists() and engine.tables() == []
    engine.drop_database(confirmed=True)
    assert not engine.database_exists()


def test_confirmations():
    asked = []
    answers = iter(["y", "n", "fresh", "no"])
    policy = Policy(False, lambda prompt: (asked.append(prompt), next(answers))[1])
    policy.require("reset")
    with pytest.raises(PermissionFailed):
        policy.require("rollback")
    policy.require("fresh")
    with pytest.raises(PermissionFailed):
        policy.require("drop")
    assert len(asked) == 4
    Policy(True, lambda prompt: "YES").require("rollback")
    with pytest.raises(PermissionFailed):
        Policy(True, lambda prompt: "yes").require("rollback")


def test_command_line(engine, spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "s.yaml"
    c = engine.config
    path.write_text(f"database:\n  database: {c.database.database}\n  username: u\nmigration:\n  directory: {c.migration.directory}\nlogging:\n  directory: {tmp_path}/logs\n")
    run = lambda *a: cli.main([*a, "--config", str(path)], spark)
    assert run("config:validate") == 0 and run("config:show") == 0 and run("setup") == 0
    assert run("migrate", "--step", "1") == 0 and run("migrate") == 0 and run("status") == 0 and run("list") == 0 and run("history") == 0
    assert "Executed" in capsys.readouterr().out
    assert run("rollback", "--yes") == 0 and run("rollback", "--step", "1", "--yes") == 0
    assert run("refresh", "--yes") == 0 and run("rollback", "--to", "make_a", "--yes") == 0 and run("reset", "--yes") == 0 and run("fresh", "--yes") == 0
    assert run("make:migration") == 4 and run("migrate", "name") == 4 and run("make:migration", "create_dog_table") == 0
    monkeypatch.setattr("builtins.input", lambda prompt: "no")
    assert run("reset") == PermissionFailed.exit_code
    (tmp_path / "migrations" / "bad.sql").write_text("x")
    assert run("list") == ValidationFailed.exit_code
    assert run("db:create") == 0 and run("db:reset", "--yes") == 0 and run("db:drop", "--yes") == 0


def test_templates_and_names(tmp_path):
    at = datetime(2024, 5, 6, 7, 8, 9)
    for name, part in (("create_mouse_table", "CREATE TABLE mice"), ("add_x", "ADD COLUMN"), ("drop_x", "ADD COLUMN"), ("other", "goes here")):
        path = templates.write_script(str(tmp_path), name, at=at)
        assert path.endswith(f"2024_05_06_070809_{name}.sql") and part in open(path).read()
    with pytest.raises(FileFailed):
        templates.write_script(str(tmp_path), "other", at=at)
    with pytest.raises(ValidationFailed):
        templates.write_script(str(tmp_path), "!!")
    assert quoted("a`b") == "`a``b`"
    assert str(MigrationFailed("m", "d", "x")) == "[migration] m (migration: x): d"
