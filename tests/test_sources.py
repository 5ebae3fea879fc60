"""Settings, logs, the log as a stream, and driver-side helpers."""

import pytest
from quillstack.errors import ValidationFailed
from quillstack.sources import config, logs
from quillstack.streaming.logs import level_counts, log_stream


def test_settings_from_file_and_environment(tmp_path):
    (tmp_path / "database.yaml").write_text("database:\n  host: db.example\n  port: 6000\n  database: shop\nlogging:\n  enabled: false\n")
    c = config.load(env={}, folder=str(tmp_path))
    assert (c.database.host, int(c.database.port), c.database.database, c.logging.enabled) == ("db.example", 6000, "shop", False)
    c = config.load(env={config.PREFIX + "DATABASE_URL": "postgres://u:p@h:7000/d"}, folder=str(tmp_path))
    assert (c.database.host, int(c.database.port), c.database.database) == ("h", 7000, "d")
    assert config.parse_env("export A='b c'\n# no\nD=e # f\n")["A"] == "b c"


def test_unknown_environment_is_refused():
    with pytest.raises(ValidationFailed):
        config.validate_environment(config.Config(environment="nowhere"))


def test_log_lines_and_levels(spark, tmp_path):
    log = logs.Log(str(tmp_path / "x.log"), "warning")
    for level in ("INFO", "WARNING", "ERROR"):
        log.write(level, "Cat", f"m {level}")
    (tmp_path / "x.log").open("a").write("no entry\n")
    rows = logs.read_log(spark, str(tmp_path / "x.log"))
    assert sorted(r["message"] for r in rows.collect()) == ["m ERROR", "m WARNING"]
    assert rows.where(logs.at_least("error")).count() == 1


def test_log_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("[2024-01-01 10:00:00] [ERROR] [A] x\n[2024-01-01 10:10:00] [ERROR] [A] y\n[2024-01-01 10:10:00] [DEBUG] [A] z\n")
    counts = level_counts(log_stream(spark, str(tmp_path / "in"), "info"))
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["level"], r["n"]) for r in spark.table("counts").collect()] == [("ERROR", 2)]
