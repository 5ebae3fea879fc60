"""One session for all tests, and a comparison of rows with those of SQL."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.master": "local[4]", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.default.parallelism": "4",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(rows, columns, ordered: bool = False) -> list[tuple]:
    """Rows with their columns in order of the names, as text; sorted, unless their own order counts."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    return out if ordered else sorted(out)


def same_as_sql(df, sql: str, folder: str = DATA, ordered: bool = False) -> None:
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns, ordered) == rows_of(got.fetchall(), names, ordered)
