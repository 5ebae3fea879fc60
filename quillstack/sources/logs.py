"""The log: one line `[time] [LEVEL] [category] message` for each entry; written by the driver, read as a DataFrame."""

from __future__ import annotations

import os
import sys
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("DEBUG", "INFO", "SUCCESS", "WARNING", "ERROR", "FATAL")
LINE = r"(?s)\A\[([^\]]*)\] \[([^\]]*)\] \[([^\]]*)\] (.*)\z"


class Log:
    """Appends to a file, and prints if asked to, what is of `level` or above."""

    def __init__(self, path: str | None = None, level: str = "info", console: bool = False):
        self.path, self.least, self.console = path, rank(level), console
        if path:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)

    def write(self, level: str, category: str, message: str) -> None:
        if rank(level) < self.least:
            return
        line = f"[{datetime.now():%Y-%m-%d %H:%M:%S}] [{level.upper()}] [{category}] {message}"
        if self.console:
            print(line, file=sys.stderr if rank(level) >= rank("error") else sys.stdout)
        if self.path:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(line + "\n")


def rank(level: str) -> int:
    """Unknown levels count as INFO."""
    return LEVELS.index(level.upper()) if level.upper() in LEVELS else 1


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """schemas.LOG of lines; lines of another form are left out."""
    part = lambda k: F.regexp_extract(F.col(line), LINE, k)
    rows = lines.where(F.col(line).rlike(LINE))
    return rows.select(F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), part(2).alias("level"), part(3).alias("category"), part(4).alias("message"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def at_least(level: str, column: Column | None = None) -> Column:
    """Whether a level is `level` or above."""
    c = F.upper(F.col("level") if column is None else column)
    ordinal = F.coalesce(F.when(c.isin(*LEVELS), F.array_position(F.array(*(F.lit(x) for x in LEVELS)), c).cast("int") - 1), F.lit(1))
    return ordinal >= rank(level)
