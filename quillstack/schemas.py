"""Schemas of the tables that the engine reads and writes; never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

LEDGER = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("migration", T.StringType(), False),
        T.StructField("batch", T.IntegerType(), False),
        T.StructField("executed_at", T.TimestampType()),
        T.StructField("execution_time", T.IntegerType(), False),
        T.StructField("checksum", T.StringType(), False),
    ]
)

#: A script of the catalog: name is the key, filename gives the order.
CATALOG = T.StructType([T.StructField(c, T.StringType(), False) for c in ("name", "filename", "filepath", "checksum", "up_sql", "down_sql")])

STATUS = T.StructType(
    [*CATALOG.fields, T.StructField("executed", T.BooleanType(), False), T.StructField("executed_at", T.TimestampType()), T.StructField("batch", T.IntegerType()), T.StructField("execution_time", T.IntegerType())]
)

#: The ledger as it is stored: a row for each script that was applied or reverted; seq orders them.
EVENTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("migration", T.StringType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("executed_at", T.TimestampType()),
        T.StructField("execution_time", T.IntegerType()),
        T.StructField("checksum", T.StringType()),
    ]
)

LOG = T.StructType([T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.StringType()) for c in ("level", "category", "message"))])
