"""What the operators of this subpackage share: shared storage, table reads, written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Stands for a null doc_id inside an operator: such rows take part and sort first.
NO_ID = -(2**63)


#: Rows of an Arrow batch on its way to Python, where the session doesn't say otherwise: texts may be long, and Spark's default is by rows.
ARROW_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir, or what setCheckpointDir was given). Where neither is set, a
    local one if the session has no executors on other machines, as in tests; else this raises."""
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None) or spark.conf.get("spark.quillstack.shared", None)
    if not at:
        at = local_folder(spark.sparkContext.master)
        spark.conf.set("spark.quillstack.shared", at)
    return at.rstrip("/")


def local_folder(master: str) -> str:
    """A new folder on this machine; only where the executors are on it, too."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="quillstack-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing folder in the shared one."""
    return f"{shared_dir(spark)}/quillstack/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", at: str | None = None) -> DataFrame:
    """df as a table in the shared folder (`at`, or a fresh one), read again: cuts the lineage and survives lost executors."""
    small_batches(df.sparkSession)
    at = at or new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes an intermediate folder that nothing reads any more, through Spark's file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(file system, path in it) of a URI or a local path, through Arrow's file systems."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def key_of(column: str) -> Column:
    """An id that is never null (see NO_ID)."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_of(column: str) -> Column:
    """The reverse of key_of."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names are compared as Spark does, whatever their case)."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def in_parts(batches: Iterator, rows: int, text: int | None = None, size: int = 1 << 20) -> Iterator:
    """Arrow record batches cut to at most `rows` rows and, where the number of a text or binary column is given, to about `size` bytes
    of it (one row at least), so that long texts don't pile up."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if text is None:
            yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), pa.scalar(0, pa.int32())), dtype=np.int64)
        upto, i = np.cumsum(n), 0
        while i < len(n):
            j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + size, side="right"))
            j = min(max(j, i + 1), i + rows)
            yield batch.slice(i, j - i)
            i = j


def groups_of(batches: Iterator, column: str) -> Iterator[tuple[object, list[dict]]]:
    """(value, its rows) of a stream of Arrow batches that is sorted by `column`; one row is turned into Python at a time."""
    value, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if rows and r[column] != value:
                yield value, rows
                rows = []
            value = r[column]
            rows.append(r)
        del batch
    if rows:
        yield value, rows


def by_number(df: DataFrame, n: int, number: str, *order: str) -> DataFrame:
    """Rows dealt out so that a task holds the rows of one `number` (0 to n - 1), sorted by it and `order`."""
    return df.repartitionById(n, F.col(number).cast("int")).sortWithinPartitions(number, *order)


_TRIM: list[Callable] = []


def tidy() -> None:
    """Gives freed memory back to the system; called between units of work, as an executor's workers share its memory with the JVM."""
    if not _TRIM:
        import ctypes

        import pyarrow as pa

        try:
            c = ctypes.CDLL(None)
            c.mallopt(-3, 4 << 20)  # arrays from 4 MB on are mapped by themselves
            _TRIM.append(lambda: c.malloc_trim(0))
        except (OSError, AttributeError):  # another C library
            _TRIM.append(lambda: None)
        _TRIM.append(lambda: pa.default_memory_pool().release_unused())
    for f in _TRIM:
        f()
