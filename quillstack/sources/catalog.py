"""The catalog of scripts: a folder of `.sql` files, read as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import FileFailed, ValidationFailed
from ..functions.strings import checksum, parsed_filename, sections


def script_files(spark: SparkSession, folder: str) -> DataFrame:
    """filepath and content (bytes) of every `.sql` file, also in folders below, but those of hidden_scripts()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").load(folder)
    return files.select(F.col("path").alias("filepath"), "content")


def hidden_scripts(spark: SparkSession, folder: str) -> list[str]:
    """Names of `.sql` files that begin with `_` or `.`, or are in such a folder: Spark's readers pass over them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs, out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    files, base = fs.listFiles(path, True), fs.makeQualified(path).toString().rstrip("/")
    while files.hasNext():
        at = files.next().getPath()
        inner = at.toString()[len(base) :].strip("/").split("/")
        if at.getName().endswith(".sql") and any(p.startswith(("_", ".")) for p in inner):
            out.append(at.getName())
    return sorted(out)


def parsed(files: DataFrame) -> DataFrame:
    """CATALOG columns and `valid` of files (filepath, content). The checksum is of the bytes as they are."""
    name = F.element_at(F.split("filepath", "/"), -1)
    rows = files.select("filepath", name.alias("filename"), parsed_filename(name).alias("file"), checksum(F.col("content")).alias("checksum"), F.decode("content", "UTF-8").alias("script"))
    return sections(rows, "script").select(F.col("file.name").alias("name"), "filename", "filepath", "checksum", "up_sql", "down_sql", F.col("file.valid").alias("valid"))


def one_script(spark: SparkSession, filepath: str) -> Row | None:
    """CATALOG's row of one file."""
    return parsed(spark.read.format("binaryFile").load(filepath).select(F.lit(filepath).alias("filepath"), "content")).first()


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The scripts in order of their file names. One badly named file fails the whole catalog, one that Spark wouldn't read included."""
    try:
        hidden = hidden_scripts(spark, folder)
        rows = parsed(script_files(spark, folder))
        bad = rows.where(~F.col("valid")).orderBy("filename").select("filename").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "FileNotFoundException" in str(e):
            raise FileFailed("The folder of scripts can't be read", folder) from e
        raise
    if hidden or bad:
        raise ValidationFailed("Not the name of a script", hidden[0] if hidden else bad[0])
    return rows.drop("valid").orderBy("filename", "filepath")


def read_file(path: str) -> str:
    """The whole text of one file on the driver."""
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    except OSError as e:
        raise FileFailed("A file can't be read", str(e)) from e
