"""Bulk scan of code files from a directory tree (the single-file CLI read,
re-aimed at many files).

Files are read as binary by Spark's ``binaryFile`` source (recursive, glob
filtered, listing and reading spread over the executors).  Text that is not
valid UTF-8 goes to the reject set; valid text gets universal-newline
translation (``\\r\\n`` and a lone ``\\r`` become ``\\n``), as a text-mode read
does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _raw(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(root))


def _decoded(raw: DataFrame) -> DataFrame:
    return raw.select("path", "modificationTime", "length",
                      F.try_validate_utf8(F.col("content").cast("string")).alias("_text"))


def read_code_files(spark: SparkSession, root: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """(files, rejects): ``files`` has path, modification time, byte length
    and ``code_content``; ``rejects`` has path and reason."""
    d = _decoded(_raw(spark, root, glob))
    files = d.where(F.col("_text").isNotNull()).select(
        "path", "modificationTime", "length",
        F.regexp_replace(F.col("_text"), F.lit("\r\n?"), F.lit("\n")).alias("code_content"))
    rejects = d.where(F.col("_text").isNull()).select("path", F.lit("not valid UTF-8").alias("reason"))
    return files, rejects
