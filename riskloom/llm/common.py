"""Helpers that the operators share: table reads, folds, row identity and
byte-level text access inside Arrow tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

__all__ = ["materialize", "scratch_path", "table", "in_fold", "bounded_batches", "with_row_ids", "byte_values",
           "task_number", "require", "fresh", "without"]

#: Rows per Arrow batch.  Batches are what a task holds at once; with whole
#: texts of up to a few hundred KB the default of 10,000 rows is too many.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``BATCH_ROWS`` rows (never raise it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *names: str) -> None:
    """Every operator starts here: the columns it reads must be there, and what
    its tasks hold at once is bounded."""
    bounded_batches(df.sparkSession)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names: an operator's results take their place."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def in_fold(id_col: Column | str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is in no fold."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % modulus == remainder, F.lit(False))


def with_row_ids(df: DataFrame, name: str = "rid") -> DataFrame:
    """A row identity that does not depend on any column, so that repeated
    rows and null ids stay apart.  Materialise the result before it is used
    twice: how files are split, and so the ids, can change between two plans
    when the cluster does."""
    return df.withColumn(name, F.monotonically_increasing_id())


def byte_values(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
