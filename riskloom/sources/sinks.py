"""Sinks: code objects, analysis results, downloads and training data.

Object layout: the reference keys one object per row
(``commits/{user}/{hash}.txt``); here the same key is a column of one
table, partitioned by a bounded owner bucket so that a user's rows prune to
one folder without creating a folder per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog as K
from ..session import path_exists

OWNER_BUCKETS = 256


def owner_bucket(user_id_col: str = "user_id", buckets: int = OWNER_BUCKETS):
    return F.pmod(F.xxhash64(F.col(user_id_col)), F.lit(buckets)).cast("int")


def code_objects(stored: DataFrame) -> DataFrame:
    return stored.select(
        "user_id", "commit_hash", "code_content",
        F.format_string(K.CODE_OBJECT_KEY, F.col("user_id").cast("string"), F.col("commit_hash")).alias("s3_code_key"),
        owner_bucket().alias("owner_bucket"))


def write_code_objects(stored: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One partitioned parquet table for all code objects (no shuffle; each
    task writes at most one file per owner bucket it holds)."""
    code_objects(stored).write.mode(mode).partitionBy("owner_bucket").parquet(path)


CODE_OBJECT_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("commit_hash", T.StringType()),
    T.StructField("code_content", T.StringType()), T.StructField("s3_code_key", T.StringType()),
    T.StructField("owner_bucket", T.IntegerType()),
])


def read_code_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CODE_OBJECT_SCHEMA).parquet(path)


def get_code_objects(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """(user_id, commit_hash) requests -> code or NULL when absent."""
    o = objects.select("user_id", "commit_hash", "code_content")
    return requests.join(o, ["user_id", "commit_hash"], "left")


def export_commit_code(stored: DataFrame) -> DataFrame:
    """Download rows: ``commit_{hash}.txt`` and the text, empty code omitted."""
    return (stored.where(F.coalesce(F.col("code_content"), F.lit("")) != "")
            .select("commit_id", F.format_string(K.DOWNLOAD_NAME, F.col("commit_hash")).alias("filename"),
                    "code_content"))


def analysis_results(scored: DataFrame) -> DataFrame:
    """Result objects: hash, percentage, status, reasoning, findings, tx."""
    return scored.select(
        "user_id", "commit_hash", "risk_score", "status", "reasoning", "vulnerabilities", "dlt_tx_hash",
        F.col("created_at").alias("timestamp"),
        F.format_string(K.RESULT_OBJECT_KEY, F.col("user_id").cast("string"), F.col("commit_hash"))
         .alias("s3_result_key"),
        owner_bucket().alias("owner_bucket"))


ANALYSIS_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("commit_hash", T.StringType()),
    T.StructField("risk_score", T.DoubleType()), T.StructField("status", T.StringType()),
    T.StructField("reasoning", T.StringType()), T.StructField("vulnerabilities", T.ArrayType(T.StringType())),
    T.StructField("dlt_tx_hash", T.StringType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("s3_result_key", T.StringType()), T.StructField("owner_bucket", T.IntegerType()),
])


def write_analysis_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    results.write.mode(mode).partitionBy("owner_bucket").json(path)


def read_analysis_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANALYSIS_SCHEMA).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]") \
        .json(path)


REQUEST_SCHEMA = T.StructType([
    T.StructField("commit_id", T.LongType()), T.StructField("commit_hash", T.StringType()),
    T.StructField("body", T.StructType([
        T.StructField("model", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
        T.StructField("temperature", T.DoubleType()), T.StructField("max_tokens", T.LongType())])),
])


def write_llm_requests(requests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per request: keys and the body as it is sent."""
    body = F.from_json("body", REQUEST_SCHEMA["body"].dataType)
    requests.select("commit_id", "commit_hash", body.alias("body")).write.mode(mode).json(path)


def read_llm_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_SCHEMA).json(path)


TRAINING_SCHEMA = T.StructType([
    T.StructField("hash", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("risk_score", T.DoubleType()), T.StructField("source", T.StringType()),
])


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant JSON-lines read: malformed lines are dropped; a missing path
    gives an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], TRAINING_SCHEMA)
    return spark.read.schema(TRAINING_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def append_training(examples: DataFrame, path: str) -> None:
    """Append labelled examples (label rounded to 4 places) as JSON lines;
    callers pass the result of ``new_training_examples`` so no hash repeats."""
    examples.select("hash", "code", F.round(F.col("risk_score").cast("double"), 4).alias("risk_score"),
                    "source").write.mode("append").json(path)
