"""Append-only ledger of (hash, score, status) calls with its views.

The log is the table of calls; the hash-keyed map is a last-write-wins view
and the index is an ordinal view.  ``seq`` is the append order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import ZERO_ADDRESS
from ..session import path_exists
from .keyed_store import KeyedTable
from .store import ordinal_index


def is_valid() -> Column:
    """Whether the contract accepts a call: non-empty hash, score 0..100."""
    return (F.length(F.coalesce(F.col("commit_hash"), F.lit(""))) > 0) & F.coalesce(F.col("risk_score").between(0, 100), F.lit(False))


def ledger_valid(calls: DataFrame) -> DataFrame:
    return calls.where(is_valid())


def accepted_calls(calls: DataFrame, ts_col=None) -> DataFrame:
    """The log of a first append: accepted calls under their own ``seq``."""
    ts = ts_col if ts_col is not None else F.current_timestamp()
    return ledger_valid(calls).select("seq", "commit_hash", "risk_score", "status", "submitter", ts.alias("ts"))


#: Positions of one folder of the stored log.
BLOCK_CALLS = 1 << 20


def append_ledger_to(spark, path: str, calls: DataFrame, ts_col=None, block_calls: int = BLOCK_CALLS) -> None:
    """Validated append to the log stored at ``path``.  Accepted calls are
    numbered in the order of their own ``seq`` from where the stored log ends;
    ``tx_id`` is a digest of a call's number, hash, score and status.  The number
    is a call's position for good, and the log lies in folders of ``block_calls``
    positions (always the same for a log).  Single writer per path."""
    last = read_log(spark, path).agg(F.max("seq")).first()[0] if path_exists(spark, path) else None
    start = 0 if last is None else last + 1
    new = ordinal_index(accepted_calls(calls, ts_col), "seq", "_place").withColumn("seq", F.col("_place") + F.lit(start)).drop("_place")
    digest = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "commit_hash", F.col("risk_score").cast("string"), "status"), 256)
    new.withColumn("tx_id", F.concat(F.lit("0x"), digest)).withColumn("block", F.expr(f"seq div {block_calls}")) \
        .write.mode("append").partitionBy("block").parquet(path)


def read_log(spark, path: str, positions: DataFrame | None = None, block_calls: int = BLOCK_CALLS) -> DataFrame:
    """The stored log, or the blocks that hold ``positions`` (ordinal) alone."""
    log = spark.read.parquet(path)
    if positions is not None:
        blocks = positions.select(F.expr(f"ordinal div {block_calls}").alias("b")).distinct().collect()  # one number per block of the log at most
        log = log.where(F.col("block").isin([r.b for r in blocks]))
    return log.drop("block")


def ledger_at(spark, path: str, current: KeyedTable, positions: DataFrame, block_calls: int = BLOCK_CALLS) -> DataFrame:
    """Position -> hash -> the latest record of that hash, against the stored log
    and the keyed table of records (``stream_ledger``'s, or ``record_calls``).
    No position is counted out again: blocks of the asked positions are read,
    then the buckets of their hashes."""
    asked = read_log(spark, path, positions, block_calls).select(F.col("seq").alias("ordinal"), "commit_hash").join(positions.distinct(), "ordinal")
    return asked.join(ledger_current(current.matching(asked)), "commit_hash")


def record_calls(current: KeyedTable, log: DataFrame, stream: str | None = None, batch_id: int | None = None) -> None:
    """Add the latest record of each hash of ``log`` to the keyed table."""
    current.append(ledger_current(log).select(*current.columns), stream, batch_id)


def ledger_current(log: DataFrame) -> DataFrame:
    """Latest record per hash (max seq); ``max_by`` aggregates partially
    before the shuffle, so a re-logged hot hash stays cheap."""
    rec = F.struct(*[F.col(c) for c in log.columns if c != "commit_hash"])
    return (log.groupBy("commit_hash").agg(F.max_by(rec, F.col("seq")).alias("r"))
            .select("commit_hash", "r.*"))


def ledger_total(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total_commits"))


def ledger_ordinal(log: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """Zero-based index of each call in append order (``seq``)."""
    return ordinal_index(log, "seq", "ordinal", block_rows)


def ledger_by_index(log: DataFrame) -> DataFrame:
    """Every ordinal resolved the way an index lookup does: ordinal -> hash
    -> the latest record of that hash."""
    o = ledger_ordinal(log).select("ordinal", "commit_hash")
    cur = ledger_current(log)
    return o.join(cur, "commit_hash")


def ledger_get(log: DataFrame, requests: DataFrame) -> DataFrame:
    """hash -> latest record; unknown hashes get the zero record."""
    cur = ledger_current(log).select(
        F.col("commit_hash").alias("_h"), "risk_score", "status", "submitter", "ts")
    j = requests.join(cur, requests["commit_hash"] == cur["_h"], "left")
    known = F.col("_h").isNotNull()
    return j.select(
        requests["commit_hash"].alias("requested_hash"),
        F.when(known, F.col("_h")).otherwise(F.lit("")).alias("commit_hash"),
        F.coalesce(F.col("risk_score"), F.lit(0)).alias("risk_score"),
        F.coalesce(F.col("status"), F.lit("")).alias("status"),
        F.coalesce(F.col("submitter"), F.lit(ZERO_ADDRESS)).alias("submitter"),
        F.col("ts"), known.alias("known"))
