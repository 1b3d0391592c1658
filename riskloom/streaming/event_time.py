"""Streams with event-time state that Spark keeps and drops by itself.

* ``stream_dedup_within``: one row per key within a horizon of event time.  State
  holds the keys of the horizon only; later copies of a key are new again, and rows
  that come later than the horizon are dropped.  (``pipelines.stream_dedup`` is
  the exact form without a horizon.)
* ``stream_sessions``: the reviewer's call budget per session as keyed state, with a
  timer that ends a session after a gap.  (``pipelines.stream_budget`` keeps
  counts for ever, and splits a session that sends most rows.)

State stands in the RocksDB state store, so it is bounded by disk and not by the
executors' heap, and is checkpointed with the stream: a second start goes on with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.catalog import CALL_BUDGET, SAMPLING_RATE
from ..operators.routing import wants_review
from .pipelines import BUDGET_SCHEMA, run_available

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_dedup_within(stream: DataFrame, out_path: str, horizon: str, key: str = "commit_hash", time_col: str = "created_at",
                        checkpoint: str | None = None) -> None:
    """Append the first arrival of every key within ``horizon`` ("40 minutes") to
    a Parquet table.  Rows without a time have no place in a horizon: they are
    left to the exact form."""
    timed = stream.where(F.col(time_col).isNotNull()).withColumn("_time", F.col(time_col).cast("timestamp"))
    first = timed.withWatermark("_time", horizon).dropDuplicatesWithinWatermark([key]).drop("_time")
    with rocksdb(stream.sparkSession):
        run_available(first.writeStream.format("parquet").option("path", out_path).outputMode("append"), out_path, checkpoint)


class SessionBudget(StatefulProcessor):
    """Calls used per session.  Rows of a micro-batch are taken in order of time,
    then id; a session ends ``gap_ms`` after its last row."""

    def __init__(self, budget: int, gap_ms: int):
        self.budget, self.gap_ms = budget, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", T.StructType([T.StructField("calls", T.LongType()), T.StructField("ends", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one micro-batch of one session is held: its size is the trigger's limit at most
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "commit_id"], kind="stable")
        calls, ends = (int(v) for v in self.used.get()) if self.used.exists() else (0, -1)
        wants = batch["wants_review"].to_numpy(bool)
        before = (calls + wants.cumsum() - wants).clip(max=self.budget)
        called = wants & (before < self.budget)
        until = max(ends, int(batch["at"].iloc[-1].timestamp() * 1000) + self.gap_ms)
        if until > ends:
            if ends >= 0:
                self.handle.deleteTimer(ends)
            self.handle.registerTimer(until)
        self.used.update((min(self.budget, calls + int(wants.sum())), until))
        yield pd.DataFrame({
            "commit_id": batch["commit_id"], "user_id": key[0], "wants_review": wants, "calls_before": before, "budget_exhausted": before >= self.budget,
            "llm_called": called, "budget_used": (before + called).clip(max=self.budget)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_sessions(scored: DataFrame, out_path: str, gap: str, session_col: str = "user_id", budget: int = CALL_BUDGET, rate: float = SAMPLING_RATE,
                    trained: bool = True, lateness: str = "0 seconds", checkpoint: str | None = None) -> None:
    """Route scored rows under a call budget per session; a session that is silent
    for ``gap`` ("2 hours") of event time ends, and its next row begins a new one.
    Rows without a time belong to no session and are left out."""
    spark = scored.sparkSession
    wants, _ = wants_review(F.col("custom_score"), trained, rate, F.col("commit_hash"))
    rows = scored.where(F.col("created_at").isNotNull()).select("commit_id", F.col(session_col).alias("user_id"), F.col("created_at").cast("timestamp").alias("at"), wants.alias("wants_review"))
    gap_ms = spark.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {gap}"))).alias("ms")).first().ms
    routed = rows.withWatermark("at", lateness).groupBy("user_id").transformWithStateInPandas(
        SessionBudget(budget, gap_ms), BUDGET_SCHEMA, "append", "eventTime")
    with rocksdb(spark):
        run_available(routed.writeStream.format("parquet").option("path", out_path).outputMode("append"), out_path, checkpoint)
