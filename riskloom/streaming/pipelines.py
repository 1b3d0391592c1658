"""Structured Streaming versions of the batch transforms.

* ``stream_scan``: stateless per-row scoring; the same columns as batch.
* ``stream_dedup``: first write wins on ``commit_hash`` against the commit
  store itself, a keyed table (``operators.keyed_store``).  The store is the
  state, so the dedup horizon is unbounded and exact.
* ``stream_recent_log``: the audit page (newest 50 per user), keyed by owner.
* ``stream_budget``: the reviewer call counter per session, keyed by session.
* ``stream_ledger``: current record per hash from the call feed, keyed by hash.
* ``stream_learn``: verdicts appended to the training store, keyed by hash; a
  retrain is due when its size crosses a multiple of ``RETRAIN_STEP``.

What a micro-batch of a keyed job writes is of the size of the batch, what it
reads are the buckets of its own keys, and a batch that is replayed after a lost
executor or a restarted driver is known by its number and changes nothing.

Every job can be started again on its target: the checkpoint stands beside
the target (``<target>.checkpoint`` unless the caller names another), so a
second start goes on where the first ended, batch ids never repeat, and no
batch folder is written over.  Tables live where the caller says, on a cluster
under a shared folder such as ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import CALL_BUDGET, LOG_PAGE, RETRAIN_STEP, SAMPLING_RATE
from ..operators import ledger, routing, store
from ..operators.keyed_store import KeyedTable, insert_new
from ..session import path_exists

# ------------------------------------------------------------------ source


def write_stream_source(df: DataFrame, path: str, order: list, n_files: int = 8) -> None:
    """Test harness: ``df`` as ``n_files`` parquet files in ``order`` (range
    partitioned, sorted inside), with increasing modification times so the
    file source takes them in that order."""
    df.repartitionByRange(n_files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(st.getPath().toString() for st in fs.listStatus(root)
                   if st.getPath().getName().endswith(".parquet"))
    base = int(time.time() * 1000) - 1000 * (len(files) + 1)
    for i, f in enumerate(files):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(f), base + 1000 * i, -1)


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def publish_files(spark: SparkSession, staged: str, path: str, first: int, last: int) -> None:
    """Test harness: move files ``first`` to ``last`` (exclusive, in name order)
    of a staged source to where the stream reads, times kept."""
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    files = sorted(st.getPath().getName() for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staged}/*.parquet")))
    for name in files if (first, last) == (0, -1) else files[first:last]:
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{staged}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))


def run_available(writer, target: str, checkpoint: str | None = None) -> None:
    """Process everything available now, then stop; the checkpoint belongs to
    the target, so the next start continues after this one."""
    q = (writer.option("checkpointLocation", checkpoint or target.rstrip("/") + ".checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# ---------------------------------------------------------------- stateless


def stream_scan(stream: DataFrame, transform, out_path: str, checkpoint: str | None = None) -> None:
    """Append ``transform(stream)`` (row-wise) to a parquet table."""
    run_available(transform(stream).writeStream.format("parquet").option("path", out_path)
                  .outputMode("append"), out_path, checkpoint)


# -------------------------------------------------------------------- store


def read_store(spark: SparkSession, store_path: str, schema, exclude_batch: int | None = None) -> DataFrame:
    """A store kept as a keyed table, or as one folder per micro-batch (``b=<id>``)."""
    if not path_exists(spark, store_path):
        return spark.createDataFrame([], schema)
    if path_exists(spark, os.path.join(store_path, "spec.json")):
        return KeyedTable(spark, store_path).read().select(*schema.names)
    full = T.StructType(list(schema.fields) + [T.StructField("b", T.LongType())])
    d = spark.read.schema(full).parquet(store_path)
    if exclude_batch is not None:
        d = d.where(F.col("b") != F.lit(exclude_batch))
    return d.select(*schema.names)


def append_batch(spark: SparkSession, rows: DataFrame, store_path: str, batch_id: int) -> DataFrame:
    """Write a micro-batch's rows to their own folder (overwrite: a replayed
    batch replaces its earlier attempt) and return them as written."""
    path = os.path.join(store_path, f"b={batch_id}")
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def stream_dedup(stream: DataFrame, store_path: str, checkpoint: str | None = None, buckets: int | None = None) -> None:
    """First write per ``commit_hash`` into the keyed table at ``store_path``.
    A micro-batch reads the hashes of the buckets that its own hashes fall into
    and moves nothing that is stored; a batch that is there already is skipped."""
    table = KeyedTable.open(stream.sparkSession, store_path, stream.schema, "commit_hash", buckets)

    def save(batch: DataFrame, batch_id: int) -> None:
        insert_new(table, batch, store.first_write_order(), "dedup", batch_id)
        tidy(table)

    run_available(stream.writeStream.foreachBatch(save), store_path, checkpoint)


def tidy(table: KeyedTable, reduce=None) -> None:
    """Fold buckets of many small pieces; pieces that no recent version names go."""
    table.compact(reduce)
    table.vacuum()


def stream_recent_log(stream: DataFrame, store_path: str, log_root: str, k: int = LOG_PAGE, checkpoint: str | None = None,
                      buckets: int | None = None) -> None:
    """Store new first writes, and keep the top-``k`` page per user.

    Both are keyed tables, the pages by owner.  A micro-batch adds to the pages no
    more than the first ``k`` of its own rows of each owner; pieces that gather in
    a bucket are folded to ``k`` rows per owner now and then.  Readers take the
    first ``k`` (``read_pages``)."""
    spark = stream.sparkSession
    stored = KeyedTable.open(spark, store_path, stream.schema, "commit_hash", buckets)
    pages = KeyedTable.open(spark, log_root, stream.schema, "user_id", buckets)

    def first_k(rows: DataFrame) -> DataFrame:
        return store.top_k_per_group(rows, ["user_id"], store.log_order(), k)

    def save(batch: DataFrame, batch_id: int) -> None:
        added = insert_new(stored, batch, store.first_write_order(), "recent_log", batch_id)
        if added is None:  # stored before a failure: its rows are still to be shown
            added = stored.read(batch=stored.manifest()["streams"]["recent_log"]["batch"])
        pages.append(first_k(added), "recent_log", batch_id)
        tidy(pages, first_k)
        tidy(stored)

    run_available(stream.writeStream.foreachBatch(save), log_root, checkpoint)


def read_pages(spark: SparkSession, log_root: str, k: int = LOG_PAGE) -> DataFrame:
    """The page of every owner (``log_rank`` 1 = newest), without an exchange."""
    return store.latest_per_user(KeyedTable(spark, log_root).read(), k)


# ------------------------------------------------------------------ budget


BUDGET_SCHEMA = ("commit_id long, user_id long, wants_review boolean, calls_before long, "
                 "budget_exhausted boolean, llm_called boolean, budget_used long")


def stream_budget(scored: DataFrame, out_path: str, session_col: str = "user_id", budget: int = CALL_BUDGET,
                  rate: float = SAMPLING_RATE, trained: bool = True, checkpoint: str | None = None, buckets: int | None = None) -> None:
    """Route scored rows under a per-session call budget; rows of one session
    are counted in arrival order (time, then id) inside a micro-batch and after
    all earlier micro-batches.

    Only the first ``budget`` wanting rows of a session matter in a batch; they
    are found by a limit that works before the shuffle, so a session that sends
    most rows never meets in one task.  Calls of earlier batches stand in a keyed
    table of counts per session: a batch adds the counts of its own sessions and
    reads the buckets of these."""
    spark = scored.sparkSession
    used_schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("used", T.LongType())])
    counters = KeyedTable.open(spark, out_path.rstrip("/") + ".sessions", used_schema, "user_id", buckets)

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id").agg(F.sum("used").alias("used"))

    def route(batch: DataFrame, batch_id: int) -> None:
        if counters.committed("budget", batch_id):
            return  # its rows were written before its counts
        rows = batch.withColumnRenamed(session_col, "user_id") if session_col != "user_id" else batch
        before = total(counters.matching(rows))
        r = routing.route_llm(rows, "custom_score", trained=trained, budget=budget, rate=rate, session_col="user_id") \
            .join(before, "user_id", "left")
        calls = F.least(F.coalesce("used", F.lit(0)) + F.col("calls_before"), F.lit(budget)).cast("long")
        r = r.withColumn("calls_before", calls).withColumn("budget_exhausted", F.col("calls_before") >= budget)
        r = r.withColumn("llm_called", F.col("wants_review") & ~F.col("budget_exhausted")) \
            .withColumn("budget_used", F.least(F.col("calls_before") + F.col("llm_called").cast("long"), F.lit(budget)).cast("long"))
        done = append_batch(spark, r.select(*[c.split()[0] for c in BUDGET_SCHEMA.split(", ")]), out_path, batch_id)
        counters.append(done.where("llm_called").groupBy("user_id").agg(F.count("*").alias("used")), "budget", batch_id)
        tidy(counters, total)

    run_available(scored.writeStream.foreachBatch(route), out_path, checkpoint)


# ------------------------------------------------------------------ ledger


def stream_ledger(calls: DataFrame, current_root: str, checkpoint: str | None = None, buckets: int | None = None) -> None:
    """Current record per hash: latest ``seq`` wins.  A micro-batch adds the latest
    record of each of its own hashes to a keyed table; superseded records go when
    a bucket is folded.  The stream itself keeps no state."""
    table = KeyedTable.open(calls.sparkSession, current_root, calls.schema, "commit_hash", buckets)

    def latest(rows: DataFrame) -> DataFrame:
        return ledger.ledger_current(rows).select(*table.columns)

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.append(latest(batch), "ledger", batch_id)
        tidy(table, latest)

    run_available(calls.writeStream.foreachBatch(merge), current_root, checkpoint)


def read_ledger(spark: SparkSession, current_root: str) -> DataFrame:
    """The current record per hash, without an exchange."""
    return ledger.ledger_current(KeyedTable(spark, current_root).read())


# ------------------------------------------------------------------- learn


def stream_learn(verdicts: DataFrame, store_path: str, retrain=None, step: int = RETRAIN_STEP,
                 checkpoint: str | None = None, buckets: int | None = None) -> list[int]:
    """Append new labelled examples (hash not stored yet) per micro-batch to a
    keyed table; when its size crosses a multiple of ``step``, call
    ``retrain(examples)``.  Returns the sizes at which it retrained.  Sizes stand in
    the table's manifest; a batch that is replayed after a failure retrains again if
    it crossed a multiple, as the failure may have come before."""
    table = KeyedTable.open(verdicts.sparkSession, store_path, verdicts.schema, "hash", buckets)
    retrained: list[int] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        insert_new(table, batch, [F.col("ord").asc()], "learn", batch_id)
        last = table.manifest()["streams"]["learn"]
        after, before = last["rows"], last["rows"] - last["added"]
        if after // step > before // step:
            retrained.append(after)
            if retrain is not None:
                retrain(table.read())
        tidy(table)

    run_available(verdicts.writeStream.foreachBatch(save), store_path, checkpoint)
    return retrained
