"""Streaming: replayed micro-batches insert nothing twice; the learn loop
retrains exactly when the store crosses a multiple of the step."""

from pyspark.sql import functions as F

from riskloom.operators import scan, store
from riskloom.session import scratch_path
from riskloom.sources import fixtures as fx
from riskloom.streaming import pipelines as P


def test_dedup_replay_is_idempotent(spark, sf_small):
    c = scan.with_commit_hash(store.drop_blank_code(fx.commits(spark, sf_small)))
    c = c.select("commit_id", "commit_hash", "created_at")
    src_path = scratch_path(spark, "t-src")
    P.write_stream_source(c, src_path, store.first_write_order())
    store_path = scratch_path(spark, "t-store")
    batch = spark.read.parquet(src_path)
    # the same micro-batch saved twice (a replay after a failure)
    for _ in range(2):
        current = P.read_store(spark, store_path, batch.schema, exclude_batch=0)
        P.append_batch(spark, store.new_rows(current, batch), store_path, 0)
    got = P.read_store(spark, store_path, batch.schema)
    assert got.count() == got.select("commit_hash").distinct().count() == c.select("commit_hash").distinct().count()


def test_learn_retrains_on_step_crossings(spark, sf_small):
    t = fx.training_raw(spark, sf_small).select("hash", "code", "risk_score", "source", "ord")
    src_path = scratch_path(spark, "t-learn-src")
    P.write_stream_source(t, src_path, [F.col("ord")])
    calls = []
    sizes = P.stream_learn(P.read_stream(spark, src_path, t.schema), scratch_path(spark, "t-learn-store"),
                           retrain=lambda ex: calls.append(ex.count()), step=50)
    n = t.select("hash").distinct().count()
    assert sizes == calls
    assert len(sizes) >= 1 and sizes[-1] <= n
    assert all(b // 50 > a // 50 for a, b in zip([0] + sizes, sizes))


def test_second_start_keeps_the_first_rows(spark):
    """Two jobs with different rows on the same targets: nothing of the first goes."""
    d = spark.range(40).select(F.col("id").alias("commit_id"), F.sha2(F.col("id").cast("string"), 256).alias("commit_hash"),
                               F.lit(None).cast("timestamp_ntz").alias("created_at"), (F.col("id") % 3).alias("user_id"),
                               F.lit(0.5).alias("custom_score"))
    src, store_path, scan_path, log, budget = (scratch_path(spark, f"t-again-{k}") for k in range(5))
    for part in (0, 1):
        d.where(F.floor(F.col("commit_id") / 20) == part).coalesce(1).write.mode("append").parquet(src)
        stream = lambda: P.read_stream(spark, src, d.schema)
        P.stream_dedup(stream(), store_path)
        P.stream_scan(stream(), lambda s: s.select("commit_id"), scan_path)
        P.stream_recent_log(stream(), store_path + "-log-store", log, k=50)
        P.stream_budget(stream(), budget, budget=7)
    assert P.read_store(spark, store_path, d.schema).count() == 40
    assert spark.read.parquet(scan_path).count() == 40
    assert P.read_pages(spark, log).count() == 40
    rows = spark.read.parquet(budget)
    assert rows.count() == 40 and {r.n for r in rows.where("llm_called").groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {7}


def test_store_drift_is_an_error(spark):
    """A batch that lacks a column of the store must not be appended unchecked."""
    import pytest
    from pyspark.errors import AnalysisException

    path = scratch_path(spark, "t-drift")
    d = spark.createDataFrame([(1, "a", None), (2, "b", None)], "commit_id long, commit_hash string, created_at timestamp_ntz")
    store.save_commits_to(spark, path, d)
    store.save_commits_to(spark, path, d)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(AnalysisException):
        store.save_commits_to(spark, path, d.drop("commit_hash"))
    with pytest.raises(AnalysisException):
        store.save_commits_to(spark, path, d.select("commit_hash", "created_at", F.lit(1).alias("other"), F.col("commit_id").alias("commit")))
    assert spark.read.parquet(path).count() == 2
