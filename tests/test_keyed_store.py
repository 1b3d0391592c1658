"""Keyed tables: plans without an exchange on the stored side, published versions,
replays, races, and writes that follow the batch."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import keyed_store as K
from riskloom.operators import store
from riskloom.session import scratch_path

from test_plans import exchanges, plan

SCHEMA = "commit_hash string, commit_id long, user_id long, created_at timestamp_ntz"


def rows(spark, ids, shift=0):
    return spark.createDataFrame([(f"h{i}", i + shift, i % 7, None) for i in ids], SCHEMA)


def opened(spark, name="t-keyed", buckets=8):
    return K.KeyedTable.open(spark, scratch_path(spark, name), rows(spark, []).schema, "commit_hash", buckets)


def content(table, **how):
    return {r.commit_hash: r.commit_id for r in table.read(**how).collect()}


def size_of(table, batch=None):
    fs = table._fs(table.spark, table.root)
    return sum(fs.getContentSummary(table._path(table.spark, f"{table.root}/data/{n}")).getLength()
               for n in table._names(f"{table.root}/data", f"piece={batch or ''}*"))


def test_first_write_wins_and_replays(spark):
    t = opened(spark)
    order = store.first_write_order()
    assert t.read().count() == 0 and t.version() == -1
    assert K.insert_new(t, rows(spark, range(50)).union(rows(spark, range(20), 1000)), order, "s", 0).count() == 50
    assert K.insert_new(t, rows(spark, range(40, 60), 500), order, "s", 1).count() == 10
    version = t.version()
    assert K.insert_new(t, rows(spark, range(100, 110)), order, "s", 1) is None and t.version() == version
    # a second handle of the same folder, as another job would open it
    again = K.KeyedTable(spark, t.root)
    assert content(again) == {f"h{i}": i if i < 50 else i + 500 for i in range(60)}
    assert again.manifest()["rows"] == 60 and again.manifest()["streams"]["s"]["added"] == 10
    assert content(again, version=0) == {f"h{i}": i for i in range(50)}
    held = {r.commit_hash: r.commit_id for r in K.winners(again, rows(spark, range(55, 65), 7), order).collect()}
    assert held == {f"h{i}": i + (500 if i < 60 else 7) for i in range(55, 65)}


def test_no_exchange_on_the_stored_side(spark):
    t = opened(spark)
    K.insert_new(t, rows(spark, range(3000)), store.first_write_order())
    found = t.matching(rows(spark, range(10, 500, 5)))
    text = plan(found)
    assert "Bucketed: true" in text and "PartitionFilters: [piece" in text and "BroadcastExchange" not in text
    # the moved side holds the keys of the batch alone
    assert exchanges(found) and all(cols == ["commit_hash"] for cols in exchanges(found))
    by_key = t.read().groupBy("commit_hash").count()
    assert not exchanges(by_key)


def test_reads_only_the_buckets_of_the_batch(spark):
    t = opened(spark, buckets=16)
    K.insert_new(t, rows(spark, range(2000)), store.first_write_order())
    few = rows(spark, [3])
    assert len(t.buckets_of(few)) == 1 and [r.commit_id for r in t.matching(few).collect()] == [3]
    listed = plan(t.matching(few)).split("PartitionFilters: [")[1].split("]")[0]
    assert listed.count("b") < 40 and listed.count(",") <= 2


def test_writes_follow_the_batch_and_old_versions_go(spark):
    t = opened(spark, buckets=32)
    K.insert_new(t, rows(spark, range(20_000)), store.first_write_order())
    whole, files = size_of(t), {n for n in t._names(f"{t.root}/data", "piece=*")}
    buckets = K.update_where(t, rows(spark, [5, 6]).select("commit_hash", F.lit(-1).cast("long").alias("commit_id")), "commit_hash")
    new = set(t._names(f"{t.root}/data", "piece=*")) - files
    assert 1 <= len(new) == len(buckets) <= 2 and size_of(t) - whole < whole / 8
    assert content(t)["h5"] == content(t)["h6"] == -1 and t.read().count() == 20_000
    assert t.vacuum(keep=1) == len(buckets) and set(t._names(f"{t.root}/data", "piece=*")) >= new and t._versions() == [t.version()]
    assert t.read().count() == 20_000 and t.vacuum(keep=1) == 0


def test_deletes_and_unknown_rows(spark):
    t = opened(spark)
    K.insert_new(t, rows(spark, range(30)), store.first_write_order())
    gone = spark.createDataFrame([(2,), (2,), (None,), (99,)], "user_id long")
    touched = K.delete_where(t, gone, "user_id", "deletes", 0)
    want = {f"h{i}": i for i in range(30) if i % 7 != 2}
    assert touched and content(t) == want and t.manifest()["rows"] == len(want)
    assert K.delete_where(t, gone, "user_id", "deletes", 0) == [] and K.delete_where(t, gone, "user_id") == [] and content(t) == want
    assert K.delete_where(t, spark.range(7).withColumnRenamed("id", "user_id"), "user_id") and content(t) == {}
    with pytest.raises(ValueError):
        K.update_where(t, rows(spark, [1]), "commit_id")


def test_a_failed_batch_is_never_seen_and_a_race_is_an_error(spark, monkeypatch):
    t = opened(spark)
    K.insert_new(t, rows(spark, range(5)), store.first_write_order(), "s", 0)

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(K.KeyedTable, "_publish", dies)
        with pytest.raises(RuntimeError):
            t.append(rows(spark, range(5, 9)), "s", 1)
    assert len(content(t)) == 5 and not t.committed("s", 1)
    before = t.manifest()
    t.append(rows(spark, range(5, 9)), "s", 1)
    with pytest.raises(K.ConcurrentWrite):  # built on a version that another writer has followed
        t._publish(before, {}, 0, None, None)
    assert len(content(t)) == 9
    assert t.vacuum(keep=1) > 0 and len(content(t)) == 9  # what the failed batch had left
    assert not [n for n in t._names(f"{t.root}/manifest", "*") if not n.startswith("v")]


def test_null_keys_odd_names_and_compaction(spark):
    schema = "`a key` string, `v` double"
    t = K.KeyedTable.open(spark, scratch_path(spark, "t-odd"), spark.createDataFrame([], schema).schema, "a key", 4)
    for k in range(4):
        t.append(spark.createDataFrame([(None, 1.0), ("x", float(k)), ("", 2.0)], schema))
    fold = lambda d: d.groupBy("a key").agg(F.max("v").alias("v"))
    assert t.read().count() == 12 and len(t.compact(fold, most=3)) >= 1 and t.compact(fold, most=3) == []
    assert sorted((r["a key"] or "none", r.v) for r in t.read().collect()) == [("", 2.0), ("none", 1.0), ("x", 3.0)] \
        or sorted((str(r["a key"]), r.v) for r in t.read().collect()) == [("", 2.0), ("None", 1.0), ("x", 3.0)]
    with pytest.raises(ValueError):
        K.KeyedTable.open(spark, scratch_path(spark, "t-bad"), spark.createDataFrame([], "k int, Piece int").schema, "k")


def test_writes_go_on_behind_a_failure(spark, monkeypatch):
    """The updates of a batch fail; the replay deletes nothing again and ends as if nothing had happened."""
    schema = "commit_id long, user_id long, commit_hash string, risk_score double, created_at timestamp_ntz"
    t = K.KeyedTable.open(spark, scratch_path(spark, "t-apply"), spark.createDataFrame([], schema).schema, "commit_hash", 8)
    K.insert_new(t, spark.createDataFrame([(i, i % 3, f"h{i}", 0.0, None) for i in range(12)], schema), store.first_write_order())
    asked = spark.createDataFrame([(0, "delete", 0, 0, 1.0), (1, "update", 1, 1, 5.0), (1, "update", 1, 1, 7.0), (2, "update", 0, 2, 9.0), (3, "delete", 2, 0, 1.0),
                                   (20, "insert", 1, 1, 1.0), (21, "insert", 1, 2, 1.0), (22, "insert", 2, 2, 1.0), (99, "delete", 1, 1, 1.0)],
                                  "commit_id long, op string, actor_id long, new_user_id long, risk_score double")
    offered = spark.createDataFrame([(20, 1, "h0", 2.0, None), (21, 2, "new", 2.0, None), (22, 2, "h4", 2.0, None)], schema)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "update_where", dies)
        with pytest.raises(RuntimeError):
            store.apply_writes(t, asked, offered, ["risk_score"], 4)
    assert t.read().count() == 11
    for _ in range(2):
        judged = store.apply_writes(t, asked, offered, ["risk_score"], 4)
        assert judged.where("accepted").count() == 5
        got = {r.commit_id: (r.user_id, r.commit_hash, r.risk_score) for r in t.read().collect()}
        want = {i: (i % 3, f"h{i}", 0.0) for i in range(1, 12)} | {1: (1, "h1", 7.0), 20: (1, "h0", 2.0)}
        assert got == want  # h0 was free again, h4 was not


def test_streams_write_what_their_batches_hold(spark):
    """Twelve micro-batches of like size: the pieces of the last are no larger than
    those of the first, although the state has grown; folding keeps few pieces."""
    from riskloom.streaming import pipelines as P

    calls = spark.range(3000).select(F.col("id").alias("seq"), F.concat(F.lit("h"), (F.col("id") * 7919 % 1500).cast("string")).alias("commit_hash"),
                                     (F.col("id") % 100).cast("int").alias("risk_score"), F.lit("Accepted").alias("status"))
    src, root = scratch_path(spark, "t-calls"), scratch_path(spark, "t-current")
    P.write_stream_source(calls, src, [F.col("seq")], 12)
    written = []
    append = K.KeyedTable.append

    def noted(self, *a, **more):
        batch = append(self, *a, **more)
        written.append(size_of(self, batch))
        return batch

    K.KeyedTable.append = noted
    try:
        P.stream_ledger(P.read_stream(spark, src, calls.schema), root, buckets=4)
        P.stream_ledger(P.read_stream(spark, src, calls.schema), root, buckets=4)  # nothing new: nothing is written
    finally:
        K.KeyedTable.append = append
    assert len(written) == 12 and max(written) < 1.5 * min(written)
    t = K.KeyedTable(spark, root)
    assert max(len(p) for p in t.manifest()["pieces"].values()) <= K.MOST_PIECES + 1
    assert len(t._names(f"{root}/data", "piece=*")) < 4 * 12 and len(t._versions()) < 12  # old versions are gone
    got = {r.commit_hash: r.seq for r in P.read_ledger(spark, root).collect()}
    want = {r.commit_hash: r.seq for r in calls.groupBy("commit_hash").agg(F.max("seq").alias("seq")).collect()}
    assert got == want and not exchanges(P.read_ledger(spark, root))


def metrics(df):
    """Metrics of the scans of a plan that has run, AQE's final plan included."""
    df.collect()
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
            continue
        if "Scan parquet" in node.nodeName():
            found.append({n: node.metrics().apply(n).value() for n in ("numFiles", "numOutputRows")})
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_a_lookup_opens_the_files_of_its_keys(spark):
    t = opened(spark, buckets=32)
    K.insert_new(t, rows(spark, range(20_000)), store.first_write_order())
    few = rows(spark, [5, 77, 500_000])
    found = t.lookup(few)
    assert sorted(r.commit_id for r in found.collect()) == [5, 77]
    scans = metrics(t.lookup(few))
    assert len(scans) == 1 and scans[0]["numFiles"] <= 3 and scans[0]["numOutputRows"] <= 20_000 * 3 / 32 * 1.5
    assert not exchanges(found) and "PushedFilters: [In(commit_hash" in plan(found)
    # an unknown key of a known bucket: the bloom filter shuts the row group
    misses = [f"x{k}" for k in range(8)]
    asked = spark.createDataFrame([(m,) for m in misses], "commit_hash string")
    assert metrics(t.lookup(asked))[0]["numOutputRows"] <= 20_000 / 32 * 3
    more = t.lookup(rows(spark, range(100)), "commit_hash", most=10)
    assert more.count() == 100 and "LeftSemi" in plan(more)
    assert t.lookup(rows(spark, [])).count() == 0


def test_positions_read_their_blocks(spark):
    from riskloom.operators import ledger

    calls = spark.range(1000).select(F.col("id").alias("seq"), F.concat(F.lit("h"), (F.col("id") % 90).cast("string")).alias("commit_hash"),
                                     (F.col("id") % 120).cast("int").alias("risk_score"), F.lit("Accepted").alias("status"), F.lit("0x1").alias("submitter"))
    path, ts = scratch_path(spark, "t-log"), F.lit("2024-01-01").cast("timestamp_ntz")
    for part in ("seq < 400", "seq >= 400"):
        ledger.append_ledger_to(spark, path, calls.where(part), ts, block_calls=64)
    log = ledger.read_log(spark, path)
    n = log.count()
    assert [r.seq for r in log.orderBy("seq").collect()] == list(range(n)) and "block" not in log.columns
    current = K.KeyedTable.open(spark, scratch_path(spark, "t-cur"), log.schema, "commit_hash", 8)
    for step in (0, 1):
        ledger.record_calls(current, log.where(f"seq % 2 = {step}"))
    positions = spark.createDataFrame([(3,), (3,), (200,), (10**6,)], "ordinal long")
    found = ledger.ledger_at(spark, path, current, positions, 64)
    text = plan(found)
    assert "Window" not in text and "PartitionFilters: [isnotnull(block" in text or "PartitionFilters: [block" in text
    want = {r.ordinal: r.seq for r in ledger.ledger_by_index(log).where("ordinal in (3, 200)").collect()}
    assert {r.ordinal: r.seq for r in found.collect()} == want and len(want) == 2
