"""Event-time streams: late and repeated rows, restarts, and state that goes."""

import datetime as dt

from riskloom.session import scratch_path
from riskloom.streaming import event_time as E
from riskloom.streaming import pipelines as P

START = dt.datetime(2024, 1, 1)


def minutes(m):
    return START + dt.timedelta(minutes=m)


def deliver(spark, rows, schema, src):
    """One file, newer than those before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)


def state(spark, out, **options):
    reader = spark.read.format("statestore")
    for k, v in options.items():
        reader = reader.option(k, v)
    with E.rocksdb(spark):
        return reader.load(out + ".checkpoint").collect()


def test_dedup_within_a_horizon(spark):
    schema, src, out = "commit_id long, commit_hash string, created_at timestamp_ntz", scratch_path(spark, "t-ev-src"), scratch_path(spark, "t-ev")

    def run(rows):
        deliver(spark, rows, schema, src)
        E.stream_dedup_within(P.read_stream(spark, src, spark.createDataFrame([], schema).schema), out, "10 minutes")
        return sorted(r.commit_id for r in spark.read.parquet(out).collect())

    assert run([(1, "a", minutes(0)), (2, "a", minutes(3)), (3, "b", minutes(1)), (4, "c", None)]) == [1, 3]
    # a restart; a copy inside the horizon, and a late row that is still in time
    assert run([(5, "b", minutes(9)), (6, "d", minutes(2)), (7, "e", minutes(30))]) == [1, 3, 6, 7]
    # the watermark is at 20 now: the copy of a is too late and dropped, b is new again beyond the horizon
    assert run([(8, "a", minutes(4)), (9, "b", minutes(31)), (10, "e", minutes(29)), (11, None, minutes(31)), (12, None, minutes(31))])[:5] == [1, 3, 6, 7, 9]
    run([(20 + k, f"f{k}", minutes(100 + k)) for k in range(5)])
    run([(30, "g", minutes(300))])
    run([(31, "g", minutes(301))])
    held = {r.key.commit_hash for r in state(spark, out)}
    assert held == {"g"}  # what lies behind the horizon is gone


def test_sessions_end_and_their_state_goes(spark):
    schema = "commit_id long, user_id long, commit_hash string, custom_score double, created_at timestamp_ntz"
    src, out = scratch_path(spark, "t-se-src"), scratch_path(spark, "t-se")

    def run(rows):
        deliver(spark, [(i, u, f"h{i}", 0.5 if wants else 0.0, at) for i, u, wants, at in rows], schema, src)
        E.stream_sessions(P.read_stream(spark, src, spark.createDataFrame([], schema).schema), out, "30 minutes", budget=2, rate=0.0)
        return {r.commit_id: (r.calls_before, r.llm_called, r.budget_used) for r in spark.read.schema(P.BUDGET_SCHEMA).parquet(out).collect()}

    got = run([(3, 1, True, minutes(2)), (1, 1, True, minutes(0)), (2, 1, False, minutes(1)), (4, 2, True, minutes(2)), (5, 2, True, None)])
    assert got == {1: (0, True, 1), 2: (1, False, 1), 3: (1, True, 2), 4: (0, True, 1)}
    # a restart goes on counting
    got = run([(6, 1, True, minutes(20)), (7, 2, True, minutes(21)), (8, 2, True, minutes(22))])
    assert (got[6], got[7], got[8]) == ((2, False, 2), (1, True, 2), (2, False, 2))
    run([(9, 3, True, minutes(200))])
    got = run([(10, 3, False, minutes(201))])
    assert {r.key.user_id for r in state(spark, out, stateVarName="used")} == {3}  # the sessions of 1 and 2 have ended
    got = run([(11, 1, True, minutes(202)), (12, 3, True, minutes(203))])
    assert got[11] == (0, True, 1) and got[12] == (1, True, 2)
