"""Registered streaming queries.

Each one lays the fixture down as eight ordered parquet files, runs the
streaming job over the first four and starts it again on the same target for
the rest, with ``maxFilesPerTrigger=1`` (eight micro-batches in all) and
``availableNow``, and returns the table the jobs wrote.  The oracle is
the batch SQL of the same result: the streams must agree with batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog as K
from ..functions.features import with_features
from ..functions.scalars import risk_percentage, risk_status
from ..operators import ledger, routing, scan, store
from ..operators import text_model as tm
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources.tables import read_table
from ..streaming import event_time as E
from ..streaming import pipelines as P
from ..streaming import refit as R
from . import analyze
from . import oracle as O
from .q_flow import FLOW_CTES, SESSION_BUDGET, ledger_sql, routed_ctes
from .registry import HASH, STORED_CTES, register, stored_sql

#: Buckets of the keyed tables; the fixture is small.
BUCKETS = 8


def _in_two_starts(df, order, name, start):
    """Run ``start(stream)`` twice on one target: over the first four files,
    then, as a new job, over the rest."""
    spark = df.sparkSession
    staged, path = scratch_path(spark, f"staged-{name}"), scratch_path(spark, f"src-{name}")
    P.write_stream_source(df, staged, order)
    for first, last in ((0, 4), (0, -1)):
        P.publish_files(spark, staged, path, first, last)
        start(P.read_stream(spark, path, df.schema))


@register("stream_scan", O.with_views(
    f"SELECT commit_id, {HASH} AS commit_hash, f AS pattern_floor, f * 100 AS risk_pct, {O.status_sql('f')} AS status "
    f"FROM (SELECT *, {O.floor_sql('code_content')} AS f FROM commits)", "commits"))
def q_stream_scan(spark, sf):
    out = scratch_path(spark, "stream-scan")

    def score(s):
        s = scan.with_pattern_floor(scan.with_commit_hash(s))
        return s.select("commit_id", "commit_hash", "pattern_floor",
                        risk_percentage(F.col("pattern_floor")).alias("risk_pct"),
                        risk_status(F.col("pattern_floor")).alias("status"))

    _in_two_starts(fx.commits(spark, sf), [F.col("commit_id")], "scan", lambda s: P.stream_scan(s, score, out))
    return spark.read.parquet(out)


def _hashed_commits(spark, sf):
    return scan.with_commit_hash(store.drop_blank_code(fx.commits(spark, sf)))


@register("stream_dedup", stored_sql("SELECT commit_id, commit_hash FROM _firsts"))
def q_stream_dedup(spark, sf):
    c = _hashed_commits(spark, sf).drop("code_content")
    path = scratch_path(spark, "stream-store")
    _in_two_starts(c, store.first_write_order(), "dedup", lambda s: P.stream_dedup(s, path, buckets=BUCKETS))
    return P.read_store(spark, path, c.schema).select("commit_id", "commit_hash")


@register("stream_recent_log", stored_sql(
    "SELECT * FROM (SELECT user_id, commit_id, commit_hash, risk_score, created_at, "
    "CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, commit_id) AS BIGINT) "
    "AS log_rank FROM stored) WHERE log_rank <= 50"))
def q_stream_recent_log(spark, sf):
    c = scan.with_pattern_floor(_hashed_commits(spark, sf))
    c = c.select("user_id", "commit_id", "commit_hash",
                 risk_percentage(F.round(F.greatest(F.lit(0.0), F.col("pattern_floor")), 4)).alias("risk_score"),
                 "created_at")
    store_path, log_root = scratch_path(spark, "stream-store"), scratch_path(spark, "stream-log")
    _in_two_starts(c, store.first_write_order(), "recent-log", lambda s: P.stream_recent_log(s, store_path, log_root, buckets=BUCKETS))
    return P.read_pages(spark, log_root)


_RT_SESSION = FLOW_CTES["_rt"].replace("OVER (ORDER BY", "OVER (PARTITION BY user_id ORDER BY")
_BUDGET_CTES = {**FLOW_CTES, "_rt": _RT_SESSION}


@register("stream_budget", O.with_views(
    "SELECT commit_id, user_id, wants AS wants_review, calls_before, budget_exhausted, llm_called, budget_used "
    "FROM _routed", "commits", extra=_BUDGET_CTES))
def q_stream_budget(spark, sf):
    s = analyze.routing_table(_hashed_commits(spark, sf))
    out = scratch_path(spark, "stream-budget")
    _in_two_starts(s, [routing.order_key("created_at", "commit_id")], "budget", lambda x: P.stream_budget(x, out, buckets=BUCKETS))
    return P.read_store(spark, out, T._parse_datatype_string(P.BUDGET_SCHEMA))


_LEARN_STEP = 50


@register("stream_learn", O.with_views(
    "SELECT hash, ord, risk_score, source FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ord) AS rn "
    "FROM training_raw) WHERE rn = 1", "training_raw"))
def q_stream_learn(spark, sf):
    """Labelled verdicts into the training store; sizes at which a fit was due
    cross a multiple of the step each (checked here, as they depend on the
    micro-batches)."""
    t = fx.training_raw(spark, sf).select("hash", "ord", "risk_score", "source")
    path, due = scratch_path(spark, "stream-learn"), []
    _in_two_starts(t, [F.col("ord")], "learn", lambda s: due.extend(P.stream_learn(s, path, step=_LEARN_STEP, buckets=BUCKETS)))
    if any(b // _LEARN_STEP <= a // _LEARN_STEP for a, b in zip([0] + due, due)):
        raise AssertionError(f"a fit was due without a crossing: {due}")
    return P.read_store(spark, path, t.schema)


@register("stream_ledger", ledger_sql("SELECT * FROM _cur"))
def q_stream_ledger(spark, sf):
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq)")
    log = ledger.accepted_calls(fx.ledger_calls(spark, sf), ts_col=ts)
    root = scratch_path(spark, "stream-ledger")
    _in_two_starts(log, [F.col("seq")], "ledger", lambda s: P.stream_ledger(s, root, buckets=BUCKETS))
    return P.read_ledger(spark, root).select("commit_hash", "seq", "risk_score", "status", "submitter", "ts")



_HORIZON = "40 minutes"


@register("stream_dedup_within", O.with_views(
    "SELECT commit_hash, CAST(1 AS BIGINT) AS n_rows FROM _base WHERE created_at IS NOT NULL GROUP BY commit_hash "
    "HAVING max(created_at) - min(created_at) <= INTERVAL 40 MINUTE", "commits", extra=STORED_CTES))
def q_stream_dedup_within(spark, sf):
    """Rows kept of every hash whose copies all lie within the horizon.  A tenth of
    the rows come 15 minutes late, an eighth come twice, and at the very end the
    rows of the first quarter come again, when their state is long gone."""
    c = _hashed_commits(spark, sf).where("created_at IS NOT NULL").select("commit_id", "commit_hash", "created_at")
    quarter = F.lit(c.count() // 4)
    i = F.col("commit_id")
    arrival = [F.when(i % 10 == 3, i + 15).otherwise(i), F.when(i % 8 == 0, i + 5), F.when(i < quarter, F.lit(1 << 40))]
    sent = c.withColumn("arrival", F.explode(F.array_compact(F.array(*[a.cast("long") for a in arrival]))))
    out = scratch_path(spark, "stream-within")
    _in_two_starts(sent, [F.col("arrival"), i], "within", lambda s: E.stream_dedup_within(s, out, _HORIZON))
    near = c.groupBy("commit_hash").agg((F.max("created_at") - F.min("created_at")).alias("span")).where(f"span <= interval {_HORIZON}")
    return spark.read.parquet(out).groupBy("commit_hash").agg(F.count("*").alias("n_rows")).join(near.select("commit_hash"), "commit_hash")


@register("stream_sessions", O.with_views(
    "SELECT commit_id, user_id, wants AS wants_review, calls_before, budget_exhausted, llm_called, budget_used FROM _routed "
    "WHERE created_at IS NOT NULL", "commits", extra=routed_ctes(SESSION_BUDGET, session=True)))
def q_stream_sessions(spark, sf):
    """A budget for each owner as keyed state; owners fall silent and their state goes."""
    s = analyze.routing_table(_hashed_commits(spark, sf))
    out = scratch_path(spark, "stream-sessions")
    _in_two_starts(s, [routing.order_key("created_at", "commit_id")], "sessions",
                   lambda x: E.stream_sessions(x, out, "3 hours", budget=SESSION_BUDGET))
    return spark.read.schema(P.BUDGET_SCHEMA).parquet(out)


_SMALL_FIT = {**K.GBT_PARAMS, "maxIter": 3, "maxDepth": 2}


@register("stream_refit", O.with_views(
    "SELECT commit_id, CASE WHEN commit_id < (SELECT count(*) FROM documents) // 2 THEN (SELECT count(DISTINCT hash) FROM training_raw "
    "WHERE ord < (SELECT count(*) FROM documents) // 2) ELSE (SELECT count(DISTINCT hash) FROM training_raw) END AS model_version, "
    "true AS at_least_floor FROM commits", "commits", "training_raw"))
def q_stream_refit(spark, sf):
    """Half of the examples, a fit, half of the commits scored; then, all jobs started
    anew, the other halves.  The version that scored each commit is the number of
    examples of its fit."""
    t = fx.training_raw(spark, sf).select("hash", "ord", "code", "risk_score", "source")
    c = fx.commits(spark, sf).select("commit_id", "code_content")
    half = F.lit(read_table(spark, sf, "documents").count() // 2)
    learn_src, score_src, store_path, out = (scratch_path(spark, f"refit-{n}") for n in ("examples", "commits", "store", "scores"))
    models = R.ModelStore(spark, scratch_path(spark, "refit-models"))
    for first in (True, False):
        for rows, key, src in ((t, "ord", learn_src), (c, "commit_id", score_src)):
            rows.where((F.col(key) < half) == F.lit(first)).coalesce(1).write.mode("append").parquet(src)
        R.stream_refit(P.read_stream(spark, learn_src, t.schema), store_path, models, step=1, params=_SMALL_FIT, buckets=BUCKETS)
        R.stream_score(P.read_stream(spark, score_src, c.schema), out, models)
    scores = P.read_store(spark, out, T._parse_datatype_string("commit_id long, model_version long, model_score double"))
    floor = with_features(tm.spread(c, "commit_id"), "code_content").select("commit_id", "f_max_severity")
    return scores.join(floor, "commit_id").select(
        "commit_id", "model_version", (F.col("model_score") >= F.round(F.least("f_max_severity", F.lit(1.0)), 4)).alias("at_least_floor"))
