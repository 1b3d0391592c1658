"""End-to-end batch plans over the commit corpus.

``stored_commits``: submissions -> non-blank -> hash -> first per hash ->
rule floor -> local verdict -> percentage, status, ledger tx id.  One
shuffle (the keep-first window, partially limited map-side); the scan and
everything after it is narrow.

``analyze_submissions``: the per-request flow for a whole batch: findings
and features once per row, stand-in or model score, routing under the
budget, verdict merge, status, conflicts against the store, response.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as K
from ..functions.features import heuristic_score
from ..functions.scalars import mock_tx_hash, risk_percentage, risk_status
from ..operators import routing, scan, store, verdicts
from ..session import materialize
from ..sources import fixtures as fx

STORE_COLUMNS = ["commit_id", "user_id", "commit_hash", "risk_score", "status",
                 "code_content", "dlt_tx_hash", "created_at"]


def with_decision(df: DataFrame, score_col: str = "risk_score_raw") -> DataFrame:
    """pct, status and the ledger tx id from a 0..1 score."""
    pct = risk_percentage(F.col(score_col))
    st = risk_status(F.col(score_col))
    return (df.withColumn("risk_score", pct).withColumn("status", st)
            .withColumn("dlt_tx_hash", mock_tx_hash(F.col("commit_hash"), F.col("risk_score"), F.col("status"))))


def with_code(kept: DataFrame, source: DataFrame) -> DataFrame:
    """The code text of kept rows, fetched by id for results that hold it."""
    return kept.join(source.select("commit_id", "code_content"), "commit_id")


def stored_commits_from(commits: DataFrame) -> DataFrame:
    """The store's rows without the text: the floor is computed beside the
    scan, so the first-write shuffle carries hash, time, id and score only."""
    c = scan.with_pattern_floor(scan.with_commit_hash(store.drop_blank_code(commits))).drop("code_content")
    c = store.first_commit_per_hash(c)
    c = c.withColumn("risk_score_raw", F.round(F.greatest(F.lit(0.0), F.col("pattern_floor")), 4))
    return with_decision(c).select(*[x for x in STORE_COLUMNS if x != "code_content"])


def stored_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_commits_from(fx.commits(spark, sf_dir))


def stored_commits_with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_code(stored_commits(spark, sf_dir), fx.commits(spark, sf_dir)).select(*STORE_COLUMNS)


def stored_commits_with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows with the local (untrained) verdict texts: reasoning and
    vulnerability lines from one scan of the kept rows."""
    c = scan.with_findings(scan.with_commit_hash(store.drop_blank_code(fx.commits(spark, sf_dir))))
    c = store.first_commit_per_hash(c.drop("code_content", "evidence"))
    loc = verdicts.final_score_local(F.col("pattern_floor"), F.lit(0.0), trained=False)
    c = c.withColumn("risk_score_raw", loc["risk_score"]).withColumn("reasoning", loc["reasoning"])
    return with_decision(c).select(*[x for x in STORE_COLUMNS if x != "code_content"], "reasoning", "vulnerabilities")


def with_local_scores(df: DataFrame, code_col: str = "code_content") -> DataFrame:
    """Findings and the heuristic stand-in score in one narrow pass."""
    return with_stand_in_score(scan.with_findings_and_b(df, code_col))


def with_stand_in_score(df: DataFrame) -> DataFrame:
    """``custom_score`` from the catalog-B summary, for callers without a fitted model."""
    hits = F.least(F.col("hit_count") / F.lit(5.0), F.lit(1.0))
    return df.withColumn("custom_score", heuristic_score(F.col("max_severity"), hits)).drop("hit_count", "max_severity")


def routing_table(submissions: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """What routing reads and no more: id, owner, time, hash and score, written
    once.  ``scores`` (commit_id, custom_score) brings a fitted model's scores;
    without it the stand-in is computed from catalog B alone."""
    keys = ["commit_id", "user_id", "created_at", "commit_hash"]
    if scores is None:
        narrow = with_stand_in_score(scan.with_rule_summary_b(submissions))
    else:
        narrow = submissions.join(scores.select("commit_id", "custom_score"), "commit_id")
    return materialize(narrow.select(*keys, "custom_score"), "routing")


def routed_findings(submissions: DataFrame, routed: DataFrame) -> DataFrame:
    """Findings of the submissions beside their routing; the text stays in the scan."""
    f = scan.with_findings(submissions).select("commit_id", "pattern_floor", "evidence", "vulnerabilities")
    return routed.join(f, "commit_id")


def attach_code(routed: DataFrame, source: DataFrame) -> DataFrame:
    """Code text for the routed rows only (at most the call budget)."""
    calls = routed.where("llm_called")
    return calls.join(source.select("commit_id", "code_content"), "commit_id")


def analyze_submissions(submissions: DataFrame, replies: DataFrame | None, stored: DataFrame,
                        trained: bool = True, budget: int | None = K.CALL_BUDGET,
                        rate: float = K.SAMPLING_RATE, scores: DataFrame | None = None) -> DataFrame:
    """Batch form of the request flow; one row per non-blank submission.
    Routing runs on the narrow table, findings are scanned for the output."""
    s = scan.with_commit_hash(store.drop_blank_code(submissions))
    s = routed_findings(s, routing.route_llm(routing_table(s, scores), "custom_score", trained=trained, budget=budget, rate=rate))
    v = (verdicts.llm_verdict_ingest(replies) if replies is not None else
         submissions.sparkSession.createDataFrame(
             [], "commit_id bigint, llm_score double, llm_reasoning string, "
                 "llm_vulnerabilities array<string>, parse_ok boolean"))
    m = verdicts.merge_verdicts(s, v, trained)
    m = m.withColumnRenamed("risk_score", "risk_score_raw")
    m = with_decision(m)
    return store.resolve_conflicts(stored, m)


def analysis_response(analyzed: DataFrame, budget: int | None = K.CALL_BUDGET) -> DataFrame:
    """The 14-field result per submission, budget fields flattened."""
    lim = F.lit(budget or 0).cast("long")
    return analyzed.select(
        F.col("stored_commit_id").alias("commit_id"),
        "commit_hash", "risk_score", "status",
        F.col("stored_created_at").alias("timestamp"),
        "dlt_tx_hash", "reasoning", "vulnerabilities", "analysis_mode",
        F.col("llm_called").alias("openrouter_called"), F.col("llm_reason").alias("openrouter_reason"),
        F.round(F.col("custom_score") * 100, 2).alias("custom_model_score"),
        F.col("budget_used").alias("budget_used"), lim.alias("budget_limit"),
        F.greatest(F.lit(0).cast("long"), lim - F.col("budget_used")).alias("budget_remaining"),
        F.col("is_duplicate").alias("duplicate"),
        F.format_string(K.CODE_OBJECT_KEY, F.col("user_id").cast("string"), F.col("commit_hash")).alias("s3_code_key"),
    )
