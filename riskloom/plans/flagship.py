"""The flagship plan: every user's audit-log page over the scored store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..sources import fixtures as fx
from .analyze import stored_commits


def audit_log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 50 stored commits per owner with the owner's name: the page
    limit runs per owner before the profile join (partial window limit
    before the shuffle), so the join sees at most 50 rows per owner."""
    s = stored_commits(spark, sf_dir)
    page = store.latest_per_user(s)
    logs = store.log_with_user(page, fx.users(spark, sf_dir))
    return logs.select("commit_id", "commit_hash", "risk_score",
                       F.coalesce(F.col("username"), F.lit("unknown")).alias("user"),
                       F.col("created_at").alias("timestamp"), "status", "dlt_tx_hash",
                       F.col("user_id").alias("owner_id"), "log_rank")
