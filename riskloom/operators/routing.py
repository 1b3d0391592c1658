"""Reviewer routing under a call budget.

A row is routed iff it wants a review and fewer than ``budget`` earlier
rows of its session wanted one (the budget check comes first; the counter
counts routed rows).  So only the first ``budget`` wanting rows per session
matter: they are found with a ``row_number() <= budget`` window (partial
``WindowGroupLimit`` before the shuffle, hot sessions included) and handed
back per session as one sorted key array of at most ``budget`` entries.
Each row then counts the entries before it.  The draw for background
sampling is a hash of the commit hash, so decisions are replayable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import (AMBIGUOUS_BAND, CALL_BUDGET, CONFIDENCE_THRESHOLD,
                                 REASON_BAND, REASON_CONFIDENT, REASON_EXHAUSTED,
                                 REASON_SAMPLE, REASON_UNTRAINED, SAMPLING_RATE)
from ..functions.scalars import hash_draw
from .store import top_k_per_group

#: Commits without a time come last, as in the first-write order of the store.
UNKNOWN_TS = "9999-12-31 00:00:00"


def order_key(ts_col: str, id_col: str) -> Column:
    """Total order of arrivals: time (unknown last), then id."""
    return F.struct(F.coalesce(F.col(ts_col), F.lit(UNKNOWN_TS).cast("timestamp_ntz")).alias("t"),
                    F.col(id_col).alias("i"))


def wants_review(score: Column, trained: bool, rate: float, hash_col: Column) -> tuple[Column, Column]:
    """(wants, reason) ignoring the budget."""
    if not trained:
        return F.lit(True), F.lit(REASON_UNTRAINED)
    lo, hi = AMBIGUOUS_BAND
    band = score.between(F.lit(lo), F.lit(hi))
    sampled = hash_draw(hash_col) < F.lit(rate)
    wants = band | sampled
    reason = (F.when(band, F.lit(REASON_BAND)).when(sampled, F.lit(REASON_SAMPLE))
              .otherwise(F.lit(REASON_CONFIDENT)))
    return wants, reason


def route_llm(df: DataFrame, score_col: str = "custom_score", trained: bool = True,
              budget: int | None = CALL_BUDGET, rate: float = SAMPLING_RATE,
              ts_col: str = "created_at", id_col: str = "commit_id",
              session_col: str | None = None, hash_col: str = "commit_hash",
              candidates: DataFrame | None = None) -> DataFrame:
    """Adds ``wants_review``, ``calls_before`` (routed rows earlier in the
    session), ``budget_exhausted``, ``llm_called``, ``llm_reason`` and
    ``budget_used`` (counter after this row).

    ``candidates`` may give the same rows in a narrow form (score, time, id,
    hash, session): the wanting rows are then looked up there, and ``df`` is
    passed through once, however wide it is."""
    wants, reason = wants_review(F.col(score_col), trained, rate, F.col(hash_col))
    d = df.withColumn("wants_review", wants).withColumn("_reason", reason) \
          .withColumn("_key", order_key(ts_col, id_col))
    unlimited = budget is None or budget <= 0
    if unlimited:
        out = (d.withColumn("calls_before", F.lit(None).cast("long"))
               .withColumn("budget_exhausted", F.lit(False)))
    else:
        keys = F.array_sort(F.collect_list("_key")).alias("_cands")
        empty = F.array().cast(T.ArrayType(d.schema["_key"].dataType))
        wanting = d if candidates is None else candidates.withColumn("wants_review", wants) \
            .withColumn("_key", order_key(ts_col, id_col))
        wanting = wanting.where("wants_review")
        if session_col:
            cand = top_k_per_group(wanting.select(session_col, "_key"), [session_col],
                                   [F.col("_key")], budget)
            d = d.join(cand.groupBy(session_col).agg(keys), session_col, "left")
            cands = F.coalesce(F.col("_cands"), empty)
        else:
            cand = wanting.select("_key").orderBy("_key").limit(budget)
            d = d.withColumn("_cands", cand.agg(keys).scalar())
            cands = F.coalesce(F.col("_cands"), empty)
        before = F.size(F.filter(cands, lambda k: k < F.col("_key"))).cast("long")
        out = (d.withColumn("calls_before", before)
               .withColumn("budget_exhausted", F.col("calls_before") >= F.lit(budget)))
    called = F.col("wants_review") & ~F.col("budget_exhausted")
    reason = F.when(F.col("budget_exhausted"),
                    F.lit(REASON_EXHAUSTED % (budget or 0, budget or 0))).otherwise(F.col("_reason"))
    used = (None if unlimited else
            F.least(F.col("calls_before") + called.cast("long"), F.lit(budget).cast("long")))
    out = out.withColumn("llm_called", called).withColumn("llm_reason", reason)
    out = out.withColumn("budget_used", used if used is not None else F.lit(None).cast("long"))
    return out.drop("_reason", "_key", *(["_cands"] if "_cands" in out.columns else []))


def budget_usage(routed: DataFrame, budget: int | None = CALL_BUDGET, rate: float = SAMPLING_RATE,
                 session_col: str | None = None) -> DataFrame:
    """used, limit, remaining, threshold and rate (per session if given)."""
    lim = F.lit(budget or 0).cast("long")
    g = routed.groupBy(session_col) if session_col else routed.groupBy()
    return g.agg(F.count_if(F.col("llm_called")).cast("long").alias("used")).select(
        *([session_col] if session_col else []), "used", lim.alias("limit"),
        F.greatest(F.lit(0).cast("long"), lim - F.col("used")).alias("remaining"),
        F.lit(CONFIDENCE_THRESHOLD).alias("confidence_threshold"),
        F.lit(rate).alias("sampling_rate"))
