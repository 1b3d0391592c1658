"""Registered queries: one Spark plan and one DuckDB oracle text per key.

Each query reads the driver's tables (or views Spark derives from them)
whole; array results are joined to text so that both engines hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as K
from ..functions import rules
from ..functions.features import heuristic_score, normalize_code, with_features, with_raw_counts
from ..functions.scalars import (commit_hash, risk_percentage, risk_status, risk_tier)
from ..operators import scan, store
from ..sources import fixtures as fx
from . import analyze
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


NL = "\n"

# ---------------------------------------------------------------- shared SQL

BLANK = O.is_blank_sql("code_content")
HASH = O.hash_sql("code_content")

STORED_CTES = {
    "_base": f"SELECT commit_id, user_id, code_content, created_at, {HASH} AS commit_hash FROM commits WHERE NOT {BLANK}",
    "_firsts": ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash "
                "ORDER BY created_at ASC NULLS LAST, commit_id) AS rn FROM _base) WHERE rn = 1"),
    "_floored": f"SELECT *, round(greatest({O.dbl(0.0)}, {O.floor_sql('code_content')}), 4) AS raw FROM _firsts",
    "_held": ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash "
              "ORDER BY commit_id % 2, created_at ASC NULLS LAST, commit_id) AS rn FROM _base) WHERE rn = 1"),
    "stored": (f"SELECT commit_id, user_id, commit_hash, raw * 100 AS risk_score, {O.status_sql('raw')} AS status, "
               f"code_content, {O.tx_sql('commit_hash', 'raw * 100', O.status_sql('raw'))} AS dlt_tx_hash, created_at "
               "FROM _floored"),
}


def stored_sql(body: str, *views: str) -> str:
    return O.with_views(body, "commits", *views, extra=STORED_CTES)


# ------------------------------------------------------- 2.1 scans / sinks


@register("scan_commits", O.with_views(
    "SELECT commit_id, user_id, created_at, length(code_content) AS code_chars FROM commits", "commits"))
def q_scan_commits(spark, sf):
    c = fx.commits(spark, sf)
    return c.select("commit_id", "user_id", "created_at", F.length("code_content").cast("long").alias("code_chars"))


@register("scan_users", O.with_views("SELECT user_id, username, email FROM users", "users"))
def q_scan_users(spark, sf):
    return fx.users(spark, sf)


# ------------------------------------------------- 2.2 projections/filters


@register("drop_blank_code", O.with_views(
    f"SELECT commit_id, user_id FROM commits WHERE NOT {BLANK}", "commits"))
def q_drop_blank(spark, sf):
    return store.drop_blank_code(fx.commits(spark, sf)).select("commit_id", "user_id")


@register("commit_hash", O.with_views(f"SELECT commit_id, {HASH} AS commit_hash FROM commits", "commits"))
def q_commit_hash(spark, sf):
    return fx.commits(spark, sf).select("commit_id", commit_hash(F.col("code_content")).alias("commit_hash"))


@register("risk_status", O.with_views(
    f"SELECT commit_id, f * 100 AS risk_pct, {O.status_sql('f')} AS status FROM "
    f"(SELECT commit_id, {O.floor_sql('code_content')} AS f FROM commits)", "commits"))
def q_risk_status(spark, sf):
    c = scan.with_pattern_floor(fx.commits(spark, sf))
    return c.select("commit_id", risk_percentage(F.col("pattern_floor")).alias("risk_pct"),
                    risk_status(F.col("pattern_floor")).alias("status"))


@register("risk_tier", stored_sql(
    "SELECT commit_id, risk_score, CASE WHEN risk_score < 50 THEN 'Low' WHEN risk_score < 75 THEN 'Medium' "
    "ELSE 'High' END AS tier FROM stored"))
def q_risk_tier(spark, sf):
    s = analyze.stored_commits(spark, sf)
    return s.select("commit_id", "risk_score", risk_tier(F.col("risk_score")).alias("tier"))


# --------------------------------------------------------- 2.3 rule scan


def _rule_hits_sql() -> str:
    parts = []
    for r in K.rules_a():
        m = O.m_sql("code_content", r)
        parts.append(
            f"SELECT commit_id, {O.q(r.category)} AS category, {O.dbl(r.severity)} AS severity, "
            f"CAST({r.pat_ord} AS BIGINT) AS pat_ord, len(m) AS n_matches, array_to_string(m, chr(10)) AS matches_text "
            f"FROM (SELECT commit_id, {m} AS m FROM commits) WHERE len(m) > 0")
    return O.with_views("\nUNION ALL\n".join(parts), "commits")


@register("rule_hits", _rule_hits_sql())
def q_rule_hits(spark, sf):
    h = scan.rule_hits(fx.commits(spark, sf), ["commit_id"])
    return h.select("commit_id", "category", "severity", F.col("pat_ord").cast("long").alias("pat_ord"),
                    F.size("matches").cast("long").alias("n_matches"),
                    F.array_join("matches", NL).alias("matches_text"))


@register("rule_hits_once", _rule_hits_sql())
def q_rule_hits_once(spark, sf):
    """The same table with every distinct text scanned once."""
    h = scan.once_per_hash(fx.commits(spark, sf), lambda d: scan.rule_hits(d, ["commit_id"]))
    return h.select("commit_id", "category", "severity", F.col("pat_ord").cast("long").alias("pat_ord"),
                    F.size("matches").cast("long").alias("n_matches"),
                    F.array_join("matches", NL).alias("matches_text"))


@register("pattern_floor", O.with_views(
    f"SELECT commit_id, {O.floor_sql('code_content')} AS pattern_floor FROM commits", "commits"))
def q_pattern_floor(spark, sf):
    return scan.with_pattern_floor(fx.commits(spark, sf)).select("commit_id", "pattern_floor")


def _evidence_sql() -> str:
    parts = []
    for ci, cat, sev in K.categories_a():
        m = O.cat_matches_sql("code_content", ci)
        parts.append(
            f"SELECT commit_id, {O.q(cat)} AS category, {O.dbl(sev)} AS severity, "
            f"array_to_string(list_slice(m, 1, 3), chr(10)) AS evidence_text, "
            f"CAST(least(len(m), 3) AS BIGINT) AS n_evidence "
            f"FROM (SELECT commit_id, {m} AS m FROM commits) WHERE len(m) > 0")
    return O.with_views("\nUNION ALL\n".join(parts), "commits")


@register("category_evidence", _evidence_sql())
def q_category_evidence(spark, sf):
    f = scan.with_findings(fx.commits(spark, sf))
    # explode_outer + null filter: a plain explode gets an inferred
    # size(evidence) > 0 filter that re-runs the rule scan below it
    e = f.select("commit_id", F.explode_outer("evidence").alias("e")).where(F.col("e").isNotNull())
    return e.select("commit_id", F.col("e.category").alias("category"), F.col("e.severity").alias("severity"),
                    F.array_join("e.matches", NL).alias("evidence_text"),
                    F.size("e.matches").cast("long").alias("n_evidence"))


@register("vulnerability_lines", O.with_views(
    f"SELECT commit_id, {O.lines_sql('code_content')} AS vulnerabilities_text FROM commits", "commits"))
def q_vulnerability_lines(spark, sf):
    f = scan.with_findings(fx.commits(spark, sf))
    return f.select("commit_id", F.array_join("vulnerabilities", NL).alias("vulnerabilities_text"))


def _findings_by_category_sql() -> str:
    parts = []
    for ci, cat, sev in K.categories_a():
        m = O.cat_matches_sql("code_content", ci)
        parts.append(
            f"SELECT commit_id, {O.q(cat)} AS category, {O.dbl(sev)} AS severity, "
            f"CAST(len(m) AS BIGINT) AS n_matches, array_to_string(m, chr(10)) AS matches_text "
            f"FROM (SELECT commit_id, {m} AS m FROM commits) WHERE len(m) > 0")
    return O.with_views("\nUNION ALL\n".join(parts), "commits")


@register("findings_by_category", _findings_by_category_sql())
def q_findings_by_category(spark, sf):
    f = scan.findings_by_category(fx.commits(spark, sf), ["commit_id"])
    return f.select("commit_id", "category", "severity", F.size("matches").cast("long").alias("n_matches"),
                    F.array_join("matches", NL).alias("matches_text"))


_B_HITS, _B_SEV = O.summary_b_sql("code_content")


@register("rule_summary_b", O.with_views(
    f"SELECT commit_id, {_B_HITS} AS hit_count, {_B_SEV} AS max_severity FROM commits", "commits"))
def q_rule_summary_b(spark, sf):
    return scan.with_rule_summary_b(fx.commits(spark, sf)).select("commit_id", "hit_count", "max_severity")


# ------------------------------------------------------ 2.9 features etc.

_RAW = O.features_sql("code_content")
_FC = O.feature_cols_sql()
_RAW_SELECT = ", ".join(f"{v} AS {k}" for k, v in _RAW.items())


@register("numeric_features", O.with_views(
    "SELECT commit_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _FC.items())
    + f" FROM (SELECT commit_id, {_RAW_SELECT} FROM commits)", "commits"))
def q_numeric_features(spark, sf):
    f = with_features(fx.commits(spark, sf))
    from ..functions.features import FEATURE_NAMES
    return f.select("commit_id", *[F.round(c, 6).alias(c) for c in FEATURE_NAMES])


@register("feature_counts", O.with_views(
    "SELECT commit_id, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _RAW.items() if k != "max_severity")
    + " FROM commits", "commits"))
def q_feature_counts(spark, sf):
    f = with_raw_counts(fx.commits(spark, sf))
    return f.select("commit_id", "hit_count", "line_count", "char_count", "comment_lines",
                    "risky_imports", "long_strings", "net_calls")


@register("risky_imports", O.with_views(
    f"SELECT commit_id, CAST({_RAW['risky_imports']} AS BIGINT) AS risky_imports FROM commits", "commits"))
def q_risky_imports(spark, sf):
    from ..functions.features import risky_import_count
    return fx.commits(spark, sf).select("commit_id", risky_import_count(F.col("code_content")).cast("long")
                                        .alias("risky_imports"))


@register("heuristic_score", O.with_views(
    f"SELECT commit_id, {O.heuristic_sql('max_severity', 'least(hit_count / 5.0, 1.0)')} AS heuristic_score "
    f"FROM (SELECT commit_id, {_B_HITS} AS hit_count, {_B_SEV} AS max_severity FROM commits)", "commits"))
def q_heuristic_score(spark, sf):
    f = with_features(fx.commits(spark, sf))
    return f.select("commit_id", heuristic_score(F.col("f_max_severity"), F.col("f_hits")).alias("heuristic_score"))


@register("normalize_code", O.with_views(
    f"SELECT commit_id, {O.normalize_sql('code_content')} AS normalized FROM commits", "commits"))
def q_normalize_code(spark, sf):
    return fx.commits(spark, sf).select("commit_id", normalize_code(F.col("code_content")).alias("normalized"))


# ------------------------------------------------------- store / audit log


@register("first_commit_per_hash", stored_sql(
    "SELECT commit_id, user_id, commit_hash, created_at FROM _firsts"))
def q_first_commit_per_hash(spark, sf):
    c = scan.with_commit_hash(store.drop_blank_code(fx.commits(spark, sf)))
    return store.first_commit_per_hash(c).select("commit_id", "user_id", "commit_hash", "created_at")


@register("stored_commits", stored_sql(
    "SELECT commit_id, user_id, commit_hash, risk_score, status, dlt_tx_hash, created_at FROM stored"))
def q_stored_commits(spark, sf):
    return analyze.stored_commits(spark, sf)


@register("log_with_user", stored_sql(
    "SELECT s.commit_id, s.commit_hash, s.risk_score, u.username, u.email FROM stored s "
    "LEFT JOIN users u ON s.user_id = u.user_id", "users"))
def q_log_with_user(spark, sf):
    j = store.log_with_user(analyze.stored_commits(spark, sf), fx.users(spark, sf))
    return j.select("commit_id", "commit_hash", "risk_score", "username", "email")


@register("log_projection", stored_sql(
    "SELECT s.commit_id, s.commit_hash, s.risk_score, coalesce(u.username, 'unknown') AS user, "
    "s.created_at AS timestamp, s.status, s.dlt_tx_hash FROM stored s LEFT JOIN users u ON s.user_id = u.user_id",
    "users"))
def q_log_projection(spark, sf):
    return store.log_projection(store.log_with_user(analyze.stored_commits(spark, sf), fx.users(spark, sf)))


@register("latest_per_user", stored_sql(
    "SELECT * FROM (SELECT user_id, commit_id, commit_hash, risk_score, created_at, "
    "CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, commit_id) AS BIGINT) "
    "AS log_rank FROM stored) WHERE log_rank <= 50"))
def q_latest_per_user(spark, sf):
    s = analyze.stored_commits(spark, sf).select("user_id", "commit_id", "commit_hash", "risk_score", "created_at")
    return store.latest_per_user(s)


@register("recent_logs", stored_sql(
    "SELECT commit_id, commit_hash, risk_score, status, created_at FROM stored WHERE user_id = 3 "
    "ORDER BY created_at DESC NULLS FIRST, commit_id LIMIT 50"))
def q_recent_logs(spark, sf):
    s = analyze.stored_commits(spark, sf)
    return store.recent_logs(s, 3).select("commit_id", "commit_hash", "risk_score", "status", "created_at")


@register("commits_per_user", stored_sql(
    "SELECT user_id, count(*) AS n_commits, least(count(*), 50) AS n_shown FROM stored GROUP BY user_id"))
def q_commits_per_user(spark, sf):
    return store.commits_per_user(analyze.stored_commits(spark, sf))


# further query groups register themselves on import
from . import q_flow  # noqa: E402,F401
from . import q_model  # noqa: E402,F401
from . import q_stream  # noqa: E402,F401
