"""Registered queries, part 2: store writes and conflicts, policies and
constraints, object-store sinks, ledger views, routing and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as K
from ..functions.scalars import ledger_payload, profile_username  # noqa: F401
from ..operators import ledger, routing, scan, store, verdicts
from ..operators.keyed_store import KeyedTable, delete_where, insert_new
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import sinks
from . import analyze
from . import oracle as O
from .registry import BLANK, HASH, NL, STORED_CTES, register, stored_sql

B = K.CALL_BUDGET

# ----------------------------------------------------------- shared SQL

_SUB = f"SELECT commit_id, user_id, code_content, created_at, {HASH} AS commit_hash FROM commits WHERE NOT {BLANK}"
_B_HITS, _B_SEV = O.summary_b_sql("code_content")
_PLINES = "list_filter([" + ", ".join(
    f"CASE WHEN len({O.cat_matches_sql('code_content', ci)}) > 0 THEN '[Pattern Match] ' || {O.q(cat)} || ': ' || "
    f"array_to_string(list_slice({O.cat_matches_sql('code_content', ci)}, 1, 3), ', ') END"
    for ci, cat, _ in K.categories_a()) + "], lambda x: x IS NOT NULL)"

FLOW_CTES = {
    "_sub": _SUB,
    "_loc0": f"SELECT *, {_B_HITS} AS hit_count, {_B_SEV} AS max_severity, {O.floor_sql('code_content')} AS pattern_floor, "
             f"{_PLINES} AS plines, {O.categories_sql('code_content')} AS cats FROM _sub",
    "_loc": f"SELECT *, {O.heuristic_sql('max_severity', 'least(hit_count / 5.0, 1.0)')} AS custom_score FROM _loc0",
    "_want": (f"SELECT *, custom_score BETWEEN {O.dbl(0.35)} AND {O.dbl(0.70)} AS band, "
              f"{O.draw_sql('commit_hash')} < {O.dbl(K.SAMPLING_RATE)} AS sampled FROM _loc"),
    "_w2": (f"SELECT *, band OR sampled AS wants, CASE WHEN band THEN {O.q(K.REASON_BAND)} WHEN sampled THEN "
            f"{O.q(K.REASON_SAMPLE)} ELSE {O.q(K.REASON_CONFIDENT)} END AS reason0 FROM _want"),
    "_rt": ("SELECT *, coalesce(sum(CAST(wants AS BIGINT)) OVER (ORDER BY coalesce(created_at, "
            "TIMESTAMP '9999-12-31 00:00:00'), commit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb "
            "FROM _w2"),
    "_routed": (f"SELECT *, CAST(least(wb, {B}) AS BIGINT) AS calls_before, wb >= {B} AS budget_exhausted, "
                f"wants AND wb < {B} AS llm_called, CASE WHEN wb >= {B} THEN {O.q(K.REASON_EXHAUSTED % (B, B))} "
                f"ELSE reason0 END AS llm_reason, CAST(least(least(wb, {B}) + CAST(wants AND wb < {B} AS BIGINT), {B}) "
                "AS BIGINT) AS budget_used FROM _rt"),
}


def routed_ctes(budget: int | None = B, trained: bool = True, session: bool = False) -> dict[str, str]:
    """The routing CTEs for another budget, an untrained model or a budget per owner."""
    ctes = dict(FLOW_CTES)
    if not trained:
        ctes["_w2"] = f"SELECT *, true AS wants, {O.q(K.REASON_UNTRAINED)} AS reason0 FROM _want"
    if session:
        ctes["_rt"] = ctes["_rt"].replace("OVER (ORDER BY", "OVER (PARTITION BY user_id ORDER BY")
    if budget is None:
        ctes["_routed"] = ("SELECT *, CAST(NULL AS BIGINT) AS calls_before, false AS budget_exhausted, wants AS llm_called, "
                           "reason0 AS llm_reason, CAST(NULL AS BIGINT) AS budget_used FROM _rt")
    elif budget != B:
        ctes["_routed"] = (
            f"SELECT *, CAST(least(wb, {budget}) AS BIGINT) AS calls_before, wb >= {budget} AS budget_exhausted, "
            f"wants AND wb < {budget} AS llm_called, CASE WHEN wb >= {budget} THEN {O.q(K.REASON_EXHAUSTED % (budget, budget))} "
            f"ELSE reason0 END AS llm_reason, CAST(least(least(wb, {budget}) + CAST(wants AND wb < {budget} AS BIGINT), {budget}) "
            "AS BIGINT) AS budget_used FROM _rt")
    return ctes


def _parse_sql(content: str) -> dict[str, str]:
    num = f"regexp_extract({content}, '(?i)RISK_SCORE:\\s*([0-9.]+)', 1)"
    rr = f"regexp_extract({content}, '(?is)REASONING:\\s*(.+?)(?:VULNERABILITIES:|$)', 1)"
    vr = f"regexp_extract({content}, '(?is)VULNERABILITIES:\\s*(.+?)$', 1)"
    vt = f"(CASE WHEN {vr} = '' THEN 'None' ELSE {O.strip_sql(vr)} END)"
    sv = O.strip_sql("v")
    dash = O.strip_sql(f"regexp_replace({sv}, '^-+', '')")
    items = (f"list_transform(list_filter(string_split({vt}, chr(10)), lambda v: {sv} <> '' AND "
             f"{sv} NOT IN ('-', 'None', 'none') AND length({sv}) > 2), lambda v: {dash})")
    return {
        "llm_score": (f"CASE WHEN {num} = '' THEN {O.dbl(0.5)} WHEN TRY_CAST({num} AS DOUBLE) IS NULL THEN NULL "
                      f"ELSE round(least(greatest(TRY_CAST({num} AS DOUBLE), {O.dbl(0.0)}), {O.dbl(1.0)}), 4) END"),
        "llm_reasoning": f"CASE WHEN {rr} = '' THEN {O.q(K.DEFAULT_REASONING)} ELSE {O.strip_sql(rr)} END",
        "llm_vulns": f"CASE WHEN len({items}) > 0 THEN {items} ELSE [{O.q(K.NO_REVIEWER_VULNS)}] END",
        "parse_ok": f"({num} = '' OR TRY_CAST({num} AS DOUBLE) IS NOT NULL)",
    }


_PARSE = _parse_sql("content")
VER_CTE = {"_ver": "SELECT commit_id, " + ", ".join(f"{v} AS {k}" for k, v in _PARSE.items()) + " FROM llm_responses"}

_LOCAL_REASON = (f"'Local custom model score: ' || printf('%.2f', custom_score) || '. Pattern floor: ' || "
                 f"printf('%.2f', pattern_floor) || '. OpenRouter skipped (token budget conserved).'")
MERGE_CTES = {
    "_mj": "SELECT r.*, v.llm_score, v.llm_reasoning, v.llm_vulns, (r.llm_called AND v.llm_score IS NOT NULL) AS full_path "
           "FROM _routed r LEFT JOIN _ver v USING (commit_id)",
    "_merged": (
        "SELECT *, CASE WHEN full_path THEN round(greatest(llm_score, custom_score, pattern_floor), 4) "
        "ELSE round(greatest(custom_score, pattern_floor), 4) END AS raw, "
        f"CASE WHEN full_path THEN llm_reasoning ELSE {_LOCAL_REASON} END AS reasoning, "
        "CASE WHEN full_path THEN (CASE WHEN len(plines) > 0 THEN list_concat(plines, list_filter(llm_vulns, "
        "lambda v: NOT list_contains(plines, v))) ELSE llm_vulns END) "
        f"ELSE (CASE WHEN len(plines) > 0 THEN plines ELSE [{O.q(K.NO_PATTERN_LINE)}] END) END AS vulns, "
        f"CASE WHEN full_path THEN {O.q(K.MODE_FULL_TRAINED)} ELSE {O.q(K.MODE_LOCAL_TRAINED)} END AS analysis_mode, "
        "round(custom_score, 4) AS custom_model_score FROM _mj"),
    "_decided": (f"SELECT *, raw * 100 AS risk_score, {O.status_sql('raw')} AS status, "
                 f"{O.tx_sql('commit_hash', 'raw * 100', O.status_sql('raw'))} AS dlt_tx_hash FROM _merged"),
}


def flow_sql(body: str, *views: str, merge: bool = False, stored: bool = False) -> str:
    extra = dict(STORED_CTES) if stored else {}
    extra.update(FLOW_CTES)
    if merge:
        extra.update(VER_CTE)
        extra.update(MERGE_CTES)
    return O.with_views(body, "commits", *(["llm_responses"] if merge else []), *views, extra=extra)


def _routed(spark, sf, with_code: bool = False):
    """Routing over the narrow table; ``with_code`` adds text and findings of the routed rows."""
    s = scan.with_commit_hash(store.drop_blank_code(fx.commits(spark, sf)))
    r = routing.route_llm(analyze.routing_table(s), "custom_score", trained=True)
    return scan.with_findings(analyze.attach_code(r, fx.commits(spark, sf))) if with_code else r


def _merged(spark, sf):
    s = scan.with_commit_hash(store.drop_blank_code(fx.commits(spark, sf)))
    r = analyze.routed_findings(s, _routed(spark, sf))
    v = verdicts.llm_verdict_ingest(fx.llm_responses(spark, sf))
    return verdicts.merge_verdicts(r, v, trained=True)


# ------------------------------------------------------- store writes


def _hashed(spark, sf):
    return scan.with_commit_hash(store.drop_blank_code(fx.commits(spark, sf)))


#: Buckets of the keyed tables; the fixture is small.
BUCKETS = 8


def _commit_table(spark, rows, name="commit-table"):
    return KeyedTable.open(spark, scratch_path(spark, name), rows.schema, "commit_hash", BUCKETS)


@register("save_commits", stored_sql("SELECT commit_id, user_id, commit_hash, created_at FROM _held"))
def q_save_commits(spark, sf):
    """Two batches saved in order, the second one twice (a replay); the table
    as read back."""
    c = _hashed(spark, sf).select("commit_id", "user_id", "commit_hash", "created_at")
    table = _commit_table(spark, c)
    for batch in (fx.first_batch(c), fx.second_batch(c), fx.second_batch(c)):
        insert_new(table, batch, store.first_write_order())
    return table.read()


@register("existing_on_conflict", stored_sql(
    "SELECT b.commit_id, b.commit_hash, f.commit_id AS stored_commit_id, f.created_at AS stored_created_at, "
    f"f.commit_id <> b.commit_id AS is_duplicate FROM _base b JOIN _held f USING (commit_hash) "
    f"WHERE b.{O.SECOND_BATCH}"))
def q_existing_on_conflict(spark, sf):
    c = _hashed(spark, sf).select("commit_id", "commit_hash", "created_at")
    table = _commit_table(spark, c)
    insert_new(table, fx.first_batch(c), store.first_write_order())
    r = store.resolve_against(table, fx.second_batch(c))
    return r.select("commit_id", "commit_hash", "stored_commit_id", "stored_created_at", "is_duplicate")


@register("new_training_examples", O.with_views(
    "SELECT hash, ord, risk_score, source FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ord) AS rn "
    "FROM training_raw WHERE source = 'live_commit') t WHERE rn = 1 AND hash NOT IN "
    "(SELECT hash FROM training_raw WHERE source = 'openrouter_seed')", "training_raw"))
def q_new_training_examples(spark, sf):
    from ..operators.training import new_examples_for
    t = fx.training_raw(spark, sf).select("hash", "ord", "risk_score", "source")
    table = KeyedTable.open(spark, scratch_path(spark, "training-table"), t.schema, "hash", BUCKETS)
    insert_new(table, t.where("source = 'openrouter_seed'"), [F.col("ord").asc()])
    return new_examples_for(table, t.where("source = 'live_commit'")).select("hash", "ord", "risk_score", "source")


@register("union_training", O.with_views(
    "SELECT hash, ord, risk_score, source FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ord) AS rn "
    "FROM training_raw) t WHERE rn = 1", "training_raw"))
def q_union_training(spark, sf):
    from ..operators.training import union_training
    t = fx.training_raw(spark, sf)
    return union_training(t.where("source = 'openrouter_seed'"), t.where("source = 'live_commit'")) \
        .select("hash", "ord", "risk_score", "source")


# ------------------------------------------------- policies / constraints


@register("owner_rows", stored_sql(
    "SELECT commit_id, user_id FROM stored WHERE user_id IN (SELECT user_id FROM users)", "users"))
def q_owner_rows(spark, sf):
    return store.owner_rows(analyze.stored_commits(spark, sf), fx.users(spark, sf)).select("commit_id", "user_id")


@register("authorized_writes", stored_sql(
    "SELECT c.commit_id, c.op, c.actor_id, s.user_id AS old_user_id, c.new_user_id, reason = 'ok' AS accepted, reason "
    "FROM (SELECT c.*, s.user_id AS old_uid, CASE WHEN c.op = 'insert' THEN (CASE WHEN c.actor_id = c.new_user_id "
    "THEN 'ok' ELSE 'with_check_failed' END) WHEN s.user_id IS NULL THEN 'row_not_found' "
    "WHEN c.actor_id <> s.user_id THEN 'using_failed' WHEN c.op = 'update' AND c.actor_id <> c.new_user_id "
    "THEN 'with_check_failed' ELSE 'ok' END AS reason FROM changes c LEFT JOIN stored s USING (commit_id)) c "
    "LEFT JOIN stored s USING (commit_id)", "changes"))
def q_authorized_writes(spark, sf):
    return store.authorized_writes(fx.changes(spark, sf), analyze.stored_commits(spark, sf))


@register("orphan_commits", stored_sql(
    "SELECT commit_id, user_id FROM stored WHERE user_id NOT IN (SELECT user_id FROM users)", "users"))
def q_orphan_commits(spark, sf):
    return store.orphan_commits(analyze.stored_commits(spark, sf), fx.users(spark, sf)).select("commit_id", "user_id")


@register("cascade_delete", stored_sql(
    "SELECT commit_id, user_id FROM stored WHERE user_id NOT IN (SELECT user_id FROM deleted_users)",
    "deleted_users"))
def q_cascade_delete(spark, sf):
    return store.cascade_delete(analyze.stored_commits(spark, sf), fx.deleted_users(spark, sf)) \
        .select("commit_id", "user_id")


# The same requests carried out on the stored table: deletes, updates of the score, inserts.
_APPLY_CTES = {
    "_table": "SELECT commit_id, user_id, commit_hash, risk_score, created_at FROM stored",
    "_asked": ("SELECT c.*, CASE WHEN c.op = 'insert' THEN c.actor_id = c.new_user_id WHEN s.user_id IS NULL THEN false "
               "WHEN c.actor_id <> s.user_id THEN false ELSE c.op = 'delete' OR c.actor_id = c.new_user_id END AS accepted "
               "FROM changes c LEFT JOIN _table s USING (commit_id)"),
    "_kept": ("SELECT commit_id, user_id, commit_hash, CASE WHEN commit_id IN (SELECT commit_id FROM _asked WHERE accepted AND op = 'update') "
              "THEN CAST(commit_id % 100 AS DOUBLE) ELSE risk_score END AS risk_score, created_at FROM _table "
              "WHERE commit_id NOT IN (SELECT commit_id FROM _asked WHERE accepted AND op = 'delete')"),
    "_added": ("SELECT commit_id, user_id, commit_hash, risk_score, created_at FROM (SELECT b.commit_id, a.new_user_id AS user_id, b.commit_hash, "
               "CAST(0 AS DOUBLE) AS risk_score, b.created_at, row_number() OVER (PARTITION BY b.commit_hash ORDER BY b.created_at ASC NULLS LAST, "
               "b.commit_id) AS rn FROM _base b JOIN _asked a USING (commit_id) WHERE a.accepted AND a.op = 'insert' "
               "AND b.commit_hash NOT IN (SELECT commit_hash FROM _kept)) WHERE rn = 1"),
}


@register("applied_writes", O.with_views("SELECT * FROM _kept UNION ALL SELECT * FROM _added", "commits", "changes",
                                         extra={**STORED_CTES, **_APPLY_CTES}))
def q_applied_writes(spark, sf):
    """The stored table after a batch of requests, which comes twice (a replay)."""
    c = analyze.stored_commits(spark, sf).select("commit_id", "user_id", "commit_hash", "risk_score", "created_at")
    table = _commit_table(spark, c)
    insert_new(table, c, store.first_write_order())
    asked = fx.changes(spark, sf).withColumn("risk_score", (F.col("commit_id") % 100).cast("double"))
    offered = _hashed(spark, sf).select("commit_id", "commit_hash", "created_at") \
        .join(asked.select("commit_id", F.col("new_user_id").alias("user_id"), F.lit(0.0).alias("risk_score")), "commit_id")
    for _ in range(2):
        store.apply_writes(table, asked, offered, ["risk_score"], batch_id=0)
    return table.read()


@register("cascade_applied", stored_sql(
    "SELECT commit_id, user_id, commit_hash FROM stored WHERE user_id NOT IN (SELECT user_id FROM deleted_users)", "deleted_users"))
def q_cascade_applied(spark, sf):
    """The stored table after accounts went: buckets without rows of theirs keep their files."""
    c = analyze.stored_commits(spark, sf).select("commit_id", "user_id", "commit_hash", "created_at")
    table = _commit_table(spark, c)
    insert_new(table, c, store.first_write_order())
    for _ in range(2):
        delete_where(table, fx.deleted_users(spark, sf), "user_id", "cascade", 0)
    return table.read().select("commit_id", "user_id", "commit_hash")


_VIOL = ("list_filter([CASE WHEN user_id IS NULL THEN 'user_id is null' END, "
         "CASE WHEN commit_hash IS NULL THEN 'commit_hash is null' END, "
         "CASE WHEN code_content IS NULL THEN 'code_content is null' END, "
         "CASE WHEN risk_score IS NULL THEN 'risk_score is null' END, "
         "CASE WHEN risk_score < 0 OR risk_score > 100 THEN 'risk_score out of range' END, "
         "CASE WHEN status IS NULL OR status NOT IN ('Accepted', 'Rollback Enforced') THEN 'status not allowed' END], "
         "lambda x: x IS NOT NULL)")


@register("valid_commits", O.with_views(
    f"SELECT commit_id, user_id, commit_hash, risk_score, status FROM commit_candidates WHERE len({_VIOL}) = 0",
    "commit_candidates"))
def q_valid_commits(spark, sf):
    v, _ = store.split_valid(fx.commit_candidates(spark, sf))
    return v.select("commit_id", "user_id", "commit_hash", "risk_score", "status")


@register("rejected_commits", O.with_views(
    f"SELECT commit_id, array_to_string({_VIOL}, '; ') AS violations FROM commit_candidates WHERE len({_VIOL}) > 0",
    "commit_candidates"))
def q_rejected_commits(spark, sf):
    _, r = store.split_valid(fx.commit_candidates(spark, sf))
    return r.select("commit_id", F.array_join("violations", "; ").alias("violations"))


@register("unique_violations", O.with_views(
    "SELECT 'username' AS key_name, username AS key_value, count(*) AS n FROM users GROUP BY username HAVING count(*) > 1 "
    "UNION ALL SELECT 'email', email, count(*) FROM users GROUP BY email HAVING count(*) > 1 "
    f"UNION ALL SELECT 'commit_hash', commit_hash, count(*) FROM ({_SUB}) GROUP BY commit_hash HAVING count(*) > 1",
    "users", "commits"))
def q_unique_violations(spark, sf):
    return store.unique_violations(fx.users(spark, sf), _hashed(spark, sf))


@register("profile_defaults", O.with_views(
    "SELECT user_id, email, coalesce(nullif(meta_username, ''), nullif(split_part(email, '@', 1), ''), 'user') "
    "AS username FROM auth_users WHERE user_id NOT IN (SELECT user_id FROM users)", "auth_users", "users"))
def q_profile_defaults(spark, sf):
    return store.profile_defaults(fx.auth_users(spark, sf), fx.users(spark, sf))


@register("commit_lookup", stored_sql(
    "SELECT r.commit_id, r.requester_id, s.commit_id IS NOT NULL AS found, s.commit_hash, s.risk_score, s.status, "
    "s.dlt_tx_hash, s.created_at AS timestamp FROM detail_requests r LEFT JOIN stored s "
    "ON r.commit_id = s.commit_id AND r.requester_id = s.user_id", "detail_requests"))
def q_commit_lookup(spark, sf):
    return store.commit_lookup(analyze.stored_commits(spark, sf), fx.detail_requests(spark, sf))


@register("commit_lookup_stored", stored_sql(
    "SELECT r.commit_id, r.requester_id, s.commit_id IS NOT NULL AS found, s.commit_hash, s.risk_score, s.status, "
    "s.dlt_tx_hash, s.created_at AS timestamp FROM detail_requests r LEFT JOIN stored s "
    "ON r.commit_id = s.commit_id AND r.requester_id = s.user_id", "detail_requests"))
def q_commit_lookup_stored(spark, sf):
    """The same details from a table keyed by id: the requests move, the table does not."""
    st = analyze.stored_commits(spark, sf)
    table = KeyedTable.open(spark, scratch_path(spark, "details"), st.schema, "commit_id", BUCKETS)
    table.append(st)
    asked = fx.detail_requests(spark, sf)
    return store.commit_lookup(table.lookup(asked), asked)


# ---------------------------------------------------- object store sinks


def _objects_path(spark, stored):
    """Write code objects (one partitioned table keyed by owner) and
    return its path."""
    from ..sources.sinks import write_code_objects
    path = scratch_path(spark, "code-objects")
    write_code_objects(stored, path)
    return path


@register("write_code_objects", stored_sql(
    f"SELECT user_id, commit_hash, printf({O.q(K.CODE_OBJECT_KEY)}, CAST(user_id AS VARCHAR), commit_hash) "
    "AS s3_code_key, length(code_content) AS code_chars FROM stored"))
def q_write_code_objects(spark, sf):
    from ..sources.sinks import read_code_objects
    path = _objects_path(spark, analyze.stored_commits_with_code(spark, sf))
    o = read_code_objects(spark, path)
    return o.select("user_id", "commit_hash", "s3_code_key", F.length("code_content").cast("long").alias("code_chars"))


@register("read_code_objects", stored_sql(
    "SELECT r.commit_id, r.requester_id, s.commit_hash IS NOT NULL AS found, length(s.code_content) AS code_chars "
    "FROM (SELECT r.commit_id, r.requester_id, h.commit_hash FROM detail_requests r JOIN stored h USING (commit_id)) r "
    "LEFT JOIN stored s ON s.user_id = r.requester_id AND s.commit_hash = r.commit_hash", "detail_requests"))
def q_read_code_objects(spark, sf):
    from ..sources.sinks import get_code_objects, read_code_objects
    st = analyze.stored_commits(spark, sf)
    o = read_code_objects(spark, _objects_path(spark, analyze.stored_commits_with_code(spark, sf)))
    req = fx.detail_requests(spark, sf).join(st.select("commit_id", "commit_hash"), "commit_id")
    g = get_code_objects(o, req.withColumnRenamed("requester_id", "user_id"))
    return g.select("commit_id", F.col("user_id").alias("requester_id"), F.col("code_content").isNotNull().alias("found"),
                    F.length("code_content").cast("long").alias("code_chars"))


@register("code_with_fallback", stored_sql(
    "SELECT s.commit_id, coalesce(nullif(CASE WHEN s.created_at IS NULL THEN '' ELSE s.code_content END, ''), "
    "o.code_content, '') AS code_content FROM stored s LEFT JOIN "
    "(SELECT * FROM stored WHERE user_id IN (SELECT user_id FROM users)) o "
    "ON s.user_id = o.user_id AND s.commit_hash = o.commit_hash", "users"))
def q_code_with_fallback(spark, sf):
    """Table code is missing for legacy rows (no time); the object copy
    exists for owners with a profile."""
    st = analyze.stored_commits_with_code(spark, sf)
    details = st.select("commit_id", "user_id", "commit_hash",
                        F.when(F.col("created_at").isNull(), F.lit("")).otherwise(F.col("code_content"))
                        .alias("code_content"))
    objs = store.owner_rows(st, fx.users(spark, sf)).select("user_id", "commit_hash", "code_content")
    return store.code_with_fallback(details, objs).select("commit_id", "code_content")


@register("export_commit_code", stored_sql(
    f"SELECT commit_id, printf({O.q(K.DOWNLOAD_NAME)}, commit_hash) AS filename, code_content FROM stored "
    "WHERE coalesce(code_content, '') <> ''"))
def q_export_commit_code(spark, sf):
    from ..sources.sinks import export_commit_code
    return export_commit_code(analyze.stored_commits_with_code(spark, sf))


@register("write_analysis_results", stored_sql(
    "SELECT user_id, commit_hash, raw * 100 AS risk_score, " + O.status_sql("raw") + " AS status, "
    "'Pattern floor score: ' || printf('%.2f', raw) || '. Custom model not yet trained. OpenRouter skipped "
    "(token budget conserved).' AS reasoning, " + O.lines_sql("code_content") + " AS vulnerabilities, "
    + O.tx_sql("commit_hash", "raw * 100", O.status_sql("raw")) + " AS dlt_tx_hash, "
    f"printf({O.q(K.RESULT_OBJECT_KEY)}, CAST(user_id AS VARCHAR), commit_hash) AS s3_result_key FROM _floored"))
def q_write_analysis_results(spark, sf):
    from ..sources.sinks import analysis_results, read_analysis_results, write_analysis_results
    st = analyze.stored_commits_with_findings(spark, sf)
    path = scratch_path(spark, "analysis-results")
    write_analysis_results(analysis_results(st), path)
    r = read_analysis_results(spark, path)
    return r.select("user_id", "commit_hash", "risk_score", "status", "reasoning",
                    F.array_join("vulnerabilities", NL).alias("vulnerabilities"), "dlt_tx_hash", "s3_result_key")


# ------------------------------------------------------------- ledger

_LEDGER_TS = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(seq)"
_VALID = "length(coalesce(commit_hash, '')) > 0 AND risk_score BETWEEN 0 AND 100"
LEDGER_CTES = {
    "_log": f"SELECT seq, commit_hash, risk_score, status, submitter, {_LEDGER_TS} AS ts FROM ledger_calls WHERE {_VALID}",
    "_cur": ("SELECT commit_hash, seq, risk_score, status, submitter, ts FROM (SELECT *, row_number() OVER "
             "(PARTITION BY commit_hash ORDER BY seq DESC) AS rn FROM _log) WHERE rn = 1"),
    "_placed": "SELECT *, row_number() OVER (ORDER BY seq % 2, seq) - 1 AS spot FROM _log",
    "_ord": "SELECT seq, commit_hash, CAST(row_number() OVER (ORDER BY seq) - 1 AS BIGINT) AS ordinal FROM _log",
}


def ledger_sql(body: str, *views: str) -> str:
    return O.with_views(body, "ledger_calls", *views, extra=LEDGER_CTES)


def _log(spark, sf):
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq)")
    return ledger.accepted_calls(fx.ledger_calls(spark, sf), ts_col=ts)


_SEQ2 = "(SELECT count(*) FROM _log WHERE seq % 2 = 0) + row_number() OVER (ORDER BY seq) - 1"


#: Calls of a block of the stored log; the fixture is small.
LEDGER_BLOCK = 256


@register("append_ledger", ledger_sql(
    "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, commit_hash, risk_score, status, submitter, ts, "
    "concat('0x', sha256(concat_ws('|', CAST(row_number() OVER (ORDER BY seq) - 1 AS VARCHAR), commit_hash, CAST(risk_score AS VARCHAR), status))) "
    "AS tx_id FROM _log WHERE seq % 2 = 0 UNION ALL "
    f"SELECT {_SEQ2}, commit_hash, risk_score, status, submitter, ts, "
    f"concat('0x', sha256(concat_ws('|', CAST({_SEQ2} AS VARCHAR), commit_hash, CAST(risk_score AS VARCHAR), status))) FROM _log WHERE seq % 2 <> 0"))
def q_append_ledger(spark, sf):
    """Two appends to a stored log: the second continues the first's numbers."""
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq)")
    calls, path = fx.ledger_calls(spark, sf), scratch_path(spark, "ledger")
    for part in ("seq % 2 = 0", "seq % 2 <> 0"):
        ledger.append_ledger_to(spark, path, calls.where(part), ts, block_calls=LEDGER_BLOCK)
    return ledger.read_log(spark, path)


@register("ledger_valid", ledger_sql(f"SELECT seq, ({_VALID}) AS valid FROM ledger_calls"))
def q_ledger_valid(spark, sf):
    return fx.ledger_calls(spark, sf).select("seq", ledger.is_valid().alias("valid"))


@register("ledger_current", ledger_sql("SELECT * FROM _cur"))
def q_ledger_current(spark, sf):
    return ledger.ledger_current(_log(spark, sf)).select("commit_hash", "seq", "risk_score", "status", "submitter", "ts")


@register("ledger_ordinal", ledger_sql("SELECT seq, commit_hash, ordinal FROM _ord"))
def q_ledger_ordinal(spark, sf):
    return ledger.ledger_ordinal(_log(spark, sf)).select("seq", "commit_hash", "ordinal")


@register("ledger_total", ledger_sql("SELECT count(*) AS total_commits FROM _log"))
def q_ledger_total(spark, sf):
    return ledger.ledger_total(_log(spark, sf))


@register("ledger_by_index", ledger_sql(
    "SELECT o.ordinal, c.commit_hash, c.seq, c.risk_score, c.status, c.submitter, c.ts FROM _ord o "
    "JOIN _cur c USING (commit_hash)"))
def q_ledger_by_index(spark, sf):
    return ledger.ledger_by_index(_log(spark, sf)).select("ordinal", "commit_hash", "seq", "risk_score", "status",
                                                          "submitter", "ts")


@register("ledger_by_index_stored", ledger_sql(
    "SELECT o.spot AS ordinal, commit_hash, o2.spot AS seq, o2.risk_score, o2.status, o2.submitter, o2.ts FROM _placed o JOIN "
    "(SELECT * FROM _placed QUALIFY row_number() OVER (PARTITION BY commit_hash ORDER BY spot DESC) = 1) o2 USING (commit_hash) "
    "WHERE o.spot % 2 = 0"))
def q_ledger_by_index_stored(spark, sf):
    """Every second position of a log of two appends, through blocks and buckets."""
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq)")
    calls, path = fx.ledger_calls(spark, sf), scratch_path(spark, "ledger")
    for part in ("seq % 2 = 0", "seq % 2 <> 0"):
        ledger.append_ledger_to(spark, path, calls.where(part), ts, block_calls=LEDGER_BLOCK)
    log = ledger.read_log(spark, path).drop("tx_id")
    current = KeyedTable.open(spark, scratch_path(spark, "ledger-current"), log.schema, "commit_hash", BUCKETS)
    ledger.record_calls(current, log)
    positions = log.select(F.col("seq").alias("ordinal")).where("ordinal % 2 = 0")
    return ledger.ledger_at(spark, path, current, positions, LEDGER_BLOCK) \
        .select("ordinal", "commit_hash", "seq", "risk_score", "status", "submitter", "ts")


_REQ_SQL = (f"SELECT DISTINCT {HASH} AS commit_hash FROM commits UNION "
            "SELECT DISTINCT substr(sha256(text), 1, 16) FROM documents")


@register("ledger_get", ledger_sql(
    f"SELECT r.commit_hash AS requested_hash, coalesce(c.commit_hash, '') AS commit_hash, "
    f"coalesce(c.risk_score, 0) AS risk_score, coalesce(c.status, '') AS status, "
    f"coalesce(c.submitter, {O.q(K.ZERO_ADDRESS)}) AS submitter, c.ts, c.commit_hash IS NOT NULL AS known "
    f"FROM ({_REQ_SQL}) r LEFT JOIN _cur c ON r.commit_hash = c.commit_hash", "commits"))
def q_ledger_get(spark, sf):
    from ..functions.scalars import commit_hash
    from ..sources.tables import read_table
    a = fx.commits(spark, sf).select(commit_hash(F.col("code_content")).alias("commit_hash"))
    b = read_table(spark, sf, "documents").select(commit_hash(F.col("text")).alias("commit_hash"))
    req = a.union(b).distinct()
    return ledger.ledger_get(_log(spark, sf), req)


@register("ledger_payload", stored_sql(
    "SELECT commit_hash, concat('0x', rpad(commit_hash, 64, '0'), CASE WHEN status = 'Accepted' THEN '01' ELSE '00' END, "
    "lpad(lower(hex(least(greatest(CAST(trunc(risk_score) AS INTEGER), 0), 100))), 2, '0')) AS payload FROM stored"))
def q_ledger_payload(spark, sf):
    s = analyze.stored_commits(spark, sf)
    return s.select("commit_hash", ledger_payload(F.col("commit_hash"), F.col("risk_score"), F.col("status"))
                    .alias("payload"))


@register("mock_tx_hash", stored_sql("SELECT commit_hash, risk_score, status, dlt_tx_hash FROM stored"))
def q_mock_tx_hash(spark, sf):
    return analyze.stored_commits(spark, sf).select("commit_hash", "risk_score", "status", "dlt_tx_hash")


# ------------------------------------------------------------ routing


@register("route_budget", flow_sql(
    "SELECT commit_id, wants AS wants_review, calls_before, budget_exhausted, budget_used FROM _routed"))
def q_route_budget(spark, sf):
    return _routed(spark, sf).select("commit_id", "wants_review", "calls_before", "budget_exhausted", "budget_used")


@register("route_llm", flow_sql("SELECT commit_id, custom_score, llm_called, llm_reason FROM _routed"))
def q_route_llm(spark, sf):
    return _routed(spark, sf).select("commit_id", "custom_score", "llm_called", "llm_reason")


@register("budget_usage", flow_sql(
    f"SELECT CAST(count_if(llm_called) AS BIGINT) AS used, CAST({B} AS BIGINT) AS \"limit\", "
    f"CAST(greatest(0, {B} - count_if(llm_called)) AS BIGINT) AS remaining, {O.dbl(K.CONFIDENCE_THRESHOLD)} AS "
    f"confidence_threshold, {O.dbl(K.SAMPLING_RATE)} AS sampling_rate FROM _routed"))
def q_budget_usage(spark, sf):
    return routing.budget_usage(_routed(spark, sf))


_ROUTE_SQL = "SELECT commit_id, wants AS wants_review, calls_before, budget_exhausted, llm_called, llm_reason, budget_used FROM _routed"
SESSION_BUDGET = 5


def _route_branch(spark, sf, **how):
    table = analyze.routing_table(_hashed(spark, sf))
    return routing.route_llm(table, "custom_score", **how).select(
        "commit_id", "wants_review", "calls_before", "budget_exhausted", "llm_called", "llm_reason", "budget_used")


@register("route_llm_untrained", O.with_views(_ROUTE_SQL, "commits", extra=routed_ctes(trained=False)))
def q_route_untrained(spark, sf):
    """Without a fitted model every row wants a review, up to the budget."""
    return _route_branch(spark, sf, trained=False)


@register("route_llm_session", O.with_views(_ROUTE_SQL, "commits", extra=routed_ctes(SESSION_BUDGET, session=True)))
def q_route_session(spark, sf):
    """One budget for each owner, as for each session of a server."""
    return _route_branch(spark, sf, trained=True, budget=SESSION_BUDGET, session_col="user_id")


@register("route_llm_unlimited", O.with_views(_ROUTE_SQL, "commits", extra=routed_ctes(None)))
def q_route_unlimited(spark, sf):
    """A budget of zero is no budget."""
    return _route_branch(spark, sf, trained=True, budget=0)


# ----------------------------------------------------------- verdicts


@register("llm_verdict_ingest", O.with_views(
    "SELECT commit_id, llm_score, llm_reasoning, array_to_string(llm_vulns, chr(10)) AS llm_vulnerabilities, parse_ok "
    "FROM _ver", "llm_responses", extra=VER_CTE))
def q_llm_verdict_ingest(spark, sf):
    v = verdicts.llm_verdict_ingest(fx.llm_responses(spark, sf))
    return v.select("commit_id", "llm_score", "llm_reasoning",
                    F.array_join("llm_vulnerabilities", NL).alias("llm_vulnerabilities"), "parse_ok")


_TS_NUM = f"regexp_extract({O.strip_sql('content')}, '([0-9]\\.[0-9]+|[01])', 1)"


@register("teacher_score_ingest", O.with_views(
    f"SELECT commit_id, CASE WHEN {_TS_NUM} = '' THEN NULL ELSE round(least(greatest(CAST({_TS_NUM} AS DOUBLE), "
    f"{O.dbl(0.0)}), {O.dbl(1.0)}), 4) END AS teacher_score FROM llm_responses", "llm_responses"))
def q_teacher_score_ingest(spark, sf):
    r = fx.llm_responses(spark, sf)
    return r.select("commit_id", verdicts.teacher_score(F.col("content")).alias("teacher_score"))


_GEN = "regexp_replace(regexp_replace(content, '^```\\w*\\n?', ''), '\\n?```$', '')"


@register("generated_code_clean", O.with_views(
    f"SELECT gen_id, nullif({O.strip_sql(_GEN)}, '') AS code FROM generated_replies", "generated_replies"))
def q_generated_code_clean(spark, sf):
    g = fx.generated_replies(spark, sf)
    return g.select("gen_id", verdicts.generated_code_clean(F.col("content")).alias("code"))


@register("final_score_local", flow_sql(
    f"SELECT commit_id, round(greatest(custom_score, pattern_floor), 4) AS risk_score, {_LOCAL_REASON} AS reasoning, "
    f"{O.q(K.MODE_LOCAL_TRAINED)} AS analysis_mode, round(custom_score, 4) AS custom_model_score FROM _loc"))
def q_final_score_local(spark, sf):
    s = analyze.with_local_scores(_hashed(spark, sf))
    loc = verdicts.final_score_local(F.col("pattern_floor"), F.col("custom_score"), trained=True)
    return s.select("commit_id", *[v.alias(k) for k, v in loc.items()])


@register("merge_verdicts", flow_sql(
    "SELECT commit_id, full_path AS reviewer_used, risk_score, status, reasoning, analysis_mode, custom_model_score "
    "FROM _decided", merge=True))
def q_merge_verdicts(spark, sf):
    m = analyze.with_decision(_merged(spark, sf).withColumnRenamed("risk_score", "risk_score_raw"))
    used = F.col("analysis_mode") == F.lit(K.MODE_FULL_TRAINED)
    return m.select("commit_id", used.alias("reviewer_used"), "risk_score", "status", "reasoning", "analysis_mode",
                    "custom_model_score")


_LOCAL_UNTRAINED = ("'Pattern floor score: ' || printf('%.2f', pattern_floor) || '. Custom model not yet trained. "
                    "OpenRouter skipped (token budget conserved).'")


@register("merge_verdicts_untrained", O.with_views(
    "SELECT commit_id, raw * 100 AS risk_score, " + O.status_sql("raw") + " AS status, reasoning, analysis_mode, custom_model_score FROM ("
    "SELECT commit_id, CASE WHEN full_path THEN round(greatest(llm_score, pattern_floor), 4) ELSE round(pattern_floor, 4) END AS raw, "
    f"CASE WHEN full_path THEN llm_reasoning ELSE {_LOCAL_UNTRAINED} END AS reasoning, "
    f"CASE WHEN full_path THEN {O.q(K.MODE_FULL)} ELSE {O.q(K.MODE_LOCAL)} END AS analysis_mode, {O.dbl(0.0)} AS custom_model_score "
    "FROM _mj)", "commits", "llm_responses", extra={**routed_ctes(trained=False), **VER_CTE, "_mj": MERGE_CTES["_mj"]}))
def q_merge_untrained(spark, sf):
    """Both modes of an untrained model: reviewer and pattern, or pattern alone."""
    s = _hashed(spark, sf)
    r = routing.route_llm(analyze.routing_table(s), "custom_score", trained=False)
    m = verdicts.merge_verdicts(analyze.routed_findings(s, r), verdicts.llm_verdict_ingest(fx.llm_responses(spark, sf)), trained=False)
    m = analyze.with_decision(m.withColumnRenamed("risk_score", "risk_score_raw"))
    return m.select("commit_id", "risk_score", "status", "reasoning", "analysis_mode", "custom_model_score")


@register("final_score_full", flow_sql(
    "SELECT commit_id, raw AS final_score, llm_score, custom_score, pattern_floor FROM _decided WHERE full_path",
    merge=True))
def q_final_score_full(spark, sf):
    m = _merged(spark, sf).where(F.col("analysis_mode") == K.MODE_FULL_TRAINED)
    return m.select("commit_id", F.col("risk_score").alias("final_score"), "llm_score", "custom_score", "pattern_floor")


@register("merged_vulnerabilities", flow_sql(
    "SELECT commit_id, array_to_string(vulns, chr(10)) AS vulnerabilities_text, CAST(len(vulns) AS BIGINT) AS n_items "
    "FROM _decided", merge=True))
def q_merged_vulnerabilities(spark, sf):
    m = _merged(spark, sf)
    return m.select("commit_id", F.array_join("vulnerabilities", NL).alias("vulnerabilities_text"),
                    F.size("vulnerabilities").cast("long").alias("n_items"))


_PROMPT_BEFORE, _rest = K.REVIEWER_PROMPT.split("%s", 1)
_PROMPT_MID, _PROMPT_AFTER = _rest.split("%s", 1)
_CTX_B, _CTX_A = K.REVIEWER_CONTEXT.split("%s", 1)


@register("export_llm_requests", flow_sql(
    f"SELECT commit_id, commit_hash, {O.q(_PROMPT_BEFORE)} || code_content || {O.q(_PROMPT_MID)} || "
    f"(CASE WHEN len(cats) > 0 THEN {O.q(_CTX_B)} || array_to_string(cats, ', ') || {O.q(_CTX_A)} ELSE '' END) || "
    f"{O.q(_PROMPT_AFTER)} AS prompt FROM _routed WHERE llm_called"))
def q_export_llm_requests(spark, sf):
    """The requests as JSON lines, read back; the prompt is the one inside the body."""
    path = scratch_path(spark, "llm-requests")
    sinks.write_llm_requests(verdicts.export_llm_requests(_routed(spark, sf, with_code=True)), path)
    return sinks.read_llm_requests(spark, path).select("commit_id", "commit_hash", F.col("body.messages")[1]["content"].alias("prompt"))


@register("analysis_response", flow_sql(
    "SELECT f.commit_id AS commit_id, d.commit_hash, d.risk_score, d.status, f.created_at AS timestamp, d.dlt_tx_hash, "
    "d.reasoning, array_to_string(d.vulns, chr(10)) AS vulnerabilities, d.analysis_mode, d.llm_called AS "
    "openrouter_called, d.llm_reason AS openrouter_reason, round(d.custom_score * 100, 2) AS custom_model_score, "
    f"d.budget_used, CAST({B} AS BIGINT) AS budget_limit, CAST(greatest(0, {B} - d.budget_used) AS BIGINT) AS "
    "budget_remaining, f.commit_id <> d.commit_id AS duplicate, "
    f"printf({O.q(K.CODE_OBJECT_KEY)}, CAST(d.user_id AS VARCHAR), d.commit_hash) AS s3_code_key "
    "FROM _decided d JOIN _held f USING (commit_hash)", merge=True, stored=True))
def q_analysis_response(spark, sf):
    c = fx.commits(spark, sf)
    st = analyze.stored_commits_from(fx.first_batch(c))
    a = analyze.analyze_submissions(c, fx.llm_responses(spark, sf), st)
    r = analyze.analysis_response(a)
    return r.withColumn("vulnerabilities", F.array_join("vulnerabilities", NL))
