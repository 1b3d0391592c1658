"""DuckDB reference SQL for every registered query (the correctness oracle).

The fixture views are CTEs over the driver's pre-registered tables; rule
SQL is generated from the same catalog with the RE2 flags ``(?im-s)``.
Every computed column is aliased to the Spark name; doubles are DOUBLE,
integers BIGINT, arrays are joined to text.
"""

from __future__ import annotations

from ..functions import catalog as K
from ..functions.catalog import categories_a, rules_a, rules_b
from ..sources.fixtures import SNIPPETS

RX = "(?im-s)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# -- fixture views ----------------------------------------------------------

_SNIP_ROWS = ",\n ".join(f"({k}, {q(s)}, {v!r})" for k, (s, v) in enumerate(SNIPPETS))
TS = "timestamp '2024-01-01 00:00:00' + to_minutes(doc_id)"
SHA = "substr(sha256({}), 1, 16)"

VIEWS = {
    "snip": f"""SELECT k, replace(s, '~', chr(10)) AS snippet, CAST(sev AS DOUBLE) AS sev FROM (VALUES
 {_SNIP_ROWS}) AS t(k, s, sev)""",
    "commits": f"""SELECT doc_id AS commit_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 11 ELSE 100 + doc_id // 20 END AS user_id,
       CASE WHEN doc_id % 97 = 0 THEN concat(' ', chr(10), chr(9)) ELSE concat(snippet, text) END AS code_content,
       CASE WHEN doc_id % 89 = 0 THEN NULL ELSE {TS} END AS created_at, snip.sev AS sev
FROM documents JOIN snip ON documents.n_chars % 16 = snip.k""",
    "users": """SELECT c_custkey AS user_id, c_name AS username,
       concat(lower(replace(c_name, '#', '.')), '@example.com') AS email
FROM customer WHERE c_custkey % 10 <> 9""",
    "auth_users": """SELECT c_custkey AS user_id,
       CASE WHEN c_custkey % 4 = 0 THEN concat('u', CAST(c_custkey AS VARCHAR)) END AS meta_username,
       CASE WHEN c_custkey % 7 = 0 THEN '@example.com'
            ELSE concat(lower(replace(c_name, '#', '.')), '@example.com') END AS email
FROM customer""",
    "llm_responses": """SELECT doc_id AS commit_id,
       CASE doc_id % 5
         WHEN 0 THEN concat('RISK_SCORE: 0.', lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0'), chr(10), 'REASONING: seen', chr(10), 'VULNERABILITIES:', chr(10), '- issue ', CAST(doc_id % 3 AS VARCHAR), chr(10), '- None')
         WHEN 1 THEN concat('RISK_SCORE: 1.7', chr(10), 'REASONING: high', chr(10), 'VULNERABILITIES:', chr(10), 'None')
         WHEN 2 THEN concat('RISK_SCORE: 0.85.', chr(10), 'REASONING: trailing dot')
         WHEN 3 THEN 'no structure'
         ELSE 'RISK_SCORE: [0.85]' END AS content
FROM documents WHERE doc_id % 3 <> 0""",
    "training_raw": f"""SELECT {SHA.format('code_content')} AS hash, code_content AS code, round(sev, 4) AS risk_score,
       CASE WHEN commit_id % 2 = 0 THEN 'openrouter_seed' ELSE 'live_commit' END AS source, commit_id AS ord
FROM commits""",
    "ledger_calls": f"""SELECT commit_id AS seq, {SHA.format('code_content')} AS commit_hash,
       CAST(floor(sev * 100) AS INTEGER) + CAST(commit_id % 7 AS INTEGER) AS risk_score,
       CASE WHEN sev < 0.75 THEN 'Accepted' ELSE 'Rollback Enforced' END AS status,
       concat('0x', lpad(CAST(user_id AS VARCHAR), 4, '0')) AS submitter
FROM commits""",
    "changes": """SELECT commit_id,
       CASE WHEN commit_id % 4 = 0 THEN 'insert' WHEN commit_id % 4 = 2 THEN 'delete' ELSE 'update' END AS op,
       CASE WHEN commit_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS actor_id,
       CASE WHEN commit_id % 5 = 0 THEN user_id + 2 ELSE user_id END AS new_user_id
FROM commits""",
    "detail_requests": """SELECT commit_id,
       CASE WHEN commit_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS requester_id
FROM commits""",
    "generated_replies": """SELECT doc_id AS gen_id,
       CASE WHEN doc_id % 4 = 0 THEN concat('```python', chr(10), text, chr(10), '```')
            WHEN doc_id % 4 = 1 THEN concat('```', chr(10), text)
            WHEN doc_id % 4 = 2 THEN text
            ELSE concat('```', chr(10), '  ', chr(10), '```') END AS content
FROM documents""",
    "deleted_users": "SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'BUILDING'",
    "commit_candidates": """SELECT c.commit_id, CASE WHEN c.commit_id % 17 = 0 THEN NULL ELSE c.user_id END AS user_id,
       l.commit_hash, CAST(l.risk_score AS DOUBLE) AS risk_score,
       CASE WHEN c.commit_id % 13 = 0 THEN 'Pending' ELSE l.status END AS status, c.code_content
FROM commits c JOIN ledger_calls l ON c.commit_id = l.seq""",
}

SECOND_BATCH = "commit_id % 2 <> 0"

# view dependencies (CTEs are emitted in this order)
_ORDER = ["snip", "commits", "users", "auth_users", "llm_responses", "training_raw",
          "ledger_calls", "changes", "detail_requests", "generated_replies", "deleted_users",
          "commit_candidates"]
_DEPS = {"commits": ["snip"], "training_raw": ["commits"], "ledger_calls": ["commits"],
         "changes": ["commits"], "detail_requests": ["commits"],
         "commit_candidates": ["commits", "ledger_calls"]}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        for d in _DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS (\n{VIEWS[n]}\n)" for n in _ORDER if n in need]
    ctes += [f"{k} AS (\n{v}\n)" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


# -- rule SQL ---------------------------------------------------------------

def m_sql(code: str, rule) -> str:
    return (f"list_transform(regexp_extract_all({code}, {q(RX + rule.pattern)}, {rule.group}), "
            f"lambda x: coalesce(x, ''))")


def hit_sql(code: str, pattern: str) -> str:
    return f"regexp_matches({code}, {q(RX + pattern)})"


def cat_matches_sql(code: str, ci: int) -> str:
    parts = [m_sql(code, r) for r in rules_a() if r.cat_ord == ci]
    return parts[0] if len(parts) == 1 else f"flatten([{', '.join(parts)}])"


def floor_sql(code: str) -> str:
    parts = []
    for ci, _, sev in categories_a():
        anyhit = " OR ".join(hit_sql(code, r.pattern) for r in rules_a() if r.cat_ord == ci)
        parts.append(f"CASE WHEN {anyhit} THEN {dbl(sev)} ELSE {dbl(0.0)} END")
    return f"greatest({', '.join(parts)})"


def lines_sql(code: str) -> str:
    """Ordered pattern lines joined by newline, or the no-finding line."""
    items = []
    for ci, cat, _ in categories_a():
        m = cat_matches_sql(code, ci)
        items.append(f"CASE WHEN len({m}) > 0 THEN '[Pattern Match] ' || {q(cat)} || ': ' || "
                     f"array_to_string(list_slice({m}, 1, 3), ', ') END")
    arr = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({arr}) > 0 THEN array_to_string({arr}, chr(10)) ELSE {q(K.NO_PATTERN_LINE)} END"


def categories_sql(code: str) -> str:
    items = [f"CASE WHEN len({cat_matches_sql(code, ci)}) > 0 THEN {q(cat)} END" for ci, cat, _ in categories_a()]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def summary_b_sql(code: str) -> tuple[str, str]:
    cnt = " + ".join(f"CAST({hit_sql(code, r.pattern)} AS BIGINT)" for r in rules_b())
    sev = "greatest(" + ", ".join(f"CASE WHEN {hit_sql(code, r.pattern)} THEN {dbl(r.severity)} ELSE {dbl(0.0)} END"
                                  for r in rules_b()) + ")"
    return f"({cnt})", sev


# Python splitlines breaks, normalised to \n for RE2 (no lookbehind there).
_BREAKS_RE2 = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_INLINE_WS_RE2 = r"[\t \x1F\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def features_sql(code: str) -> dict[str, str]:
    norm = f"regexp_replace({code}, {q(_BREAKS_RE2)}, chr(10), 'g')"
    nbreak = f"len(regexp_extract_all({norm}, '\\n'))"
    lines = (f"({nbreak} + CASE WHEN length({code}) = 0 THEN 0 "
             f"WHEN suffix({norm}, chr(10)) THEN 0 ELSE 1 END)")
    comments = f"len(regexp_extract_all({norm}, {q('(?m)^' + _INLINE_WS_RE2 + '*#')}))"
    imports = f"regexp_extract_all({code}, {q('(?m)^(?:import|from)\\s+(\\w+)')}, 1)"
    risky = f"len(list_filter({imports}, lambda x: x IN ({', '.join(q(m) for m in K.RISKY_IMPORTS)})))"
    longs = f"len(regexp_extract_all({code}, {q(K.LONG_STRING_PATTERN)}))"
    nets = f"len(regexp_extract_all({code}, {q('(?i)' + K.NET_CALL_PATTERN)}))"
    hits, sev = summary_b_sql(code)
    return {"max_severity": sev, "hit_count": hits, "line_count": lines,
            "char_count": f"length({code})", "comment_lines": comments,
            "risky_imports": risky, "long_strings": longs, "net_calls": nets}


def feature_cols_sql(raw: str = "") -> dict[str, str]:
    p = raw
    return {
        "f_max_severity": f"{p}max_severity",
        "f_hits": f"least({p}hit_count / 5.0, 1.0)",
        "f_lines": f"least({p}line_count / 500.0, 1.0)",
        "f_length": f"least({p}char_count / 10000.0, 1.0)",
        "f_comment_ratio": f"{p}comment_lines / greatest({p}line_count, 1)",
        "f_risky_imports": f"least({p}risky_imports / 3.0, 1.0)",
        "f_long_strings": f"least({p}long_strings / 3.0, 1.0)",
        "f_net_calls": f"least({p}net_calls / 5.0, 1.0)",
    }


def heuristic_sql(fmax: str, fhits: str) -> str:
    return f"round(least(greatest({fmax} * 0.7 + {fhits} * 0.3, 0.0), 1.0), 4)"


def is_blank_sql(code: str) -> str:
    return f"({code} IS NULL OR NOT regexp_matches({code}, {q(r'[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')}))"


def hash_sql(code: str) -> str:
    return SHA.format(code)


def status_sql(score: str) -> str:
    return f"CASE WHEN {score} < 0.75 THEN {q(K.STATUS_ACCEPTED)} ELSE {q(K.STATUS_ROLLBACK)} END"


def tx_sql(h: str, pct: str, status: str) -> str:
    return f"substr(sha256(concat({h}, CAST({pct} AS VARCHAR), {status})), 1, 16)"


def draw_sql(h: str) -> str:
    return f"CAST(('0x' || substr({h}, 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"


def normalize_sql(code: str) -> str:
    c = f"regexp_replace({code}, '\"[^\"]*\"', ' STRING_LITERAL ', 'g')"
    c = f"regexp_replace({c}, '''[^'']*''', ' STRING_LITERAL ', 'g')"
    c = f"regexp_replace({c}, '\\b\\d+\\b', ' NUMBER ', 'g')"
    c = f"regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    c = f"replace({c}, '_', ' ')"
    return f"lower({c})"


def strip_sql(x: str) -> str:
    ws = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return f"regexp_replace({x}, {q('^' + ws + '+|' + ws + '+$')}, '', 'g')"
