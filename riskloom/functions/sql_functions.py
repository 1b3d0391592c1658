"""SQL surface: ``predict_risk_score(code) -> DOUBLE`` as a session-scoped
SQL function whose body is plain Spark SQL (``RLIKE`` per catalog-A rule),
so SQL users get the same native expression as the DataFrame API — no
Python in the row path.

With no trained model and no reviewer, a commit's risk score is its
catalog-A pattern floor rounded to four places.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .catalog import PREFILTER, categories_a, rules_a
from .rules import FLAGS


def sql_str(s: str) -> str:
    """A Spark SQL string literal (backslash escapes are processed)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_sql(code: str, pattern: str) -> str:
    """A rule's pattern behind the literals that any match must hold (the same
    prefilter as the DataFrame form)."""
    found = f"{code} RLIKE {sql_str(FLAGS + pattern)}"
    hint = PREFILTER.get(pattern)
    if not hint:
        return f"({found})"
    folded = f"lower(translate({code}, '\u0130\u0131\u017f', 'iis'))"
    held = " AND ".join("(" + " OR ".join(f"contains({folded}, {sql_str(x)})" for x in anyof) + ")" for anyof in hint)
    return f"(CASE WHEN {held} THEN {found} ELSE false END)"


def floor_sql(code: str) -> str:
    parts = []
    for ci, _, sev in categories_a():
        cond = " OR ".join(rule_sql(code, r.pattern) for r in rules_a() if r.cat_ord == ci)
        parts.append(f"CASE WHEN {cond} THEN CAST({sev!r} AS DOUBLE) END")
    return f"round(coalesce(greatest({', '.join(parts)}), CAST(0.0 AS DOUBLE)), 4)"


def register_sql_functions(spark: SparkSession) -> None:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION predict_risk_score(code STRING) RETURNS DOUBLE "
              f"RETURN {floor_sql('code')}")
