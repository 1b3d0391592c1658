"""Reviewer hand-off: request export, reply ingest, verdict merge and the
final local / full scores.  The external call itself is a table hand-off:
one job writes requests, another lands replies, this module joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as K
from ..functions.scalars import fmt2, strip_text


# -- reply parsing ----------------------------------------------------------

def parse_reviewer_reply(content: Column) -> Column:
    """STRUCT<score_text, score, reasoning, vulnerabilities, parse_ok>.

    * no ``RISK_SCORE:`` number -> 0.5; a number that is not a float (e.g.
      ``0.85.``) -> ``parse_ok`` false and NULL score (caller falls back);
    * reasoning up to ``VULNERABILITIES:`` or the end, stripped;
    * one vulnerability per line, dashes dropped, ``-``/``None``/``none``
      and items of two characters or fewer skipped.
    """
    txt = F.coalesce(content, F.lit(""))
    num = F.regexp_extract(txt, r"(?iU)RISK_SCORE:\s*([0-9.]+)", 1)
    val = num.try_cast("double")
    ok = (num == "") | val.isNotNull()
    score = F.when(num == "", F.lit(0.5)).otherwise(F.least(F.greatest(val, F.lit(0.0)), F.lit(1.0)))
    reason_raw = F.regexp_extract(txt, r"(?isdU)REASONING:\s*(.+?)(?=VULNERABILITIES:|$)", 1)
    reasoning = F.when(reason_raw == "", F.lit(K.DEFAULT_REASONING)).otherwise(strip_text(reason_raw))
    vuln_raw = F.regexp_extract(txt, r"(?isdU)VULNERABILITIES:\s*(.+?)$", 1)
    vuln_text = F.when(vuln_raw == "", F.lit("None")).otherwise(strip_text(vuln_raw))
    lines = F.split(vuln_text, "\n")
    kept = F.filter(lines, lambda v: (strip_text(v) != "")
                    & ~strip_text(v).isin("-", "None", "none") & (F.length(strip_text(v)) > 2))
    items = F.transform(kept, lambda v: strip_text(F.regexp_replace(strip_text(v), F.lit("^-+"), F.lit(""))))
    vulns = F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(K.NO_REVIEWER_VULNS)))
    return F.struct(
        num.alias("score_text"),
        F.when(ok, F.round(score, 4)).alias("score"),
        reasoning.alias("reasoning"),
        vulns.alias("vulnerabilities"),
        ok.alias("parse_ok"))


def llm_verdict_ingest(replies: DataFrame, content_col: str = "content") -> DataFrame:
    """Replies -> verdict columns; ``parse_ok`` false rows are the
    quarantine (their commits take the local path)."""
    return replies.withColumn("_v", parse_reviewer_reply(F.col(content_col))).select(
        *[c for c in replies.columns if c != content_col],
        F.col("_v.score").alias("llm_score"), F.col("_v.reasoning").alias("llm_reasoning"),
        F.col("_v.vulnerabilities").alias("llm_vulnerabilities"), F.col("_v.parse_ok").alias("parse_ok"))


def teacher_score(content: Column) -> Column:
    """First ``d.ddd`` or ``0``/``1`` in the stripped reply, clamped and
    rounded; NULL when there is none (labelling failed)."""
    m = F.regexp_extract(strip_text(F.coalesce(content, F.lit(""))), r"([0-9]\.[0-9]+|[01])", 1)
    v = F.least(F.greatest(m.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.when(m != "", F.round(v, 4))


def generated_code_clean(content: Column) -> Column:
    """Strip a leading and a trailing code fence, trim; empty -> NULL."""
    c = F.regexp_replace(content, F.lit(r"(?U)^```\w*\n?"), F.lit(""))
    c = F.regexp_replace(c, F.lit(r"(?d)\n?```$"), F.lit(""))
    return F.nullif(strip_text(c), F.lit(""))


# -- request export ---------------------------------------------------------

def reviewer_prompt(code: Column, categories: Column) -> Column:
    """Prompt text; ``categories`` is the ordered array of hit categories."""
    before, rest = K.REVIEWER_PROMPT.split("%s", 1)
    middle, after = rest.split("%s", 1)
    ctx_before, ctx_after = K.REVIEWER_CONTEXT.split("%s", 1)
    ctx = F.when(F.size(categories) > 0, F.concat(F.lit(ctx_before), F.array_join(categories, ", "),
                                                  F.lit(ctx_after))).otherwise(F.lit(""))
    return F.concat(F.lit(before), code, F.lit(middle), ctx, F.lit(after))


def request_body(prompt: Column) -> Column:
    """JSON body of one chat-completion request."""
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(K.REVIEWER_SYSTEM).alias("content")),
        F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.to_json(F.struct(F.lit(K.REVIEWER_MODEL).alias("model"), msgs.alias("messages"),
                              F.lit(K.REVIEWER_TEMPERATURE).alias("temperature"),
                              F.lit(K.REVIEWER_MAX_TOKENS).alias("max_tokens")))


def export_llm_requests(routed: DataFrame) -> DataFrame:
    """Requests for the rows routed to the reviewer (needs ``evidence``)."""
    cats = F.transform(F.col("evidence"), lambda e: e["category"])
    return (routed.where("llm_called")
            .select("commit_id", "commit_hash",
                    reviewer_prompt(F.col("code_content"), cats).alias("prompt"))
            .withColumn("body", request_body(F.col("prompt"))))


def seed_requests(seeds: DataFrame, tiers: DataFrame) -> DataFrame:
    """One generation prompt per seed description with its tier bounds."""
    a, rest = K.SEED_PROMPT.split("%s", 1)
    b, rest = rest.split("%s", 1)
    c, d = rest.split("%s", 1)
    j = seeds.join(tiers, "tier")
    return j.select("description", "tier", "lo", "hi", F.concat(
        F.lit(a), F.col("description"), F.lit(b), fmt2(F.col("lo")), F.lit(c),
        fmt2(F.col("hi")), F.lit(d)).alias("prompt"))


# -- scores -----------------------------------------------------------------

def _fill(template: str, *values: Column) -> Column:
    """Substitute ``%.2f`` slots of a fixed text with column values."""
    pieces = template.split("%.2f")
    out = [F.lit(pieces[0])]
    for v, p in zip(values, pieces[1:]):
        out += [v, F.lit(p)]
    return F.concat(*out)


def final_score_local(floor: Column, custom: Column, trained: bool) -> dict[str, Column]:
    """Local-only verdict: max(model, floor), reasoning text and mode."""
    cs = custom if trained else F.lit(0.0)
    if trained:
        reasoning = _fill(K.REASONING_LOCAL_TRAINED, fmt2(cs), fmt2(floor))
        mode = F.lit(K.MODE_LOCAL_TRAINED)
    else:
        reasoning = _fill(K.REASONING_LOCAL, fmt2(floor))
        mode = F.lit(K.MODE_LOCAL)
    return {"risk_score": F.round(F.greatest(cs, floor), 4), "reasoning": reasoning,
            "analysis_mode": mode, "custom_model_score": F.round(cs, 4)}


def merged_vulnerabilities(pattern_lines: Column, detected: Column, llm_vulns: Column) -> Column:
    """Pattern lines first, then reviewer items not among them (reviewer
    duplicates kept, order kept) — not ``array_except``, which dedups."""
    rest = F.filter(llm_vulns, lambda v: ~F.array_contains(pattern_lines, v))
    return F.when(detected, F.concat(pattern_lines, rest)).otherwise(llm_vulns)


def merge_verdicts(local: DataFrame, verdicts: DataFrame, trained: bool,
                   key: str = "commit_id") -> DataFrame:
    """Final verdict per row.  ``local`` carries ``pattern_floor``,
    ``evidence``, ``vulnerabilities``, ``custom_score`` and ``llm_called``;
    ``verdicts`` carries parsed replies.  Routed rows with a usable reply
    take max(reviewer, model, floor); all others the local path."""
    v = verdicts.select(key, "llm_score", "llm_reasoning", "llm_vulnerabilities")
    j = local.join(v, key, "left")
    loc = final_score_local(F.col("pattern_floor"), F.col("custom_score"), trained)
    cs = F.col("custom_score") if trained else F.lit(0.0)
    full = F.col("llm_called") & F.col("llm_score").isNotNull()
    detected = F.size(F.col("evidence")) > 0
    return j.select(
        *[c for c in local.columns if c != "vulnerabilities"],
        F.when(full, F.round(F.greatest(F.col("llm_score"), cs, F.col("pattern_floor")), 4))
         .otherwise(loc["risk_score"]).alias("risk_score"),
        F.when(full, F.col("llm_reasoning")).otherwise(loc["reasoning"]).alias("reasoning"),
        F.when(full, merged_vulnerabilities(F.col("vulnerabilities"), detected, F.col("llm_vulnerabilities")))
         .otherwise(F.col("vulnerabilities")).alias("vulnerabilities"),
        F.when(full, F.lit(K.MODE_FULL_TRAINED if trained else K.MODE_FULL))
         .otherwise(loc["analysis_mode"]).alias("analysis_mode"),
        F.round(cs, 4).alias("custom_model_score"),
        "llm_score",
    )
