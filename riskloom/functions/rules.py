"""Column builders for the rule catalogs.

All rules are literal patterns, so Spark compiles each once per task and
the whole scan stays one native projection (no Python in the row path).
Flags ``(?imdU)`` reproduce case-insensitive, multi-line, ``.`` stopping only
at ``\\n`` and Unicode ``\\s \\w \\b``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import PREFILTER, Rule, categories_a, rules_a, rules_b

FLAGS = "(?imdU)"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def folded(code: Column) -> Column:
    """Lower-cased text for literal prefilters.  The three characters whose
    case-insensitive match reaches an ASCII letter but whose ``lower`` does
    not are mapped first, so containment is a necessary condition of a match."""
    return F.lower(F.translate(code, "\u0130\u0131\u017f", "iis"))


def prefilter(lc: Column, pattern: str) -> Column | None:
    hint = PREFILTER.get(pattern)
    if not hint:
        return None
    conds = [reduce(lambda a, b: a | b, [lc.contains(lit) for lit in anyof]) for anyof in hint]
    return reduce(lambda a, b: a & b, conds)


def matches(code: Column, lc: Column | None, rule: Rule) -> Column:
    """``re.findall`` equivalent: group 1 when the pattern has a group."""
    found = F.regexp_extract_all(code, F.lit(FLAGS + rule.pattern), F.lit(rule.group))
    cond = prefilter(lc, rule.pattern) if lc is not None else None
    return found if cond is None else F.when(cond, found).otherwise(empty_strings())


def hit(code: Column, lc: Column | None, pattern: str) -> Column:
    """``re.search`` equivalent (boolean)."""
    found = code.rlike(FLAGS + pattern)
    cond = prefilter(lc, pattern) if lc is not None else None
    return found if cond is None else F.when(cond, found).otherwise(F.lit(False))


def match_column_name(rule: Rule) -> str:
    return f"_m{rule.catalog}_{rule.cat_ord}_{rule.pat_ord}"


def with_match_arrays(df, code_col: str = "code_content", prefiltered: bool = True, keep_folded: bool = False):
    """Adds one match array per catalog-A pattern (``_mA_c_p``)."""
    code = F.col(code_col)
    out = df
    lc = None
    if prefiltered:
        out = out.withColumn("_lc", folded(code))
        lc = F.col("_lc")
    out = out.select("*", *[matches(code, lc, r).alias(match_column_name(r)) for r in rules_a()])
    return out.drop("_lc") if prefiltered and not keep_folded else out


def category_matches(cat_ord: int) -> Column:
    """All matches of one category, pattern order then text order."""
    cols = [F.col(match_column_name(r)) for r in rules_a() if r.cat_ord == cat_ord]
    return cols[0] if len(cols) == 1 else F.flatten(F.array(*cols))


def evidence_array() -> Column:
    """Ordered ARRAY<STRUCT<category, severity, matches>> of hit categories,
    at most three matches each (catalog order is kept; a map would lose it).

    Each category's match array is referenced once (as an element of one
    array, then bound to a lambda variable), so even where the optimizer
    inlines the match columns into a generator they are computed once."""
    cats = categories_a()
    arrays = F.array(*[category_matches(ci) for ci, _, _ in cats])
    names = F.array(*[F.lit(c) for _, c, _ in cats])
    sevs = F.array(*[F.lit(float(s)) for _, _, s in cats])
    items = F.transform(arrays, lambda m, i: F.when(F.size(m) > 0, F.struct(
        F.element_at(names, i + 1).alias("category"), F.element_at(sevs, i + 1).alias("severity"),
        F.slice(m, 1, 3).alias("matches"))))
    return F.filter(items, lambda x: x.isNotNull())


def floor_from_arrays() -> Column:
    """max severity over hit categories, 0.0 when none (from match arrays)."""
    parts = [F.when(F.size(category_matches(ci)) > 0, F.lit(sev)) for ci, _, sev in categories_a()]
    return F.coalesce(F.greatest(*parts), F.lit(0.0))


def pattern_floor(code: Column, prefiltered: bool = True) -> Column:
    """Floor score directly via ``rlike`` (stops at the first match)."""
    lc = folded(code) if prefiltered else None
    parts = []
    for ci, cat, sev in categories_a():
        anyhit = reduce(lambda a, b: a | b,
                        [hit(code, lc, r.pattern) for r in rules_a() if r.cat_ord == ci])
        parts.append(F.when(anyhit, F.lit(sev)))
    return F.coalesce(F.greatest(*parts), F.lit(0.0))


def vulnerability_lines(evidence: Column) -> Column:
    """``[Pattern Match] cat: m1, m2, m3`` per hit category, or the single
    no-finding line."""
    lines = F.transform(evidence, lambda e: F.concat(
        F.lit("[Pattern Match] "), e["category"], F.lit(": "), F.array_join(e["matches"], ", ")))
    return F.when(F.size(evidence) > 0, lines).otherwise(F.array(F.lit(_no_line())))


def _no_line() -> str:
    from .catalog import NO_PATTERN_LINE

    return NO_PATTERN_LINE


def catalog_b_hits(code: Column, lc: Column | None) -> list[tuple[Rule, Column]]:
    return [(r, hit(code, lc, r.pattern)) for r in rules_b()]


def rule_summary_b(code: Column, prefiltered: bool = True) -> tuple[Column, Column]:
    """(hit_count, max_severity) over catalog B; counts rules, not matches."""
    lc = folded(code) if prefiltered else None
    hits = catalog_b_hits(code, lc)
    count = reduce(lambda a, b: a + b, [h.cast("int") for _, h in hits])
    sev = F.coalesce(F.greatest(*[F.when(h, F.lit(r.severity)) for r, h in hits]), F.lit(0.0))
    return count, sev


def rule_summary_b_from_arrays(code: Column, lc: Column | None = None) -> tuple[Column, Column]:
    """Catalog-B summary reusing the catalog-A match arrays of
    :func:`with_match_arrays` for the patterns both catalogs share; only
    B-only patterns run a regex of their own."""
    shared = {r.pattern: F.size(F.col(match_column_name(r))) > 0 for r in rules_a()}
    hits = [(r, shared[r.pattern] if r.pattern in shared else hit(code, lc, r.pattern)) for r in rules_b()]
    count = reduce(lambda a, b: a + b, [h.cast("int") for _, h in hits])
    sev = F.coalesce(F.greatest(*[F.when(h, F.lit(r.severity)) for r, h in hits]), F.lit(0.0))
    return count, sev
