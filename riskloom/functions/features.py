"""Numeric code features, the heuristic score and code normalisation, all as
native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import IMPORT_PATTERN, LONG_STRING_PATTERN, NET_CALL_PATTERN, NORMALIZE_STEPS, RISKY_IMPORTS
from .rules import rule_summary_b

# Line breaks recognised by Python's ``str.splitlines``.
BREAK_CLASS = r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
BREAK = r"\r\n|" + BREAK_CLASS
# Whitespace that ``str.strip`` removes, minus the line breaks above.
INLINE_WS = r"[\t \x1F\xA0\u1680\u2000-\u200A\u202F\u205F\u3000]"
COMMENT_LINE = r"(?:\A|(?<=" + BREAK_CLASS + r"))" + INLINE_WS + r"*#"

FEATURE_NAMES = [
    "f_max_severity", "f_hits", "f_lines", "f_length",
    "f_comment_ratio", "f_risky_imports", "f_long_strings", "f_net_calls",
]


# The same break characters as one literal string (for ``translate``).
BREAK_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def line_count(code: Column) -> Column:
    """``len(code.splitlines())``: breaks (``\\r\\n`` counts once), plus one
    unless the text is empty or ends in a break.  Counted with
    ``translate``/``replace`` and a look at the last character, no regex."""
    n = F.length(code)
    break_chars = n - F.length(F.translate(code, BREAK_CHARS, ""))
    crlf = ((n - F.length(F.replace(code, F.lit("\r\n"), F.lit("")))) / 2).cast("int")
    last = F.substring(code, -1, 1)
    tail = F.when(n == 0, F.lit(0)).when(F.translate(last, BREAK_CHARS, "") == "", F.lit(0)).otherwise(F.lit(1))
    return break_chars - crlf + tail


def comment_line_count(code: Column) -> Column:
    """Lines whose first non-blank character is ``#`` (texts without any
    ``#`` skip the regex)."""
    return F.when(code.contains("#"), F.regexp_count(code, F.lit(COMMENT_LINE))).otherwise(F.lit(0))


def imports(code: Column) -> Column:
    """First module of each ``import``/``from`` line (column 0, case-sensitive;
    texts with neither word skip the regex)."""
    found = F.regexp_extract_all(code, F.lit("(?mdU)" + IMPORT_PATTERN), F.lit(1))
    return F.when(code.contains("import") | code.contains("from"), found) \
        .otherwise(F.array().cast("array<string>"))


def risky_import_count(code: Column) -> Column:
    risky = F.array(*[F.lit(m) for m in RISKY_IMPORTS])
    return F.size(F.filter(imports(code), lambda x: F.array_contains(risky, x)))


def long_string_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(LONG_STRING_PATTERN))


def net_call_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit("(?iU)" + NET_CALL_PATTERN))


def with_raw_counts(df: DataFrame, code_col: str = "code_content", have_b: bool = False) -> DataFrame:
    """Adds the raw counts behind the eight features (``have_b``: the
    catalog-B ``hit_count``/``max_severity`` columns already exist)."""
    code = F.col(code_col)
    b = []
    if not have_b:
        hits, sev = rule_summary_b(code)
        b = [sev.alias("max_severity"), hits.cast("long").alias("hit_count")]
    return df.select(
        "*", *b,
        line_count(code).cast("long").alias("line_count"),
        F.length(code).cast("long").alias("char_count"),
        comment_line_count(code).cast("long").alias("comment_lines"),
        risky_import_count(code).cast("long").alias("risky_imports"),
        long_string_count(code).cast("long").alias("long_strings"),
        net_call_count(code).cast("long").alias("net_calls"),
    )


def feature_columns() -> list[Column]:
    """The eight features from the raw counts of :func:`with_raw_counts`."""
    def capped(c: str, d: float) -> Column:
        return F.least(F.col(c) / F.lit(d), F.lit(1.0))

    return [
        F.col("max_severity").alias("f_max_severity"),
        capped("hit_count", 5.0).alias("f_hits"),
        capped("line_count", 500.0).alias("f_lines"),
        capped("char_count", 10000.0).alias("f_length"),
        (F.col("comment_lines") / F.greatest(F.col("line_count"), F.lit(1))).alias("f_comment_ratio"),
        capped("risky_imports", 3.0).alias("f_risky_imports"),
        capped("long_strings", 3.0).alias("f_long_strings"),
        capped("net_calls", 5.0).alias("f_net_calls"),
    ]


def with_features(df: DataFrame, code_col: str = "code_content", keep_raw: bool = False,
                  have_b: bool = False) -> DataFrame:
    raw = with_raw_counts(df, code_col, have_b)
    out = raw.select("*", *feature_columns())
    if not keep_raw:
        out = out.drop("max_severity", "hit_count", "line_count", "char_count",
                       "comment_lines", "risky_imports", "long_strings", "net_calls")
    return out


def heuristic_score(f_max_severity: Column, f_hits: Column) -> Column:
    """0.7 * max severity + 0.3 * capped hit ratio, clamped, 4 decimals."""
    s = f_max_severity * F.lit(0.7) + f_hits * F.lit(0.3)
    return F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), 4)


def normalize_code(code: Column) -> Column:
    """Token text for the n-gram model: literals and numbers replaced,
    camelCase split, underscores to spaces, lower case."""
    c = code
    for pattern, replacement in NORMALIZE_STEPS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(replacement))
    return F.lower(F.replace(c, F.lit("_"), F.lit(" ")))


# Word tokens of two or more letters/digits/underscores (one explicit class
# so that every engine reads it the same way).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(F.lower(normalized), F.lit(TOKEN_PATTERN), F.lit(0))


def code_tokens(code: Column) -> Column:
    """``tokens(normalize_code(code))``; what is lower case is not lowered again."""
    return F.regexp_extract_all(normalize_code(code), F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams(toks: Column, n_max: int = 3) -> Column:
    """All 1..n_max-grams of a token array, joined by single spaces, in
    position order per n.

    An n-gram list is the element-wise join of n shifted slices of equal
    length (``zip_with``): linear in the token count, where slicing the
    array once per position inside a lambda is quadratic."""
    parts = [toks]
    for n in range(2, n_max + 1):
        m = F.size(toks) - n + 1
        acc = F.slice(toks, 1, m)
        for j in range(2, n + 1):
            acc = F.zip_with(acc, F.slice(toks, j, m), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(F.when(m > 0, acc).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)
