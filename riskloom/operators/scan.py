"""Rule scan: findings per commit as one generated projection.

The scan is a narrow (map-only) transformation, so it needs no shuffle and
parallelises with the input splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.catalog import categories_a, rules_a
from ..functions.scalars import commit_hash
from ..session import materialize

#: Bits of a filter of ids: 8 MB at most, in every task.
MOST_BITS = 1 << 26


def with_commit_hash(df: DataFrame, code_col: str = "code_content") -> DataFrame:
    return df.withColumn("commit_hash", commit_hash(F.col(code_col)))


def rule_hits(df: DataFrame, key_cols: list[str], code_col: str = "code_content") -> DataFrame:
    """Long findings table: one row per (key, catalog-A pattern) that hit,
    with all matches of that pattern in text order."""
    arrays = rules.with_match_arrays(df.select(*key_cols, code_col), code_col)
    items = F.array(*[F.struct(
        F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
        F.lit(r.cat_ord).alias("cat_ord"), F.lit(r.pat_ord).alias("pat_ord"),
        F.lit(r.pattern).alias("pattern"),
        F.col(rules.match_column_name(r)).alias("matches")) for r in rules_a()])
    return (arrays.select(*key_cols, F.inline(items))
            .where(F.size("matches") > 0))


def findings_by_category(df: DataFrame, key_cols: list[str], code_col: str = "code_content") -> DataFrame:
    """Per (key, category) that hit: severity and the matches in
    pattern-then-text order.  A category's matches stand side by side in a
    row, so this is a projection without a shuffle."""
    arrays = rules.with_match_arrays(df.select(*key_cols, code_col), code_col)
    items = F.array(*[F.struct(F.lit(name).alias("category"), F.lit(ci).alias("cat_ord"), F.lit(float(sev)).alias("severity"),
                               rules.category_matches(ci).alias("matches")) for ci, name, sev in categories_a()])
    return arrays.select(*key_cols, F.inline(items)).where(F.size("matches") > 0)


def with_findings(df: DataFrame, code_col: str = "code_content") -> DataFrame:
    """Adds ``pattern_floor``, ``evidence`` (ordered array of structs) and
    ``vulnerabilities`` (pattern lines) in one pass over the text."""
    arrays = rules.with_match_arrays(df, code_col)
    out = arrays.select("*", rules.floor_from_arrays().alias("pattern_floor"),
                        rules.evidence_array().alias("evidence"))
    out = out.drop(*[rules.match_column_name(r) for r in rules_a()])
    return out.withColumn("vulnerabilities", rules.vulnerability_lines(F.col("evidence")))


def with_findings_and_b(df: DataFrame, code_col: str = "code_content") -> DataFrame:
    """:func:`with_findings` plus the catalog-B summary (``hit_count``,
    ``max_severity``) derived from the same match arrays."""
    arrays = rules.with_match_arrays(df, code_col, keep_folded=True)
    hits, sev = rules.rule_summary_b_from_arrays(F.col(code_col), F.col("_lc"))
    out = arrays.select("*", rules.floor_from_arrays().alias("pattern_floor"),
                        rules.evidence_array().alias("evidence"),
                        hits.cast("long").alias("hit_count"), sev.alias("max_severity"))
    out = out.drop("_lc", *[rules.match_column_name(r) for r in rules_a()])
    return out.withColumn("vulnerabilities", rules.vulnerability_lines(F.col("evidence")))


def with_pattern_floor(df: DataFrame, code_col: str = "code_content") -> DataFrame:
    return df.withColumn("pattern_floor", rules.pattern_floor(F.col(code_col)))


def with_rule_summary_b(df: DataFrame, code_col: str = "code_content") -> DataFrame:
    hits, sev = rules.rule_summary_b(F.col(code_col))
    return df.select("*", hits.cast("long").alias("hit_count"), sev.alias("max_severity"))


def id_filter(ids: DataFrame, n: int, id_col: str, most_bits: int = MOST_BITS) -> Callable[[Column], Column]:
    """Whether an id may be one of ``ids``: never false for one that is.  A bitmap
    of hashed ids, 16 bits for each up to ``most_bits``; beyond, more others pass."""
    bits = 1 << 10
    while bits < min(16 * n, most_bits):
        bits *= 2

    def spot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    words = ids.select(spot(F.col(id_col)).alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b"))
    every = ids.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    bitmap = materialize(every.select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")), "bitmap") \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))

    def may_be(c: Column) -> Column:
        word = F.get(bitmap.scalar(), F.floor(spot(c) / 64).cast("int"))
        return F.call_function("shiftright", word, (spot(c) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return may_be


def once_per_hash(df: DataFrame, find: Callable[[DataFrame], DataFrame], id_col: str = "commit_id", code_col: str = "code_content",
                  most_bits: int = MOST_BITS) -> DataFrame:
    """``find(df)``, a table of findings by ``id_col``, with the work done once for
    all rows of equal code.

    Ids and hashes come first.  The smallest id of a hash stands for its rows, and
    a filter of these ids, of bounded size, goes into the scan; the text stays there.
    Findings are joined to the rows they stand for, which also drops those of ids
    that passed the filter for nothing.  Ids are not null and differ."""
    named = materialize(df.select(id_col, commit_hash(F.col(code_col)).alias("_hash")).where("_hash is not null"), "ids")
    first = materialize(named.groupBy("_hash").agg(F.min(id_col).alias("_first")), "first")
    n = first.count()
    found = find(df.where(id_filter(first, n, "_first", most_bits)(F.col(id_col)))).withColumnRenamed(id_col, "_first")
    members = named.join(first, "_hash").select(id_col, "_first")
    return members.join(found, "_first").select(id_col, *[c for c in found.columns if c != "_first"])
