"""Work done once per distinct text: what is scanned, what moves, what comes out."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskloom.operators import scan
from test_plans import exchanges


def corpus(spark, copies):
    texts = ["import os\nos.system(x)\n", "eval(a)\nexec(b)", "nothing here", "", None]
    return spark.createDataFrame([(10 * c + k, t) for c in range(copies) for k, t in enumerate(texts)], "commit_id long, code_content string")


@pytest.mark.parametrize("most_bits", [scan.MOST_BITS, 1 << 10])
def test_copies_are_scanned_once(spark, most_bits):
    d, seen = corpus(spark, 400), []

    def find(rows):
        seen.append(rows)
        return scan.rule_hits(rows, ["commit_id"])

    got = scan.once_per_hash(d, find, most_bits=most_bits).select("commit_id", "category", "pat_ord", F.array_join("matches", "|").alias("m"))
    want = scan.rule_hits(d, ["commit_id"]).select("commit_id", "category", "pat_ord", F.array_join("matches", "|").alias("m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert seen[0].count() <= 4 + 2000 * 16 * 4 // 1024  # the four texts, and the few ids that share a bit with them


def test_a_full_filter_still_gives_the_whole_result(spark):
    """More distinct texts than bits: all rows are scanned, and nothing is lost or doubled."""
    d = spark.range(3000).select(F.col("id").alias("commit_id"), F.concat(F.lit("eval(a) "), (F.col("id") % 2500).cast("string")).alias("code_content"))
    got = scan.once_per_hash(d, lambda r: scan.rule_hits(r, ["commit_id"]), most_bits=1 << 10)
    assert got.count() == scan.rule_hits(d, ["commit_id"]).count() and got.select("commit_id").distinct().count() == 3000


def test_text_never_moves(spark, sf_small):
    found = exchanges(E.queries()["rule_hits_once"](spark, sf_small))
    assert found and not any({"code_content", "text"} & set(cols) for cols in found)
