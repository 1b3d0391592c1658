"""The vocabulary by sketch against a count of all n-grams."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import text_model as tm
from riskloom.plans import q_model
from test_plans import exchanges


@pytest.mark.parametrize("k,width", [(50, 16), (400, 1 << 20), (10**6, 64)])
def test_same_terms_whatever_the_sketch(spark, sf_small, k, width):
    """Also where cells are so few that every one is heavy, or the first bound is too high."""
    ex = q_model.examples(spark, sf_small)
    n = ex.count()
    whole = tm.ngram_counts(ex, "hash", "code")
    want = {tuple(r) for r in tm.vocab_topk(tm.term_stats(whole, "hash"), n, k).collect()}
    vocab, counts = tm.vocabulary(ex, n, "hash", k=k, width=width)
    assert {tuple(r) for r in vocab.select("term", "tf", "df", "idx", "idf").collect()} == want
    terms = {t[0]: t[3] for t in want}
    assert {(r.hash, r.term, r.tf, r.idx) for r in counts.collect()} == {(r.hash, r.term, r.tf, terms[r.term]) for r in whole.collect() if r.term in terms}


def test_skewed_bound_needs_a_second_round(spark):
    """Rare terms that share cells look frequent: the first bound is above the k-th
    frequency, and a term below it must still be found."""
    rows = [(f"d{i}", " ".join(f"r{i}x{j}" for j in range(300))) for i in range(30)] + [(f"e{i}", "often") for i in range(5)] + [("f", "twice twice")]
    d = spark.createDataFrame(rows, "hash string, code string")
    want = tm.vocab_topk(tm.term_stats(tm.ngram_counts(d, "hash"), "hash"), 36, 2).collect()
    got = tm.vocabulary(d, 36, "hash", k=2, width=8)[0]
    assert sorted(tuple(r) for r in got.select("term", "tf", "df").collect()) == sorted((r.term, r.tf, r.df) for r in want)


def test_empty_and_null_texts(spark):
    d = spark.createDataFrame([("a", None), ("b", ""), ("c", "   ")], "hash string, code string")
    vocab, counts = tm.vocabulary(d, 3, "hash")
    assert vocab.count() == 0 and counts.count() == 0


def test_nothing_but_cells_moves_for_the_sketch(spark, sf_small):
    grams = tm._hashed_grams(q_model.examples(spark, sf_small).select("hash", "code"), "hash", "code", 1 << 20)
    last = exchanges(grams.groupBy("cell").agg(F.count("*").alias("n")))[0]
    assert last == ["cell", "count"]


def test_counts_stay_in_their_rows(spark):
    """Where ids are unique nothing is grouped; otherwise the rows of an id are added up."""
    rows = [("a", "one two one two one"), ("b", "one"), ("a", "one two"), ("c", ""), ("d", None), (None, "two two")]
    d = spark.createDataFrame(rows, "hash string, code string")
    by_row = tm.ngram_counts(d, "hash", unique=True)
    assert exchanges(by_row) == [] and "Aggregate" not in by_row._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.hash), r.term, r.tf) for r in by_row.where("term not like '% %'").collect()) \
        == [("None", "two", 2), ("a", "one", 1), ("a", "one", 3), ("a", "two", 1), ("a", "two", 2), ("b", "one", 1)]
    assert {(r.hash, r.term): r.tf for r in tm.ngram_counts(d, "hash").where("hash = 'a'").collect()} == {
        ("a", "one"): 4, ("a", "two"): 3, ("a", "one two"): 3, ("a", "two one"): 2, ("a", "one two one"): 2, ("a", "two one two"): 1}


def test_norm_is_summed_once_per_document(spark):
    """Not inside the lambda that scales the entries, where it is summed anew for each."""
    counts = spark.createDataFrame([("a", "x", 0, 1.0, 1), ("a", "y", 1, 1.0, 1), ("b", "y", 1, 2.0, 3)], "hash string, term string, idx int, idf double, tf long")
    sparse = tm.tfidf_sparse(counts, None, "hash")
    assert "/ sqrt(aggregate" not in sparse._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.hash: [(e.idx, e.weight) for e in r.entries] for r in sparse.collect()}
    assert got == {"a": [(0, pytest.approx(0.5**0.5)), (1, pytest.approx(0.5**0.5))], "b": [(1, pytest.approx(1.0))]}


def test_features_are_read_once(spark, sf_small):
    """Bounds and scaling read stored numbers; no rule runs over the texts again."""
    plan = q_model.q_scaled_features(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan


def test_scoring_counts_stay_in_their_rows(spark):
    """No row per n-gram and no exchange but that of the texts; rows of an id are added up, and
    texts that are read by one task are dealt out."""
    rows = [("b", "one two one"), ("a", "two two"), ("b", "one"), ("c", "none"), (None, "one"), ("d", None), ("e", "")]
    d = spark.createDataFrame(rows, "hash string, code string").coalesce(1)
    vocab = spark.createDataFrame([("one", 0, 1.5), ("one two", 1, 2.0), ("two", 2, 0.1)], "term string, idx int, idf double")
    counts = tm.vocab_counts(d, vocab, "hash")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and len(exchanges(counts)) == 1
    got = {r.hash: [tuple(e) for e in r.counts] for r in counts.collect()}
    assert got == {"a": [(2, 2.0, 0.1)], "b": [(0, 3.0, 1.5), (1, 1.0, 2.0), (2, 1.0, 0.1)], None: [(0, 1.0, 1.5)]}
    assert tm.vocab_counts(d, vocab.limit(0), "hash").count() == 0
