"""Model properties: compiled scoring equals Spark ML's transform, the
minimum-sample rule, save/load round trip, folds and CV."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import model as M
from riskloom.operators import training as TR
from riskloom.session import scratch_path
from riskloom.sources import fixtures as fx

FAST = dict(M.GBT_PARAMS, maxIter=8)  # few trees keep the unit test short; the queries use GBT_PARAMS


@pytest.fixture(scope="module")
def examples(spark, sf_small):
    return TR.keep_first_example(fx.training_raw(spark, sf_small)).cache()


@pytest.fixture(scope="module")
def fitted(examples):
    m, st = M.train_model(examples, params=FAST)
    assert st["status"] == "trained"
    return m


def test_too_few_samples_skips(examples):
    m, st = M.train_model(examples.limit(5))
    assert m is None and st["status"] == "skipped" and st["sample_count"] == 5


def test_compiled_score_equals_transform(fitted, examples):
    X = M.design_matrix(examples, fitted.vocab, fitted.n_terms, fitted.ranges)
    ref = {r["hash"]: r["prediction"] for r in fitted.gbt.transform(X).select("hash", "prediction").collect()}
    got = M.model_score(fitted, examples, "code", "hash", chunk=3).collect()
    assert len(got) == len(ref)
    assert max(abs(r["raw_score"] - ref[r["hash"]]) for r in got) < 1e-9
    assert all(0.0 <= r["model_score"] <= 1.0 for r in got)


def test_score_is_at_least_floor_b(fitted, spark, sf_small):
    from riskloom.functions.features import with_features
    c = fx.commits(spark, sf_small)
    s = M.model_score(fitted, c).join(with_features(c).select("commit_id", "f_max_severity"), "commit_id")
    assert s.where(F.col("model_score") < F.round(F.least(F.col("f_max_severity"), F.lit(1.0)), 4)).count() == 0


def test_save_load_round_trip(fitted, spark, sf_small):
    path = scratch_path(spark, "model-test")
    assert M.load_model(spark, path) is None
    M.save_model(fitted, path)
    loaded = M.load_model(spark, path)
    c = fx.commits(spark, sf_small)
    a = {r["commit_id"]: r["model_score"] for r in M.model_score(fitted, c).collect()}
    b = {r["commit_id"]: r["model_score"] for r in M.model_score(loaded, c).collect()}
    assert a == b


def test_folds_are_contiguous_and_sized(examples):
    n = examples.count()
    k = TR.kfold_k(n)
    f = TR.kfold_assign(examples).select("ord", "fold").orderBy("ord").collect()
    folds = [r["fold"] for r in f]
    assert folds == sorted(folds) and set(folds) == set(range(k))
    sizes = [folds.count(i) for i in range(k)]
    assert sizes == [n // k + (1 if i < n % k else 0) for i in range(k)]


def test_cv_mae_is_finite(examples):
    k, mae = M.cv_mae(M.prepare(examples), TR.kfold_assign(examples), params=dict(FAST, maxIter=3))
    assert k == TR.kfold_k(examples.count()) and 0.0 <= mae < 1.0


def test_fit_takes_at_most_the_bound(examples):
    kept = M.bounded_examples(examples, 30)
    assert kept.count() == 30 and M.bounded_examples(examples, 10_000).count() == examples.count()


def test_statistics_and_mean_predictor(examples):
    from riskloom.session import materialize
    few = dict(FAST, maxIter=2)
    model, status = M.train_model(examples, params=few, order_col="ord")
    folds = materialize(TR.kfold_assign(examples).select("hash", "fold"), "folds")
    prepared = M.prepare(examples)
    # a fit draws rows by partition, so the error differs a little from run to run
    assert 0 <= status["mae"] == model.stats["mae"] < M.mean_mae(prepared, folds) and status["trained_at"]
    rows = folds.join(examples, "hash").select("fold", "risk_score").collect()
    per = []
    for f in {r.fold for r in rows}:
        rest = [r.risk_score for r in rows if r.fold != f]
        mean = sum(rest) / len(rest)
        own = [abs(r.risk_score - mean) for r in rows if r.fold == f]
        per.append(sum(own) / len(own))
    assert M.mean_mae(prepared, folds) == pytest.approx(sum(per) / len(per))


def test_fits_are_spread_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert M.fit_partitions(spark, 100) == 1
    assert M.fit_partitions(spark, 40_000) == max(2, min(cores, 10))
    assert M.fit_partitions(spark, 40_000, cores) == 2  # as many fits at a time as there are cores


def test_texts_are_read_once_for_a_fit(examples, monkeypatch):
    """Features and tokens are made in one pass, which ranges, vocabulary and matrix share."""
    seen = []
    for name in ("with_features", "code_tokens"):
        def counted(*args, _made=getattr(M, name), _name=name, **kw):
            seen.append(_name)
            return _made(*args, **kw)
        monkeypatch.setattr(M, name, counted)
    M.prepare(examples)
    assert sorted(seen) == ["code_tokens", "with_features"]


def test_a_text_table_stands_for_the_codes(fitted, spark):
    """Also where ids repeat or are null, and without reading a code again."""
    rows = [(1, "import os\nos.system(cmd)"), (1, "def add(a, b):\n    return a + b"), (2, "x = eval(inp)"), (2, "x = eval(inp)"),
            (3, None), (4, ""), (None, "exec(src)")]
    docs = spark.createDataFrame(rows, "commit_id long, code_content string")
    texts = M.text_table(docs, "code_content", "commit_id")
    by_code, by_table = M.model_score(fitted, docs), M.model_score(fitted, texts)
    key = lambda r: (r.commit_id is None, r.commit_id or 0, r.raw_score is None, r.raw_score or 0.0, r.model_score or 0.0)
    assert sorted(by_code.collect(), key=key) == sorted(by_table.collect(), key=key) and by_table.count() == len(rows)
    assert "code_content" not in by_table._jdf.queryExecution().optimizedPlan().toString()
    counts = M.tm.vocab_counts(texts, fitted.vocab, "commit_id")
    assert sorted(M.model_score(fitted, texts, counts=counts).collect(), key=key) == sorted(by_code.collect(), key=key)


def test_trees_are_read_in_one_call(fitted):
    """As the nodes themselves hold them; not node by node."""
    def nodes(n):
        if n.getClass().getSimpleName() == "LeafNode":
            return float(n.prediction())
        return int(n.split().featureIndex()), float(n.split().threshold()), nodes(n.leftChild()), nodes(n.rightChild())

    assert M._trees(fitted) == [nodes(t.rootNode()) for t in fitted.gbt._java_obj.trees()]
