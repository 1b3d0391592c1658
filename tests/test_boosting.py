"""Boosting on all rows: the library's trees where it looks at all rows as well, bounds from
every row, the same trees in one task and over many, and no example left out."""

import inspect

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from riskloom.functions import catalog as K
from riskloom.operators import boosting as B
from riskloom.operators import model as M

WIDTH = 30
WHOLE = dict(maxIter=4, maxDepth=4, stepSize=0.08, subsamplingRate=1.0, minInstancesPerNode=2, seed=42)


def est(**more):
    return GBTRegressor(featuresCol="features", labelCol="label", **{**WHOLE, **more})


def matrix(spark, n):
    """Sparse rows, some columns rare, one full, one never there; the label follows four of them."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        cols = [c for c in range(WIDTH - 2) if rng.random() < 0.5 / (1 + c)] + [WIDTH - 1]
        x = {c: float(rng.integers(1, 6) / 8 if c % 2 else rng.random()) for c in cols}
        rows.append((i, float(x.get(0, 0) + (0.5 if x.get(3, 0) > 0.3 else 0) + x.get(5, 0) * x[WIDTH - 1] + rng.normal() / 50), i % 3, Vectors.sparse(WIDTH, x)))
    return spark.createDataFrame(rows, ["id", "label", "fold", "features"]).repartition(4).cache()


@pytest.fixture(scope="module")
def rows(spark):
    return matrix(spark, 400)


def predictions(model, rows):
    return {r.id: r.prediction for r in model.transform(rows).select("id", "prediction").collect()}


@pytest.mark.parametrize("entries", [B.ALONE_ENTRIES, 0])
def test_trees_are_the_librarys(rows, monkeypatch, entries):
    """In one task, and with a job for every level."""
    monkeypatch.setattr(B, "ALONE_ENTRIES", entries)
    want, got = predictions(est().fit(rows), rows), predictions(B.fit(rows, WIDTH, 5, est()), rows)
    assert max(abs(want[i] - got[i]) for i in want) < 1e-9 and len(got) == 400


def test_folds_are_held_out(rows, monkeypatch):
    want = []
    for k in range(3):
        m = est(maxIter=2).fit(rows.where(F.col("fold") != k))
        want.append(m.transform(rows.where(F.col("fold") == k)).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0])
    assert B.fold_errors(rows, WIDTH, 5, 3, est(maxIter=2)) == pytest.approx(want)
    monkeypatch.setattr(B, "ALONE_ENTRIES", 0)
    assert B.fold_errors(rows, WIDTH, 5, 3, est(maxIter=2)) == pytest.approx(want)


def test_drawn_rows_do_not_depend_on_the_tasks(rows, monkeypatch):
    one = predictions(B.fit(rows, WIDTH, 1, est(subsamplingRate=0.85)), rows)
    monkeypatch.setattr(B, "ALONE_ENTRIES", 0)
    many = predictions(B.fit(rows, WIDTH, 7, est(subsamplingRate=0.85)), rows)
    assert one == pytest.approx(many) and one != predictions(B.fit(rows, WIDTH, 7, est()), rows)


def test_bounds_are_of_all_rows(spark):
    """A value that 3 of 40,000 rows have gets its bound; a sample of 10,000 would miss it now and then."""
    values = np.sort(np.concatenate((np.full(39_000, 1.0), np.full(3, 2.0))))
    assert B.bounds(values, 40_000, 32).tolist() == [0.5, 1.5]
    rng = np.random.default_rng(1)
    values = np.sort(rng.random(40_000))
    got = B.bounds(values, 40_000, 32)
    assert len(got) == 31 and np.abs(np.searchsorted(values, got) - np.arange(1, 32) * 1250).max() <= 1
    assert B.bounds(np.zeros(0), 10, 32).tolist() == [] and B.bounds(np.array([3.0, 3.0]), 2, 2).tolist() == []


def test_saved_as_the_library_saves(rows, spark, tmp_path):
    from pyspark.ml.regression import GBTRegressionModel

    m = B.fit(rows, WIDTH, 1, est())
    m.write().overwrite().save(str(tmp_path / "gbt"))
    assert predictions(GBTRegressionModel.load(str(tmp_path / "gbt")), rows) == predictions(m, rows)
    assert len(m.trees) == 4 and m.treeWeights == [1.0, 0.08, 0.08, 0.08] and m.numFeatures == WIDTH


def test_no_example_is_left_out(spark, monkeypatch):
    """However many there are: nothing bounds the examples of a fit."""
    monkeypatch.setattr(M, "bounded_examples", lambda *a, **kw: pytest.fail("a fit takes all examples"))
    for f in (M.prepare, M.train_model):
        assert "max_examples" not in inspect.signature(f).parameters
    ex = spark.createDataFrame([(f"h{i}", i, f"import os\nos.system(v{i % 7})" if i % 2 else f"x{i % 5} = {i}", 0.9 if i % 2 else 0.1) for i in range(60)],
                               "hash string, ord long, code string, risk_score double")
    model, status = M.train_model(ex, params=dict(K.GBT_PARAMS, maxIter=3))
    assert status["sample_count"] == 60 and len(model.gbt.trees) == 3
