"""Hard negatives against every product of every anchor."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hard_negatives as hn


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    sound = [(i, y, [math.floor(scale * x) for x in v]) for i, v, y in rows
             if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, y, v) in enumerate(sound):
        if not is_anchor(i):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, z, w) in enumerate(sound) if b != a and len(w) == len(v)), key=lambda r: r[:2])
        for p, j, _ in [r for r in scored if r[2] == y][:positives]:
            inside = [(-s, m) for s, m, z in scored if z != y and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(i, j, n + 1, m, -p, s) for n, (s, m) in enumerate(inside)]
    return sorted(out)


def got(df, condition, **more):
    return sorted(tuple(r) for r in hn.mine(df, condition, **more).collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_brute_force(spark, spread):
    """Tight clusters, where whole nodes are skipped, and no clusters at all; norms differ, copies and ties are there."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(k, [float(np.float32(x)) for x in (centres[k % 6] + spread * rng.normal(size=8)) * (1 + k % 3)], k % 4) for k in range(900)]
    rows += [(2000 + k, rows[k % 2][1], k % 2) for k in range(120)] + [(5000 + k, rows[7][1], rows[7][2]) for k in range(40)]
    d = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, lambda i: i % 20 == 0)
    assert want and got(d, F.col("vec_id") % 20 == 0, group_rows=64, sample_rows=50, group_queries=7) == want


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v, 1), (0, v, 1), (100, v, 1), (1, v, None), (None, v, 1), (2, None, 1), (3, [0.5, None, 1.0], 1), (4, [float("nan"), 0.0, 0.0], 2),
            (5, [float("inf"), 0.0, 0.0], 2), (6, [0.5, 0.2, 0.3], 2), (7, [0.5, 0.2, 0.3], 2), (8, [0.0, 0.0, 0.0], 2), (9, [], 1), (200, [], 1), (10, [], 2),
            (300, [-1.0, 0.0, 0.0], 3), (11, [1.0, 0.0, 0.0], 3), (400, [0.0, 0.0, 0.0], 2), (12, [0.25, 0.5], 2), (500, [0.25, 0.5], 2), (13, [0.1, 0.2], 3)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "cls": F.lit(2), "id": F.lit("x"), "k1": F.lit(3)})
    want = brute(rows, lambda i: i % 100 == 0)
    assert want and got(d, F.col("vec_id") % 100 == 0) == want
    assert got(d.limit(0), F.col("vec_id") % 100 == 0) == [] and got(d, F.lit(False)) == [] and got(d, F.lit(None).cast("boolean")) == []


def test_products_beyond_double(spark):
    rows = [(k, [float(2e9 + 7 * k), float(-15e8 + k), 1.5], k % 2) for k in range(60)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(d, F.col("vec_id") % 10 == 0, scale=1, low=0, high=100) == brute(rows, lambda i: i % 10 == 0, scale=1, low=0, high=100)
    far = spark.createDataFrame([(k, [1e300 if k % 3 else -1e300], k % 2) for k in range(8)], "vec_id long, embedding array<double>, label int")
    assert all(r[4] == hn.MOST for r in got(far, F.lit(True), low=0, high=100))


def test_tree_skips_and_is_exact():
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.02, (200, 6)) for c in rng.normal(size=(10, 6))])).astype(np.int64)
    labels = rng.integers(0, 3, len(x))
    top2 = float((x.astype(float) ** 2).sum(axis=1).max())
    tree = hn.CoverTree(x, labels, [[k] for k in range(len(x))], top2)
    assert len(tree.first) > 10
    for node in range(len(tree.first)):  # what a radius covers
        inside = tree.vectors[tree.first[node]: tree.last[node]]
        away = np.sqrt(((hn.augmented(inside, top2) - hn.augmented(tree.centres[node][None], top2)) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[node] + 1e-6
    visited = []
    verify = tree._verify
    tree._verify = lambda node, *rest: (visited.append(tree.last[node] - tree.first[node]), verify(node, *rest))
    q = x[3]
    low, high = np.array([hn.LEAST]), np.array([hn.MOST])
    score, ids, _ = tree.search(q, 1, True, low, high, low, 10)[0]
    every = hn.products(x, q)
    want = sorted((-int(s), k) for k, s in enumerate(every) if labels[k] == 1)[:10]
    assert list(zip(-score, ids)) == want and sum(visited) < len(x) / 2
