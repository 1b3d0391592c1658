"""The language model and near-duplicate embeddings against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskloom.llm import embedding_dedup, language_model, queries

SF = "/root/testdata/sf0.001"


def brute_base(docs, learned):
    counts = Counter(t for i, text in docs if i in learned for t in language_model.tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t))
            for i, text in docs for t in [language_model.tokens_of(text)]}


def test_language_model_whole_table(spark):
    d = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    docs = [(i, t.encode()) for i, t in zip(d.doc_id, d.text)]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    want = brute_base(docs, {i for i, _ in docs} - held)
    got = queries.QUERIES["op3_lm_scoring"](spark, SF).toPandas()
    assert len(got) == len(docs) and (got.held_out == got.doc_id.isin(held)).all()
    for r in got.itertuples():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
    told = got[got.held_out]
    assert told.score.sum() > told.base_score.sum() and np.isfinite(got.score).all()


def test_language_model_is_a_distribution():
    """Over all words of a small vocabulary and one unseen word, each history's probabilities sum to one."""
    words = [b"w%d" % k for k in range(30)] + [b""]
    counts = np.array([100.0 - k for k in range(31)])
    forms = np.zeros(language_model.FORM_CLASSES)
    v = language_model.Vocabulary(words, counts, int(counts.sum()), 31, forms.copy(), forms.copy())
    w = language_model.first_weights(v)
    rng = np.random.default_rng(1)
    w.classes[: language_model.ROWS] = rng.normal(0, 0.3, (language_model.ROWS, language_model.CLASSES))
    w.words[: language_model.ROWS] = rng.normal(0, 0.3, (language_model.ROWS, language_model.CLASS_WORDS))
    ids = np.arange(31)
    one, two = np.full(31, 3), np.full(31, 5)
    head, _, _, class_log, class_p, word_log, word_p, _ = language_model._forward(w, ids, v.class_of[ids], one, two)
    assert len(head) == 31 and np.allclose(class_p.sum(axis=1), 1, atol=1e-5) and np.allclose(word_p.sum(axis=1), 1, atol=1e-5)
    own = class_p[0, 0]
    assert np.exp(class_log + word_log).sum() == pytest.approx(own, rel=1e-3)


def test_language_model_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b A b"), (3, "A b A b"), (None, "a\x0bB"), (4, "x " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(1)).withColumn("n", F.lit(2)).withColumn("form", F.lit(2))
    got = language_model.fit_and_score(d, d).toPandas()
    assert sorted(got.n_tokens) == [1, 1, 3, 5, 5, 20_001] and (got.n_known == got.n_tokens).all() and (got.score < 0).all()
    none = language_model.fit_and_score(d, d.limit(0)).toPandas()
    assert len(none) == 6 and (none.score == 0).all() and (none.base_score == 0).all() and (none.n_known == 0).all()
    assert language_model.fit_and_score(d.limit(0), d).count() == 0


def test_language_model_of_words_that_occur_once(spark):
    """More equally rare words than the dictionary holds: it is filled, and scores are those of a model."""
    d = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(70_000))), (2, "w1 w2 new")], "doc_id long, text string")
    v = language_model.vocabulary(language_model.count_words(d.where("doc_id = 1")))
    assert 64_000 < v.size <= language_model.DICTIONARY and v.tokens == 70_001
    got = {r.doc_id: r for r in language_model.fit_and_score(d, d.where("doc_id = 1")).collect()}
    assert got[1].n_known == 70_001 and got[2].n_known == 3 and got[2].n_tokens == 4
    # each word is about as likely as any other: the score stays near the base
    assert all(math.isfinite(r.score) and r.score < 0 and abs(r.score - r.base_score) < 0.2 * -r.base_score for r in got.values())


def test_mini_batches_know_their_history():
    v = language_model.Vocabulary([b"a", b"b", b""], np.array([3.0, 2.0, 1.0]), 6, 3, np.zeros(8), np.zeros(8))
    text = b"a b zz a"
    want = list(language_model._read(v, [text, None, text], 100))[0]
    assert want[0].tolist() == [0] * 5 + [1] + [2] * 5
    start = language_model._START
    assert want[3][:6].tolist() == [start, 0, 1, want[1][2], 0, start] and want[4][:6].tolist() == [start, start, 0, 1, want[1][2], start]
    parts = [np.concatenate(x) for x in list(zip(*language_model._read(v, [text * 9], 2)))[1:5]]
    whole = [x for x in list(language_model._read(v, [text * 9], 100))[0][1:5]]
    assert all((p == q).all() for p, q in zip(parts, whole))


def brute_links(vectors):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[n].min() if n.any() else i) for i, n in enumerate(near)])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def clustered(rng, groups, each, noise):
    base = rng.normal(size=(groups, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    return [(b + rng.normal(0, noise, 32)).tolist() for b in base for _ in range(each)]


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_embeddings_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(5)
    vectors = clustered(rng, 40, 6, 0.03) + clustered(rng, 1, 120, 0.02) + rng.normal(size=(300, 32)).tolist()
    vectors += [vectors[0]] * 5 + [[7 * c for c in vectors[3]]]
    d = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(d, cell_rows=cell_rows).toPandas().sort_values("vec_id")
    links, component = brute_links(vectors)
    found = got.n_links.sum() / links.sum()
    assert found > 0.999 and (got.n_links.values <= links).all()
    assert (got.component_id.values == component).mean() > 0.99 and (got.kept == (got.vec_id == got.component_id)).all()


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [0.0, 1.0]), (12, [0.0, 1e300]), (13, [-1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rid", F.lit(1)).withColumn("t", F.lit(1))
    got = {}
    for r in embedding_dedup.near_duplicates(d).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] and got[10] == [(3, 1, False)] * 2
    assert all(got[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7, 8, 9, 13))
    assert got[None] == [(1, 12, False)] and got[12] == [(1, 12, True)]
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_calibration():
    half, least = embedding_dedup.calibration(0.95)
    rng = np.random.default_rng(2)
    hits = (np.abs(rng.normal(0, math.sqrt(0.1), (20_000, embedding_dedup.LINES))) <= half).sum(axis=1)
    assert (hits >= least).mean() > 0.999
    far = (np.abs(rng.normal(0, math.sqrt(2), (20_000, embedding_dedup.LINES))) <= half).sum(axis=1)
    assert (far >= least).mean() < 0.01
