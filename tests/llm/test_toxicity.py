"""Toxicity: nearest examples against every cosine, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskloom.llm import queries, toxicity


def examples(rng, n, terms):
    out = []
    for k in range(n):
        t = np.sort(rng.choice(terms, rng.integers(0, 9), replace=False))
        out.append((t, rng.integers(1, 6, len(t))))
    return out


def test_nearest_is_exact_and_opens_few_blocks():
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 6, 60)
    vectors = examples(rng, 900, 60)
    vectors += vectors[:40]  # ties
    index = toxicity.build(list(range(940)), [k % 2 for k in range(940)], vectors, idf)
    dense = np.zeros((940, 60))
    for at, i in enumerate(index.ids):
        t, c = vectors[i]
        dense[at, t] = toxicity.weighted(t, c, idf)
    opened = []
    for t, c in examples(rng, 150, 60):
        w = toxicity.weighted(t, c, idf)
        q = np.zeros(60)
        q[t] = w
        cosine = dense @ q
        want = [(p, x) for x, p in sorted((-x, p) for p, x in enumerate(cosine.tolist()) if x > 1e-12)[:5]]
        place, found, n = index.nearest(t, w, 5)
        assert len(place) == len(want) and found == pytest.approx([-x for _, x in want], abs=1e-9)
        # equal cosines may differ in the last bit; what is found is as near as what is wanted
        assert all(cosine[p] == pytest.approx(-x, abs=1e-9) for p, (_, x) in zip(place, want))
        opened.append(n)
    assert np.mean(opened) < index.blocks


def test_counts_equal_plain_words():
    text = "Idiot, idiot! a_b ÉTÉ été x1 " * 3 + "ß"
    words = Counter(w for w in toxicity._BETWEEN.sub(" ", text.lower()).split())
    one = {w: int(np.concatenate(list(toxicity.terms_of(w)))[0]) for w in words}
    terms = np.sort(np.array([one["idiot"], one["été"], one["x1"]]))
    at, counts = toxicity.Lookup(terms).counts(text)
    assert {int(terms[a]): int(c) for a, c in zip(at, counts)} == {one[w]: words[w] for w in ("idiot", "été", "x1")}
    assert sum(len(f) for f in toxicity.terms_of(text)) == sum(words.values())


def test_calibrated_shares_rise():
    votes, shares = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.4, 0.9, 0.95]), np.array([0, 1, 0, 0, 1, 1]), 0.3)
    assert (np.diff(votes) >= 0).all() and (np.diff(shares) >= 0).all() and 0 <= shares.min() and shares.max() <= 1


def test_query_against_brute_force(spark):
    """Every score and every neighbour of the whole table, from the definition."""
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_toxicity"](spark, sf).toPandas()
    d = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().dropna(subset=["toxic"]).groupby("doc_id").toxic.mean()
    words = {i: Counter(toxicity._BETWEEN.sub(" ", (t or "").lower()).split()) for i, t in zip(d.doc_id, d.text)}
    learned = sorted(i for i in labels.index if i in words and zlib.crc32(str(i).encode()) % 3 != 1)
    y = {i: int(labels[i] >= 0.5) for i in learned}
    ones, a, b = sum(y.values()), Counter(), Counter()
    for i in learned:
        (a if y[i] else b).update(set(words[i]))
    n = len(learned)
    chi = {w: n * (a[w] * (n - ones - b[w]) - b[w] * (ones - a[w])) ** 2 / max(1, (a[w] + b[w]) * (n - a[w] - b[w]) * ones * (n - ones)) for w in set(a) | set(b)}
    terms = sorted((w for w in chi if chi[w] >= 30 and a[w] + b[w] >= 4))
    assert terms
    idf = {w: 1 + math.log((1 + len(words)) / (1 + sum(w in c for c in words.values()))) for w in terms}

    def vector(c):
        v = np.array([(1 + math.log(c[w])) * idf[w] if c[w] else 0.0 for w in terms])
        return v / np.linalg.norm(v) if v.any() else v

    known = np.array([vector(words[i]) for i in learned])
    prior = ones / n
    bare = [y[i] for i, v in zip(learned, known) if not v.any()]
    seen_scores = {}
    for r in got.itertuples():
        v = vector(words[r.doc_id])
        cosine = known @ v
        if not v.any():
            assert r.score == pytest.approx((sum(bare) + prior) / (len(bare) + 1)) and len(r.evidence) == 0
            continue
        want = np.sort(cosine[cosine > 1e-12])[::-1][: toxicity.NEIGHBOURS]
        assert [e["cosine"] for e in r.evidence] == pytest.approx(want.tolist(), abs=1e-9)
        assert all(cosine[learned.index(e["id"])] == pytest.approx(e["cosine"], abs=1e-9) and y[e["id"]] == e["label"] for e in r.evidence)
        w = np.array([e["cosine"] / (1.05 - min(e["cosine"], 1)) for e in r.evidence])
        vote = (w @ np.array([e["label"] for e in r.evidence]) + 0.2 * prior) / (w.sum() + 0.2)
        seen_scores[round(float(vote), 9)] = r.score
    by_vote = [seen_scores[k] for k in sorted(seen_scores)]
    assert by_vote == sorted(by_vote) and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op12_toxicity"](spark, sf).drop("evidence").toPandas()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().dropna(subset=["toxic"])
    told = got[got.held_out].merge(labels, on="doc_id")
    assert told[told.toxic == 1].predicted.mean() > 0.75 and told[told.toxic == 0].predicted.mean() < 0.02
    assert ((told.score - told.toxic) ** 2).mean() < 0.03


def test_odd_rows(spark):
    bad = "you utter idiot and clown "
    rows = [(k, bad + f"w{k}", 1) for k in range(20)] + [(100 + k, f"a fine day w{k} w{k + 1}", 0) for k in range(60)]
    odd = [(200, None, None), (201, "", 1), (None, bad, 1), (203, bad, None), (203, bad, None), (204, "x " * 300_000 + bad, None), (205, "?!", 0)]
    d = spark.createDataFrame([r[:2] for r in rows + odd], "doc_id long, text string") \
        .withColumns({"score": F.lit("s"), "terms": F.lit(1), "label": F.lit(9), "id": F.lit(8), "evidence": F.lit(0)})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows + odd] + [(0, 1), (999, 1)], "doc_id long, toxic int")
    got = toxicity.fit_and_score(d, d, labels).collect()
    assert len(got) == len(rows + odd) and all(r.label == 9 and r.id == 8 and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert min(by[None], by[203], by[204], by[0]) > 0.7 > 0.2 > by[100]
    # of the two examples without terms one has the label 1
    assert by[200] == by[201] == by[205] == pytest.approx((1 + 21 / 82) / 3)
    assert all(0 <= e.cosine <= 1 + 1e-9 for r in got for e in r.evidence)
    for told, share in ((labels.limit(0), 0.5), (labels.where("toxic = 0"), 0.0)):
        assert {r.score for r in toxicity.fit_and_score(d, d, told).collect()} == {share}
    assert toxicity.fit_and_score(d.limit(0), d, labels).count() == 0 and toxicity.fit_and_score(d, d.limit(0), labels).first().score == 0.5
    names = spark.createDataFrame([(f"n{k}", t) for k, (_, t, _) in enumerate(rows)], "doc_id string, text string")
    told = spark.createDataFrame([(f"n{k}", y) for k, (_, _, y) in enumerate(rows)], "doc_id string, toxic int")
    assert toxicity.fit_and_score(names, names, told).where("score > 0.7").count() == 20


def test_document_counts_without_a_row_per_term(spark):
    d = spark.createDataFrame([([0, 2],), ([2],), ([],), ([0, 1, 2],)], "terms array<int>")
    n = toxicity.document_counts(d, 4)
    assert "Generate" not in n._jdf.queryExecution().executedPlan().toString()
    assert {r.term: r.n for r in n.collect()} == {0: 2, 1: 1, 2: 3}
    assert toxicity.document_counts(d.limit(0), 0).count() == 0
