"""Toxicity by the nearest labelled examples.

Method: a text is a TF-IDF vector over the hashed words that tell labelled
examples apart.  Its nearest examples by exact cosine come from an
inverted index with block maxima: examples stand in blocks, every term knows its
largest weight in each block, the sum of these bounds the cosines of a block, and
blocks are opened from the largest bound down until no other can change the
nearest ones.  Their labels vote, weighted by distance; a monotone map that is
fitted on the examples themselves, each left out of its own vote, turns votes
into calibrated scores.  The neighbours are returned as evidence.

The examples are a bounded sample of the labelled documents, the ``sample_docs``
with the lowest hash of their id; that bound is a parameter, and their texts are
read whole.  Terms are those whose association with the label in the sample is
beyond chance among all terms seen, ``most_terms`` at the most.  Document
frequencies are counted over all documents that are scored, and every document
is scored over its whole text.  Documents become short vectors in one pass over
the text; only these are stored and read again.

Cases: null and empty texts, and texts without any of the terms, get the share of
label 1 among such examples; a document with several labels takes the larger share
(1 if equal); null labels teach nothing; without labels of both classes every score
is the share of 1 (0.5 without any); ties between neighbours are in id order;
repeated rows and null ids are answered row by row; an empty table gives no rows;
other columns are carried along, but for the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, require, without
from .ngrams import subwords

BITS = 30
SAMPLE_DOCS = 8000
MOST_TERMS = 4096
#: Least chi-square of a term with the label, and least number of examples that have it.
LEAST_CHI = 30.0
LEAST_DOCS = 4
NEIGHBOURS = 8
BLOCK = 64
_BETWEEN = re.compile(r"[\W_]+")


def terms_of(text: str) -> Iterator[np.ndarray]:
    """Hashes of the lower-cased words, block by block."""
    for found in subwords(_BETWEEN.sub(" ", text.lower()), (), BITS):
        yield found[found < (1 << BITS)]


def chi_square(a: np.ndarray, b: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Of having a term (in ``a`` of ``ones`` and ``b`` of ``zeros`` examples) with the label."""
    n, have = ones + zeros, (a + b).astype(float)
    odds = (a * (zeros - b) - b * (ones - a)).astype(float)
    return n * odds**2 / np.maximum(have * (n - have) * ones * zeros, 1)


# --------------------------------------------------------------------- index


@dataclass
class Index:
    """Examples in blocks, postings by (term, block), block maxima."""

    ids: list
    labels: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    most: np.ndarray

    @property
    def blocks(self) -> int:
        return -(-len(self.labels) // BLOCK)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, cosines) of the ``k`` nearest examples with a cosine above 0,
        nearest first, ties (to 12 digits) by place; and the number of blocks that were opened."""
        bound = weights @ self.most[terms]
        place, cosine, opened = np.zeros(0, np.int64), np.zeros(0), 0
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or (len(cosine) == k and bound[block] < cosine[-1] - 2e-12):
                break
            if len(cosine) == k and bound[block] <= cosine[-1] + 1e-13 and block * BLOCK > place[-1]:
                continue  # at best it ties with what stands in front of it
            opened += 1
            at = terms * self.blocks + block
            first, many = self.start[at], self.start[at + 1] - self.start[at]
            rows = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            own = np.bincount(self.example[rows] - block * BLOCK, np.repeat(weights, many) * self.weight[rows], BLOCK)
            own = np.round(own, 12)
            inside = np.flatnonzero(own > 0)
            place, cosine = np.append(place, inside + block * BLOCK), np.append(cosine, own[inside])
            best = np.lexsort((place, -cosine))[:k]
            place, cosine = place[best], cosine[best]
        return place, cosine, opened


def weighted(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[terms]
    size = np.sqrt((w * w).sum())
    return w / size if size > 0 else w


def build(ids: list, labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> Index:
    """Examples with like terms share blocks: they are ordered by their heaviest term."""
    rows = [weighted(t, c, idf) for t, c in vectors]
    order = sorted(range(len(ids)), key=lambda r: (int(vectors[r][0][rows[r].argmax()]) if len(rows[r]) else -1, ids[r]))
    example = np.repeat(np.arange(len(order)), [len(rows[r]) for r in order])
    term = np.concatenate([vectors[r][0] for r in order] + [np.zeros(0, np.int64)]).astype(np.int64)
    weight = np.concatenate([rows[r] for r in order] + [np.zeros(0)])
    blocks = max(1, -(-len(order) // BLOCK))
    key = term * blocks + example // BLOCK
    by = np.argsort(key, kind="stable")
    most = np.zeros(len(idf) * blocks)
    np.maximum.at(most, key, weight)
    return Index([ids[r] for r in order], np.array([labels[r] for r in order]), example[by], weight[by],
                 np.searchsorted(key[by], np.arange(len(idf) * blocks + 1)), most.reshape(len(idf), blocks))


# --------------------------------------------------------------------- votes


@dataclass
class ToxicityModel:
    terms: np.ndarray
    idf: np.ndarray
    index: Index | None
    prior: float
    without_terms: float
    votes: np.ndarray
    shares: np.ndarray
    neighbours: int

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        """Share of label 1 by weights that fall with distance, 1 - cosine; the prior has a small vote."""
        w = cosine / (1.05 - np.minimum(cosine, 1))
        return float((w @ self.index.labels[place] + 0.2 * self.prior) / (w.sum() + 0.2))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if self.index is None or not len(terms):
            return (self.without_terms if self.index is not None else self.prior), np.zeros(0, np.int64), np.zeros(0)
        place, cosine, _ = self.index.nearest(terms, weighted(terms, counts, self.idf), self.neighbours)
        if not len(place):
            return self.without_terms, place, cosine
        return float(np.interp(self.vote(place, cosine), self.votes, self.shares)), place, cosine


def monotone(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean votes and shares of label 1 of the pools of a monotone regression; a
    pool counts with one more case at the prior."""
    pools: list[list[float]] = []
    for v, y in sorted(zip(votes.tolist(), labels.tolist())):
        pools.append([v, y, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if not pools:
        return np.array([0.0, 1.0]), np.array([prior, prior])
    share = np.maximum.accumulate([(y + prior) / (n + 1) for _, y, n in pools])
    return np.array([v / n for v, _, n in pools]), share


def calibrate(terms: np.ndarray, idf: np.ndarray, ids: list, labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]],
              neighbours: int = NEIGHBOURS) -> ToxicityModel:
    """The model over given examples; every example's vote leaves it out."""
    y = np.array(labels, float)
    prior = float(y.mean()) if len(y) else 0.5
    if prior in (0.0, 1.0) or not len(y):
        return ToxicityModel(terms, idf, None, prior, prior, np.array([0.0]), np.array([prior]), neighbours)
    model = ToxicityModel(terms, idf, build(ids, labels, vectors, idf), prior, prior, np.array([0.0, 1.0]), np.array([0.0, 1.0]), neighbours)
    spot = {i: k for k, i in enumerate(model.index.ids)}
    votes, told, bare = [], [], []
    for i, label, (t, c) in zip(ids, labels, vectors):
        place, cosine, _ = model.index.nearest(t, weighted(t, c, idf), neighbours + 1) if len(t) else (np.zeros(0, np.int64), np.zeros(0), 0)
        other = place != spot[i]
        place, cosine = place[other][:neighbours], cosine[other][:neighbours]
        if len(place):
            votes.append(model.vote(place, cosine))
            told.append(label)
        else:
            bare.append(label)
    model.without_terms = (sum(bare) + prior) / (len(bare) + 1)
    model.votes, model.shares = monotone(np.array(votes), np.array(told), prior)
    return model


# --------------------------------------------------------------------- Spark


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, label, text) of the bounded sample of ``docs`` that ``labels`` tells of."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null")
    told = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("id is not null and label is not null") \
        .groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    # ids first: the texts of the chosen few are all that moves
    chosen = told.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_docs)
    few = F.broadcast(materialize(chosen, "chosen"))
    return materialize(texts.join(few, "id").groupBy("id", "label").agg(F.min("text").alias("text")), "examples")


def telling_terms(examples: DataFrame, most_terms: int = MOST_TERMS) -> np.ndarray:
    """Hashes of the terms that go with the label beyond chance."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [[], []]
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(terms_of(text or ""))
                if found:
                    seen[label].append(np.unique(np.concatenate(found)))
            every = np.concatenate([*seen[0], *seen[1], np.zeros(0, np.int64)])
            term, place = np.unique(every, return_inverse=True)
            is_one = np.arange(len(every)) >= sum(map(len, seen[0]))
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64())] + [pa.array(np.bincount(place[m], minlength=len(term)), pa.int64()) for m in (is_one, ~is_one)],
                                             names=["term", "a", "b"])

    zeros, ones = (examples.where(F.col("label") == y).count() for y in (0, 1))
    if not zeros or not ones:
        return np.zeros(0, np.int64)
    sums = examples.select("label", "text").mapInArrow(counted, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")) \
        .where(F.col("a") + F.col("b") >= LEAST_DOCS)
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(zeros + ones)
    chi = F.lit(n) * F.pow(a * (F.lit(float(zeros)) - b) - b * (F.lit(float(ones)) - a), F.lit(2.0)) \
        / F.greatest((a + b) * (F.lit(n) - a - b) * F.lit(float(zeros)) * F.lit(float(ones)), F.lit(1.0))
    best = sums.withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "term").limit(most_terms).select("term").collect()
    return np.sort(np.array([r.term for r in best], np.int64))


class Lookup:
    """Counts of chosen terms in a text; a bitmap of their upper bits stands in front of the search."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.may = np.zeros(1 << 16, bool)
        self.may[terms >> (BITS - 16)] = True

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if not text or not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.zeros(len(self.terms), np.int64)
        for found in terms_of(text):
            found = found[self.may[found >> (BITS - 16)]]
            at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
            total += np.bincount(at[self.terms[at] == found], minlength=len(total))
        there = np.flatnonzero(total)
        return there, total[there]


def term_vectors(docs: DataFrame, terms: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the chosen terms in it (terms, counts)."""
    require(docs, text_col)
    docs = without(docs, "terms", "counts")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(terms))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.counts(t) for t in batch.column(at).to_pylist()]
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]],
                                             names=[*[n for k, n in enumerate(batch.schema.names) if k != at], "terms", "counts"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for k, f in enumerate(docs.schema) if k != at)
    return docs.mapInArrow(looked_up, f"{fields}terms array<int>, counts array<int>")


def document_counts(vectors: DataFrame, n_terms: int) -> DataFrame:
    """(term, n): of how many rows every term is one; a task sends one row per term at the most."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there], pa.int64())], names=["term", "n"])

    return vectors.select("terms").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def train(examples: DataFrame, terms: np.ndarray, vectors: DataFrame, neighbours: int = NEIGHBOURS) -> ToxicityModel:
    """Weights by document frequency over ``vectors`` (all documents), and the index of the examples."""
    n = vectors.count()
    seen = {r.term: r.n for r in document_counts(vectors, len(terms)).collect()}
    idf = np.array([1 + np.log((1 + n) / (1 + seen.get(k, 0))) for k in range(len(terms))])
    own = sorted(term_vectors(examples, terms).collect(), key=lambda r: r.id)
    return calibrate(terms, idf, [r.id for r in own], [r.label for r in own], [(np.array(r.terms, np.int64), np.array(r.counts, np.int64)) for r in own], neighbours)


def score(vectors: DataFrame, model: ToxicityModel, id_type: str = "bigint") -> DataFrame:
    """``vectors`` with score and evidence (id, cosine and label of the neighbours) in place of its terms."""
    kept = without(vectors, "terms", "counts", "score", "evidence")
    docs = vectors.select(*[F.col(f"`{c}`") for c in kept.columns], "terms", "counts")
    shared, width = docs.sparkSession.sparkContext.broadcast(model), len(kept.columns)
    kind = pa.list_(pa.struct([("id", pa.int64() if id_type == "bigint" else pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores, evidence = [], []
            for t, c in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()):
                value, place, cosine = known.score(np.array(t, np.int64), np.array(c, np.int64))
                scores.append(value)
                evidence.append([{"id": known.index.ids[p], "cosine": x, "label": int(known.index.labels[p])} for p, x in zip(place.tolist(), cosine.tolist())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores, pa.float64()), pa.array(evidence, kind)],
                                             names=[*batch.schema.names[:width], "score", "evidence"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return docs.mapInArrow(scored, f"{fields}score double, evidence array<struct<id:{id_type},cosine:double,label:int>>")


def fit_and_score(docs: DataFrame, learn: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                  sample_docs: int = SAMPLE_DOCS, most_terms: int = MOST_TERMS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` without the text, with score and evidence; learns from the rows of ``labels`` for documents in ``learn``."""
    examples = sample(learn, labels, id_col, text_col, label_col, sample_docs)
    terms = telling_terms(examples, most_terms)
    vectors = materialize(term_vectors(docs, terms, text_col), "vectors")
    kind = "bigint" if dict(examples.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint") else "string"
    return score(vectors, train(examples.withColumn("id", F.col("id").cast(kind)), terms, vectors, neighbours), kind)
