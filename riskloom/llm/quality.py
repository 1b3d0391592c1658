"""Quality classifier.

Method: supervised subword embeddings.  A text is the average of learned
vectors of its hashed words, of its hashed character n-grams and of the word
pair "same word again", and a softmax over two outputs tells its class; vectors
and outputs are trained by stochastic gradient descent in numpy.

The fit takes a bounded sample of the labelled documents: those with the lowest
hash of their id, ``sample_docs`` at most, or as many as have ``sample_features``
different features in all.  Both bounds are parameters.  Whole texts are read,
by the tasks: the driver gets buckets and counts, no text.  Every document is
scored, over its whole text.  As
outputs are linear in the average, a bucket's vector counts only through the
difference of its two outputs, so the tasks get one number per bucket.

Cases: null and empty texts score as a text without features, by the bias
alone; a document with several labels takes the larger share (1 if equal);
null labels teach nothing; without labels of both classes the score is the
share of 1 (0.5 without any); repeated rows and null ids are answered row by
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, require, without
from .ngrams import subwords

ORDERS = (3, 4)
BITS = 16
DIMENSIONS = 16
EPOCHS = 8
RATE = 0.5
SAMPLE_DOCS = 4000
#: Different features of all sampled texts together; eight bytes each on the driver.
SAMPLE_FEATURES = 30_000_000
SEED = 7


@dataclass
class QualityModel:
    """``lean[b]``: what a bucket adds to the log-odds of class 1, over the number of features."""

    lean: np.ndarray
    bias: float
    orders: tuple[int, ...]
    bits: int


def features(text: str, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and how often each occurs."""
    counts = np.zeros((1 << bits) + 1, np.int64)
    for buckets in subwords(text, orders, bits):
        counts += np.bincount(buckets, minlength=len(counts))
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found].astype(np.int32)


def fit(texts: list[str], labels: list[int], orders: tuple[int, ...] = ORDERS, bits: int = BITS, **more) -> QualityModel:
    """Fit on texts at hand."""
    return descend([features(t, orders, bits) for t in texts], labels, orders, bits, **more)


def descend(seen: list[tuple[np.ndarray, np.ndarray]], labels: list[int], orders: tuple[int, ...] = ORDERS, bits: int = BITS,
            dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Gradient descent over the features of labelled texts."""
    y = np.array(labels, float)
    share = y.mean() if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        odds = {0.0: -30.0, 1.0: 30.0}.get(share, 0.0)
        return QualityModel(np.zeros((1 << bits) + 1), odds, orders, bits)
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 1 / dimensions, ((1 << bits) + 1, dimensions))
    outputs, bias = random.normal(0, 1 / dimensions, (2, dimensions)), np.log([1 - share, share])
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for k in random.permutation(len(y)):
            ids, counts = seen[k]
            now = rate * (1 - done / steps)
            done += 1
            weights = counts / counts.sum() if len(ids) else counts
            own = vectors[ids]
            hidden = weights @ own if len(ids) else np.zeros(dimensions)
            logits = outputs @ hidden + bias
            p = np.exp(logits - logits.max())
            wrong = p / p.sum()
            wrong[int(y[k])] -= 1
            back = wrong @ outputs
            outputs -= now * np.outer(wrong, hidden)
            bias -= 0.1 * now * wrong
            vectors[ids] = own - now * np.outer(weights * min(len(ids), 50), back)
    lean = vectors @ (outputs[1] - outputs[0])
    return QualityModel(lean, float(bias[1] - bias[0]), orders, bits)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_docs: int = SAMPLE_DOCS, sample_features: int = SAMPLE_FEATURES,
          orders: tuple[int, ...] = ORDERS, bits: int = BITS, **more) -> QualityModel:
    """Fit on the bounded sample of ``docs`` that ``labels`` (id, 0/1) tells of."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")) \
        .where(F.col("id").isNotNull() & F.col("text").isNotNull())
    told = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("id is not null and label is not null") \
        .groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    # ids first: the texts of the chosen few are all that moves
    chosen = told.join(texts.select("id").distinct(), "id").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_docs)
    rows = [(r.id, r.label) for r in chosen.collect()]
    spark = docs.sparkSession
    few = spark.createDataFrame(rows, chosen.schema)
    sample = texts.join(F.broadcast(few), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(2).to_pylist()):
                found, counts = features(text, orders, bits)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in (0, 1)), pa.array([len(found)], pa.int32()),
                                                  pa.array([found.tobytes()]), pa.array([counts.tobytes()])], names=["id", "label", "many", "found", "counts"])

    kind = sample.schema["id"].dataType.simpleString()
    stored = materialize(sample.mapInArrow(read, f"id {kind}, label int, many int, found binary, counts binary"), "features")
    sizes, total, last = {r.id: r.many for r in stored.select("id", "many").collect()}, 0, len(rows)
    for k, (key, _) in enumerate(rows):
        total += sizes[key]
        if total > sample_features:
            last = k
            break
    if last < len(rows):
        stored = stored.join(F.broadcast(spark.createDataFrame(rows[:last], chosen.schema).select("id")), "id", "left_semi")
    got = sorted(stored.select("id", "label", "found", "counts").collect(), key=lambda r: r.id)
    return descend([tuple(np.frombuffer(b, np.int32) for b in (r.found, r.counts)) for r in got], [r.label for r in got], orders, bits, **more)


def probability(model: QualityModel, text: str | None) -> float:
    total, n = 0.0, 0
    for buckets in subwords(text or "", model.orders, model.bits):
        total += float(model.lean[buckets].sum())
        n += len(buckets)
    return float(1 / (1 + np.exp(-np.clip(model.bias + (total / n if n else 0.0), -50, 50))))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1; a column that had this name is replaced."""
    require(docs, text_col)
    docs = without(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [probability(shared.value, t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scored, f"{fields}, `{name}` double")
