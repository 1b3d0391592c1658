"""Language identification.

Method: multinomial naive Bayes over hashed character n-grams.  Every task
counts the buckets of its labelled texts per language and hands on one partial
count per language and bucket; Spark sums them.  The log-probability matrix
(languages x buckets, a size that does not grow with the corpus) is broadcast,
and batches of whole texts are scored by looking their grams up in it.

Cases: a text that is null or has no letter is ``und`` with score 0; rows
without a language teach nothing; without any labelled text everything is
``und``; of equal scores the first language in order of its name wins; empty
tables give no rows; repeated rows and null ids are answered row by row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, require, without
from .ngrams import blocks, char_grams

ORDERS = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
UNDETERMINED = "und"
#: The matrix is broadcast: this many languages make it 130 MB.
MOST_LANGUAGES = 500


@dataclass
class LanguageModel:
    """Languages in order of their names; ``logs[l, b]`` is the log-probability
    of bucket b, with a last bucket of weight 0 for what is no gram."""

    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray
    orders: tuple[int, ...]
    bits: int


def _counts(texts: list[str], orders: tuple[int, ...], bits: int) -> np.ndarray:
    out = np.zeros((1 << bits) + 1, np.int64)
    for points, starts, _ in blocks(texts, max(orders) - 1):
        for n in orders:
            out += np.bincount(char_grams(points, starts, n, bits), minlength=len(out))
    return out[:-1]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = ORDERS, bits: int = BITS,
          smoothing: float = SMOOTHING, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Learn from every row of ``docs`` whose text and language are not null.
    More than ``most_languages`` languages are an error, as the matrix is broadcast."""
    require(docs, text_col, lang_col)
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")) \
        .where("text is not null and lang is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        many: dict[str, int] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text.lower())
            for lang, texts in by.items():
                total[lang] = total.get(lang, 0) + _counts(texts, orders, bits)
                many[lang] = many.get(lang, 0) + len(texts)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()),
                 pa.array(np.append(counts[at], many[lang]), pa.int64())], names=["lang", "bucket", "n"])

    if docs.select(docs[lang_col]).where(docs[lang_col].isNotNull()).distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages: the broadcast matrix would not be bounded")
    # languages x buckets rows at most, however large the corpus
    found = rows.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts, documents = np.zeros((len(languages), 1 << bits)), np.ones(len(languages))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        counts[k, grams["bucket"].to_numpy()] = grams["n"].to_numpy()
        documents[k] = own.loc[own["bucket"] < 0, "n"].sum()
    counts += smoothing
    logs = np.hstack([np.log(counts / counts.sum(axis=1, keepdims=True)), np.zeros((len(languages), 1))])
    return LanguageModel(languages, np.log(documents / documents.sum()) if languages else documents, logs, orders, bits)


def predict(model: LanguageModel, texts: list[str | None], has_letter: list[bool]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior probability."""
    n = len(texts)
    if not model.languages:
        return [UNDETERMINED] * n, np.zeros(n)
    score = np.tile(model.prior, (n, 1))
    told = [(t or "").lower() if ok else "" for t, ok in zip(texts, has_letter)]
    for points, starts, owners in blocks(told, max(model.orders) - 1):
        for order in model.orders:
            buckets = char_grams(points, starts, order, model.bits)
            for lang in range(len(model.languages)):
                np.add.at(score[:, lang], owners, np.add.reduceat(model.logs[lang][buckets], starts))
    best = score.argmax(axis=1)
    sure = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
    return ([model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter)],
            np.where(has_letter, sure, 0.0))


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_name: str = "lang_pred",
             score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; columns that had
    these names are replaced."""
    require(docs, text_col)
    docs = without(docs, pred_name, score_name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn(fresh(docs, "letter"), _has_letter(F.col(f"`{text_col}`").cast("string")))
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict(shared.value, batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=[*batch.schema.names[:-1], pred_name, score_name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(scored, f"{fields}, `{pred_name}` string, `{score_name}` double")


def known_language_only(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language cannot be told, all columns as they were."""
    pred = fresh(docs, "lang_pred")
    found = identify(docs, train(docs, text_col, lang_col), text_col, pred, fresh(docs, "lang_score"))
    return found.where(F.col(pred) != UNDETERMINED).select(*[F.col(f"`{c}`") for c in docs.columns])
