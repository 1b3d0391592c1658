"""Sorted runs: work on all rows of a key at once inside Arrow tasks, and
connected components over edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def map_runs(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str,
             rows: int = 20_000) -> DataFrame:
    """Hash-partition and sort ``df`` by ``keys`` and hand ``work`` tables of
    about ``rows`` rows that hold whole runs of equal keys, with the run
    starts (a last entry holds the number of rows).  A run is as large as its
    key's group: the caller bounds groups before."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            starts = run_starts(whole, keys)
            if len(starts) > 2:  # the last run may go on
                yield from work(whole.slice(0, starts[-2]), starts[:-1])
                whole = whole.slice(starts[-2])
            held, count = whole.to_batches(), whole.num_rows
        if count:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from work(whole, run_starts(whole, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(mapped, schema)


def run_starts(whole: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(whole.num_rows, bool)
    for k in keys:
        v = whole.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    new[:1] = True
    return np.append(np.flatnonzero(new), whole.num_rows)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the given edges."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_edges = label[left] != label[right]
        left, right = left[open_edges], right[open_edges]
    return label


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the
    smallest node that it reaches.

    Alternates the large-star and small-star steps until the edges are stars.
    Every step is a shuffle by node with map-side combining, neighbours are
    never gathered, and each round's edges are written under the checkpoint
    folder, so a lost executor repeats one round at most."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: every larger neighbour of a joins a's smallest
        now = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: a and its smaller neighbours join the smallest of them
        least = now.groupBy("a").agg(F.min("b").alias("low"))
        now = now.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")),
                                                            F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")) \
            .select("e.a", "e.b").where("a <> b").distinct()
        now = materialize(now, "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.groupBy("a").agg(F.min("b").alias("root"))
    return out.select(F.col("a").alias("node"), "root").union(out.select(F.col("root").alias("node"), "root").distinct())
