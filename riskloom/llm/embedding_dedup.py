"""Near-duplicate embeddings by cosine.

Method: collision counting over one-dimensional projections.  Vectors are
projected on many random lines; on each line the values are sorted, and every
vector's window around its own value holds the vectors it collides with.  A
pair at the wanted cosine collides on nearly every line, so the tally of
collisions has a least value that such a pair reaches with the wanted recall;
pairs that reach it are verified by their cosine in double precision.

Counting over the whole corpus grows with its square, as any single window
holds a fixed share of all vectors.  The signs of a few more projections
therefore deal the vectors to cells first, in several independent tables, and
windows are taken within a cell.  The number of signs follows the corpus, so
that cells keep their size; the number of tables follows from the recall that
is asked for at exactly the wanted cosine.  A pair counts in the first table
that puts it in one cell, so tallies of links add up without gathering pairs.
Cells above ``cell_rows`` are dealt in blocks, every pair of blocks to a task.

Copies are folded first.  A cell gives per vector a number of links and one
edge of a spanning forest, never its pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths do not link; rows
with a null id count as vectors, a component's id is the smallest id that is
not null (null if there is none); repeated rows are vectors of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, require, with_row_ids
from .runs import components, map_runs, roots

COSINE = 0.95
RECALL = 0.9995
LINES = 24
CELL_ROWS = 4096
#: Vectors that a cell is meant to hold.
CELL_MEAN = 128
SEED = 11


def calibration(cosine: float, lines: int = LINES, recall: float = RECALL) -> tuple[float, int]:
    """(half-width of a window, least tally) for a pair at exactly ``cosine``:
    on a random line its values differ by a normal deviate of its distance."""
    hit = 0.97
    low, high = 0.0, 10.0
    for _ in range(60):  # the deviate's quantile
        middle = (low + high) / 2
        low, high = (middle, high) if math.erf(middle / math.sqrt(2)) < hit else (low, middle)
    missed = 0.0
    for least in range(lines + 1):  # chance of a tally below ``least``
        missed += math.comb(lines, least) * hit**least * (1 - hit) ** (lines - least)
        if missed > (1 - recall) / 2:
            return low * math.sqrt(2 - 2 * cosine), least
    return low * math.sqrt(2 - 2 * cosine), lines


def cells(n: int, cosine: float, recall: float = RECALL, mean: int = CELL_MEAN) -> tuple[int, int]:
    """(signs in a key, tables) for n vectors."""
    signs = max(0, min(30, round(math.log2(max(1, n / mean)))))
    same = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** signs
    return signs, 1 if same >= 1 else math.ceil(math.log((1 - recall) / 2) / math.log(1 - same))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tally(values: np.ndarray, rows: slice, half: float) -> np.ndarray:
    """For each of ``rows`` and every vector, on how many lines the latter is in the former's window."""
    out = np.zeros((len(values[rows]), len(values)), np.int16)
    for line in values.T:
        order = np.argsort(line, kind="stable")
        ranked = line[order]
        rank = np.empty(len(line), np.int32)
        rank[order] = np.arange(len(line), dtype=np.int32)
        first = np.searchsorted(ranked, line[rows] - half, "left").astype(np.int32)
        last = np.searchsorted(ranked, line[rows] + half, "right").astype(np.int32)
        out += (rank >= first[:, None]) & (rank < last[:, None])
    return out


def linked_pairs(x: np.ndarray, lines: np.ndarray, keys: np.ndarray, table: int, block: np.ndarray | None, cosine: float, half: float,
                 least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one cell that link and share no cell of an earlier table."""
    n, values, found = len(x), x @ lines, ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    step = max(1, 2_000_000 // n)
    for at in range(0, n, step):
        a, b = np.nonzero(tally(values, slice(at, at + step), half) >= least)
        a, b = a[a + at < b] + at, b[a + at < b]
        if block is not None:
            a, b = a[block[a] != block[b]], b[block[a] != block[b]]
        for k in range(0, len(a), 20_000):
            i, j = a[k: k + 20_000], b[k: k + 20_000]
            new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
            i, j = i[new], j[new]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            found[0].append(i[near])
            found[1].append(j[near])
    return np.concatenate(found[0]), np.concatenate(found[1])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                    recall: float = RECALL, lines: int = LINES, cell_rows: int = CELL_ROWS, seed: int = SEED) -> DataFrame:
    """Per row: the id column, n_links, component_id and kept."""
    require(vectors, id_col, vector_col)
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    rows = with_row_ids(vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v")))
    sound = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0),
                       F.lit(False))
    # two hashes, of the vector and of its reverse, stand for its value
    rows = rows.withColumns({"sound": sound, "k1": F.xxhash64("v"), "k2": F.xxhash64(F.reverse("v"))})
    rows = materialize(rows, "vectors")
    classes = materialize(rows.where("sound").groupBy("k1", "k2").agg(
        F.min("rid").alias("cls"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "classes")
    signs, tables = cells(classes.count(), cosine, recall)
    half, least = calibration(cosine, lines, recall)
    dealt = _dealt(classes.select("cls", "copies", "v"), signs, tables, cell_rows, seed)

    def linked(whole: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        cls, copies = whole.column("cls").to_numpy(), whole.column("copies").to_numpy()
        table, block = whole.column("t").to_numpy(), whole.column("own").to_numpy()
        apart = (whole.column("i").to_numpy() != whole.column("j").to_numpy())
        data, keys = whole.column("x").to_pylist(), whole.column("keys").to_pylist()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e - s < 2:
                continue
            x = np.frombuffer(b"".join(data[s:e]), "<f8").reshape(e - s, -1)
            key = np.frombuffer(b"".join(keys[s:e]), "<i8").reshape(e - s, -1)
            a, b = linked_pairs(x, _lines(x.shape[1], lines, seed), key, int(table[s]), block[s:e] if apart[s] else None, cosine, half, least)
            if not len(a):
                continue
            own, weight = cls[s:e], copies[s:e]
            many = np.bincount(a, weight[b], e - s) + np.bincount(b, weight[a], e - s)
            root = roots(e - s, a, b)
            at = np.flatnonzero(many)
            out.append((own[at], own[root[at]], many[at].astype(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["cls", "root", "n"])

    found = materialize(map_runs(dealt, ["t", "key", "i", "j"], linked, "cls long, root long, n long", rows=8192), "links")
    per = found.groupBy("cls").agg(F.sum("n").alias("n"))
    grouped = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    named = classes.select("k1", "k2", "cls", "least", "copies").join(per, "cls", "left").join(grouped, "cls", "left") \
        .withColumn("root", F.coalesce("root", "cls"))
    named = materialize(named, "named")
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(heads, "root").select("k1", "k2", F.lit(True).alias("sound"),
                                              (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.drop("v", "rid").where("sound").join(labels, ["k1", "k2", "sound"]).select("id", "n_links", "component_id") \
        .union(rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _lines(dimensions: int, lines: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dimensions, 0)).normal(size=(dimensions, lines))


def _dealt(classes: DataFrame, signs: int, tables: int, cell_rows: int, seed: int) -> DataFrame:
    """A row per vector and table: t, key (the cell), x (unit vector), keys (all
    its cells), and (i, j), the pair of blocks that a task compares; own is the
    row's block.  Cells of at most ``cell_rows`` have one block."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == d))
                x = unit(some.column(2).flatten().to_numpy().reshape(-1, d))
                planes = np.random.default_rng((seed, d, 1)).normal(size=(d, tables * max(1, signs)))
                bits = (x @ planes >= 0).reshape(len(x), tables, -1)[:, :, :signs]
                keys = bits @ (1 << np.arange(signs, dtype=np.int64)) + (np.int64(d) << 32)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()),
                     pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array([r.tobytes() for r in keys.astype("<i8")], pa.binary())],
                    names=["cls", "copies", "x", "cells", "keys"])

    rows = materialize(classes.mapInArrow(keyed, "cls long, copies long, x binary, cells array<long>, keys binary"), "keyed")
    large = rows.select(F.posexplode("cells").alias("t", "key")).groupBy("t", "key").count().where(F.col("count") > cell_rows) \
        .select("t", "key", F.ceil(F.col("count") / cell_rows).cast("int").alias("blocks"))
    every = rows.select("cls", "copies", "x", "keys", F.posexplode("cells").alias("t", "key"))
    blocks = F.coalesce("blocks", F.lit(1))
    every = every.join(materialize(large, "large"), ["t", "key"], "left").withColumn("blocks", blocks) \
        .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "copies", "x", "keys")
