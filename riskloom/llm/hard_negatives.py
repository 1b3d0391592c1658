"""Hard negatives by exact maximum inner product.

For an anchor, the rows of its own label with the largest inner products are its
positives, and for each positive the rows of other labels whose product lies in
a window below the positive's are its hard negatives.

Method: cover trees over norm-augmented candidates.  A further coordinate brings
every candidate to the largest norm, so that a larger inner product is a smaller
distance.  The top level is a set of separated pivots, taken from a bounded
sample; every candidate belongs to its nearest pivot's cell, whose covering
radius is measured over all its members.  A cell is dealt in groups of bounded
size, and a task builds a group's tree: a node's children are separated centres
that cover its members at half its radius, and every node keeps the radius that
covers its own members.  A radius and the product with the centre bound the
products of all members from both sides.  An anchor goes to the cells that its
windows can reach, and descends each tree best first: nodes outside all windows,
or below what was found already, are skipped, and leaves are verified by exact
integer products.  Results are exact; the sample decides only how much is skipped.

Copies (equal vectors and labels) are one candidate that keeps its smallest ids,
as many as any result can name, and one anchor whose answers its rows share.

Cases: rows with a null id, label or vector, or a null or non-finite component,
take no part; components are floor(scale * x) as long, saturated at its ends, and
so are scores; vectors of different lengths are never compared; empty vectors
have the product 0 with each other; ties are in id order; a repeated row is another
row, also of its own copy; an empty table, or one without anchors, gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, require, with_row_ids

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
#: Candidates of one group, queries that meet them in one task, rows of a leaf.
GROUP_ROWS = 2048
GROUP_QUERIES = 20_000
LEAF = 48
#: The sample for pivots and first bounds: rows, and numbers in all its vectors.
SAMPLE_ROWS = 4096
SAMPLE_NUMBERS = 4_000_000
MOST_PIVOTS = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


# ------------------------------------------------------------------ products


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, saturated at the ends of long."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0**53:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    if most < 2.0**62:
        return x @ q
    whole = x.astype(object) @ q.astype(object)
    return np.array([min(max(int(s), LEAST), MOST) for s in whole], np.int64)


def bounds(dot: np.ndarray, radius: np.ndarray, q2: float, top2: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) product of a query of squared norm ``q2`` with any point
    within ``radius`` of centres at the norm ``top2`` ** 0.5; ``dot`` has the
    products with the centres."""
    away = np.sqrt(np.maximum(q2 + top2 - 2 * dot, 0))
    reach = np.sqrt(q2) * radius
    most = np.minimum(dot + reach, (q2 + top2 - np.maximum(away - radius, 0) ** 2) / 2)
    least = np.maximum(dot - reach, (q2 + top2 - (away + radius) ** 2) / 2)
    slack = 0.5 + 1e-7 * (q2 + top2)
    return least - slack, most + slack


def augmented(x: np.ndarray, top2: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(top2 - (x * x).sum(axis=1), 0))])


def separated(x: np.ndarray, first: int, most: int, reach: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres farther than ``reach`` from each other that cover ``x`` within it,
    ``most`` at the most; the nearest one of each row and its distance."""
    centres, own = [first], np.zeros(len(x), np.int64)
    near = np.sqrt(((x - x[first]) ** 2).sum(axis=1))
    while len(centres) < most:
        far = int(near.argmax())
        if near[far] <= reach:
            break
        now = np.sqrt(((x - x[far]) ** 2).sum(axis=1))
        closer = now < near
        own[closer] = len(centres)
        near = np.where(closer, now, near)
        centres.append(far)
    return centres, own, near


# ---------------------------------------------------------------------- tree


class CoverTree:
    """The candidates of a group, in the order of their leaves.  Node k holds the
    rows first[k]:last[k] within radius[k] of row centre[k]; its children are the
    nodes down[k]:down_end[k] (none: a leaf)."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list[list[int]], top2: float, leaf: int = LEAF):
        points, n = augmented(vectors, top2), len(vectors)
        nodes: list[list] = [[0, n, 0, 0.0, 0, 0]]
        order = np.arange(n)
        k = 0
        while k < len(nodes):
            s, e, centre, _, _, _ = nodes[k]
            rows = order[s:e].copy()
            own = points[rows]
            at = int(np.flatnonzero(rows == centre)[0])
            near = np.sqrt(((own - own[at]) ** 2).sum(axis=1))
            nodes[k][3] = radius = float(near.max())
            # a level that hardly groups its rows is left out: the rows are one leaf
            if e - s > leaf and radius > 0 and (split := separated(own, at, (e - s) // 4 + 1, radius / 2))[2].max() <= radius / 2:
                by = np.argsort(split[1], kind="stable")
                order[s:e] = rows[by]
                ends = np.cumsum(np.bincount(split[1], minlength=len(split[0])))
                nodes[k][4:] = len(nodes), len(nodes) + len(ends)
                nodes += [[s + int(a), s + int(b), int(rows[c]), 0.0, 0, 0] for a, b, c in zip([0, *ends[:-1]], ends, split[0])]
            k += 1
        table = np.array(nodes, float)
        self.first, self.last, centre, self.down, self.down_end = (table[:, c].astype(int) for c in (0, 1, 2, 4, 5))
        self.radius, self.top2 = table[:, 3], top2
        self.centres = vectors[centre].astype(float)
        self.vectors, self.labels = vectors[order], labels[order]
        self.low_label = np.array([self.labels[s:e].min() for s, e in zip(self.first, self.last)])
        self.high_label = np.array([self.labels[s:e].max() for s, e in zip(self.first, self.last)])
        self.rows = order
        self.many = np.array([len(ids[r]) for r in order])
        self.start = np.cumsum(self.many) - self.many
        self.ids = np.array([i for r in order for i in ids[r]], np.int64)

    def search(self, q: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> list[tuple]:
        """For every window the first ``k`` (product, id, row) of rows of the
        same label, or of others, with a product from low to high and not below floor."""
        best = [(np.zeros(0, np.int64),) * 3 for _ in low]
        real_low, real_high, need = low.astype(float), high.astype(float), np.maximum(low, floor).astype(float)
        qf = q.astype(float)
        q2 = float(qf @ qf)
        heap = [(-np.inf, 0)]
        while heap:
            ub, node = heapq.heappop(heap)
            if -ub < need.min():
                break
            if self.down[node] == self.down_end[node]:
                self._verify(node, q, label, same, low, high, need, best, k)
                continue
            s, e = self.down[node], self.down_end[node]
            least, most = bounds(self.centres[s:e] @ qf, self.radius[s:e], q2, self.top2)
            if same:
                useful = (self.low_label[s:e] <= label) & (label <= self.high_label[s:e])
            else:
                useful = (self.low_label[s:e] != label) | (self.high_label[s:e] != label)
            useful &= ((most[:, None] >= need) & (least[:, None] <= real_high) & (most[:, None] >= real_low)).any(axis=1)
            for child in np.flatnonzero(useful).tolist():
                heapq.heappush(heap, (-most[child], s + child))
        return best

    def _verify(self, node: int, q: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray, need: np.ndarray, best: list, k: int) -> None:
        s, e = self.first[node], self.last[node]
        score = products(self.vectors[s:e], q)
        fits = (self.labels[s:e] == label) == same
        for w in range(len(low)):
            rows = np.flatnonzero(fits & (score >= low[w]) & (score <= high[w]) & (score >= need[w]))
            if not len(rows):
                continue
            many = self.many[s + rows]
            flat = np.repeat(self.start[s + rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found = [np.concatenate(pair) for pair in zip(best[w], (np.repeat(score[rows], many), self.ids[flat], np.repeat(self.rows[s + rows], many)))]
            if len(found[0]) >= k:
                first = np.lexsort((found[1], -found[0].astype(float), -found[0]))[:k] if np.abs(found[0].astype(float)).max() < 2.0**53 else \
                    np.array(sorted(range(len(found[0])), key=lambda r: (-int(found[0][r]), int(found[1][r])))[:k])
                found = [c[first] for c in found]
                need[w] = max(need[w], float(found[0][-1]) if abs(float(found[0][-1])) < 2.0**53 else np.nextafter(float(found[0][-1]), -np.inf))
            best[w] = tuple(found)


# ----------------------------------------------------------------- top level


@dataclass
class Top:
    """Sampled rows and the pivots among them by vector length (bounded by the
    sample's parameters), and what is known of every cell."""

    top2: float
    sample: dict[int, tuple[np.ndarray, np.ndarray]]
    pivots: dict[int, tuple[np.ndarray, int]]
    radius: np.ndarray | None = None
    labels: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance of vectors of one length; a length that was not sampled has the cell 0."""
        if x.shape[1] not in self.pivots:
            return np.zeros(len(x), np.int64), np.zeros(len(x))
        centres, start = self.pivots[x.shape[1]]
        points, pivots = augmented(x, self.top2), augmented(centres, self.top2)
        best, near = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        for k, p in enumerate(pivots):
            now = np.sqrt(((points - p) ** 2).sum(axis=1))
            best, near = np.where(now < near, start + k, best), np.minimum(now, near)
        return best, near

    def reached(self, q: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells that can hold results of a query, and for each window the product
        that its k-th result has at least."""
        floor = np.full(len(low), LEAST, np.int64)
        if len(q) not in self.pivots:
            return np.array([0]), floor
        rows, labels = self.sample[len(q)]
        score = products(rows, q)
        fits = (labels == label) == same
        for w in range(len(low)):
            inside = score[fits & (score >= low[w]) & (score <= high[w])]
            if len(inside) >= k:
                floor[w] = np.partition(inside, -k)[-k]
        centres, start = self.pivots[len(q)]
        qf, cells = q.astype(float), slice(start, start + len(centres))
        least, most = bounds(centres.astype(float) @ qf, self.radius[cells], float(qf @ qf), self.top2)
        first, last = self.labels[cells, 0], self.labels[cells, 1]
        useful = ((first <= label) & (label <= last)) if same else (first != label) | (last != label)
        inside = (most[:, None] >= np.maximum(low, floor)) & (least[:, None] <= high)
        return start + np.flatnonzero(useful & inside.any(axis=1) & (self.blocks[cells] > 0)), floor


def _vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for every length of vector in a column."""
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _top(classes: DataFrame, group_rows: int, sample_rows: int) -> Top | None:
    """Pivots and radii; the cells of all classes are counted."""
    square = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    n, top2, longest = classes.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("v"))).first()
    if not n:
        return None
    few = classes.orderBy(F.xxhash64("least", "label"), "cls").limit(max(64, min(sample_rows, SAMPLE_NUMBERS // max(1, longest)))).select("v", "label").collect()
    sample, pivots, start = {}, {}, 1
    for d in sorted({len(r.v) for r in few}):
        own = [r for r in few if len(r.v) == d]
        rows = np.array([r.v for r in own], np.int64).reshape(len(own), d)
        most = max(1, min(MOST_PIVOTS, round(n / group_rows)) * len(own) // len(few))
        centres, _, _ = separated(augmented(rows, top2), 0, most, 0.0)
        sample[d] = rows, np.array([r.label for r in own])
        pivots[d] = rows[centres], start
        start += len(centres)
    return Top(top2, sample, pivots)


# -------------------------------------------------------------------- operator


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
         group_rows: int = GROUP_ROWS, sample_rows: int = SAMPLE_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    for the rows of ``vectors`` where ``is_anchor``; a negative's score is from
    ``low`` to ``high`` percent of the positive's."""
    require(vectors, id_col, vector_col, label_col)
    spark, keep = vectors.sparkSession, max(positives + 1, negatives)
    x = vectors[vector_col].cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.where(vectors[id_col].isNotNull() & vectors[label_col].isNotNull() & sound).select(
        vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    # two hashes, of the vector and of its reverse, stand for its value
    rows = materialize(rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.reverse("v"))}), "rows")

    key = ["label", "k1", "k2"]
    rank = F.row_number()
    dealt = rows.select(*key, "id", F.pmod(F.xxhash64("id"), F.lit(32)).alias("salt"))
    for by in ([*key, "salt"], key):  # in two steps, so that a vector of many copies meets nowhere
        dealt = dealt.withColumn("n", rank.over(Window.partitionBy(*by).orderBy("id"))).where(F.col("n") <= keep)
    named = dealt.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    whole = rows.groupBy(*key).agg(F.first("v").alias("v"), F.min("id").alias("least"))
    classes = materialize(with_row_ids(whole.join(named, key), "cls"), "classes")
    anchors = rows.where("anchor").select(*key, F.col("id").alias("anchor_id")).join(classes.select(*key, "cls"), key).select("anchor_id", "cls")
    anchors = materialize(anchors, "anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    top = _top(classes, group_rows, sample_rows)
    if top is None:
        return spark.createDataFrame([], schema)

    candidates = _celled(classes, top)
    known = candidates.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.min("label").alias("first"), F.max("label").alias("last")).collect()
    cells = 1 + sum(len(c) for c, _ in top.pivots.values())
    top.radius, top.labels, top.blocks = np.zeros(cells), np.zeros((cells, 2), np.int64), np.zeros(cells, np.int64)
    for r in known:
        top.radius[r.cell], top.labels[r.cell], top.blocks[r.cell] = r.radius, (r.first, r.last), -(-r.n // group_rows)

    asked = classes.join(anchors.select("cls").distinct(), "cls").select("cls", "label", "v")
    every = asked.withColumns({"low": F.array(F.lit(LEAST).cast("long")), "high": F.array(F.lit(MOST).cast("long"))})
    found = _search(candidates, every, top, True, positives + 1, group_queries)
    near = found.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct(
        "n", "score", "id", (F.col("own") == F.col("cls")).alias("same")))).alias("near"))
    near = materialize(near, "positives")

    # low * score <= 100 * negative <= high * score in whole numbers; a window may be empty
    wide = "decimal(38,0)"
    def edge(share: int, up: bool) -> Column:
        part = (F.ceil if up else F.floor)
        return lambda p: F.least(F.greatest(part(p["score"].cast("decimal(24,0)") * F.lit(share).cast("decimal(9,0)") / F.lit(100).cast("decimal(9,0)")).cast(wide),
                                            F.lit(LEAST).cast(wide)), F.lit(MOST).cast(wide)).cast("long")

    windows = asked.join(near, "cls").select("cls", "label", "v", F.transform("near", edge(low, True)).alias("low"), F.transform("near", edge(high, False)).alias("high"))
    below = _search(candidates, windows, top, False, negatives, group_queries)
    lists = below.groupBy("cls", "w").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("negatives"))
    pairs = near.select("cls", F.posexplode("near").alias("w", "p")).join(lists, ["cls", "w"], "left")
    answers = materialize(pairs.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("w", "p", "negatives"))).alias("answers")), "answers")

    # an anchor is no positive of its own: one entry of its id and vector goes
    told = anchors.join(answers, "cls")
    itself = F.array_position(F.transform("answers", lambda a: a["p"]["same"] & (a["p"]["id"] == F.col("anchor_id"))), True)
    told = told.withColumn("itself", itself).withColumn("left", F.filter("answers", lambda a, i: i + 1 != F.col("itself")))
    one = told.select("anchor_id", F.explode(F.slice("left", 1, positives)).alias("a")).select("anchor_id", "a.p", F.explode("a.negatives").alias("negative"))
    return one.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("negative.n").alias("rank"), F.col("negative.id").alias("negative_id"),
                      F.col("p.score").alias("positive_score"), F.col("negative.score").alias("negative_score"))


def _celled(classes: DataFrame, top: Top) -> DataFrame:
    """classes with cell, away (distance from its pivot) and d (length)."""
    shared = classes.sparkSession.sparkContext.broadcast(top)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away, d = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for at, x in _vectors(batch.column(2)):
                (cell[at], away[at]), d[at] = shared.value.cells(x), x.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away), pa.array(d)],
                                             names=["cls", "label", "v", "ids", "cell", "away", "d"])

    return materialize(classes.select("cls", "label", "v", "ids").mapInArrow(
        celled, "cls long, label long, v array<bigint>, ids array<bigint>, cell long, away double, d int"), "celled")


def _search(candidates: DataFrame, queries: DataFrame, top: Top, same: bool, k: int, group_queries: int) -> DataFrame:
    """(cls, w, n, score, id, own): the first ``k`` results of every window w of
    every query (cls, label, v, low, high), n from 1; own is the result's class."""
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast(top)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            low, high, out, label = batch.column(3).to_pylist(), batch.column(4).to_pylist(), [], batch.column(1).to_pylist()
            for at, x in _vectors(batch.column(2)):
                for r, q in zip(at.tolist(), x):
                    a, b = np.array(low[r], np.int64), np.array(high[r], np.int64)
                    if (a > b).all():
                        continue
                    cells, floor = known.reached(q, label[r], same, a, b, k)
                    out += [(r, c, block, floor.tolist()) for c in cells.tolist() for block in range(max(1, int(known.blocks[c])))]
            for s in range(0, len(out), 1000):
                part = out[s: s + 1000]
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array([r for r, _, _, _ in part], pa.int64())) for c in batch.columns], pa.array([c for _, c, _, _ in part], pa.int64()),
                     pa.array([b for _, _, b, _ in part], pa.int64()), pa.array([f for _, _, _, f in part], pa.list_(pa.int64()))],
                    names=["cls", "label", "v", "low", "high", "cell", "block", "floor"])

    lists = "low array<bigint>, high array<bigint>"
    asked = materialize(queries.select("cls", "label", "v", "low", "high").mapInArrow(
        routed, f"cls long, label long, v array<bigint>, {lists}, cell long, block long, floor array<bigint>"), "routed")
    # as many tasks for a cell's groups as its queries need; one row per cell, bounded by the pivots
    shares = asked.where("block = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / group_queries).cast("int").alias("shares"))
    blocks = spark.createDataFrame([(c, max(1, int(b))) for c, b in enumerate(top.blocks.tolist())], "cell long, blocks long")
    cells = F.broadcast(materialize(blocks.join(shares, "cell"), "cells"))
    none = F.lit(None).cast("array<bigint>")
    here = candidates.join(cells, "cell").select("cell", "d", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
                                                 F.lit(0).alias("kind"), "cls", "label", "v", "ids", none.alias("low"), none.alias("high"), none.alias("floor"))
    there = asked.join(cells, "cell").select("cell", F.size("v").alias("d"), "block", F.pmod(F.xxhash64("cls"), F.col("shares")).cast("int").alias("share"),
                                             F.lit(1).alias("kind"), "cls", "label", "v", none.alias("ids"), "low", "high", "floor")
    top2 = top.top2

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(5)], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(starts[:-1], starts[1:]):
                part, group, kind = batch.slice(s, e - s), tuple(keys[s][:4].tolist()), int(keys[s][4])
                if group != key:
                    key, held, tree = group, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if not held and tree is None:
                    continue  # no candidate of this length here
                if tree is None:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    vectors = whole.column("v").combine_chunks()
                    d, held = int(keys[s][1]), []
                    vectors = vectors.flatten().to_numpy(zero_copy_only=False).reshape(whole.num_rows, d)
                    own = whole.column("cls").to_numpy()
                    tree = CoverTree(vectors, whole.column("label").to_numpy(), whole.column("ids").to_pylist(), top2)
                out: list[list[np.ndarray]] = []
                cls, label, low, high, floor = (part.column(c).to_pylist() for c in (5, 6, 9, 10, 11))
                asks = part.column(7).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1 if len(part.column(7).flatten()) else 0)
                for r in range(part.num_rows):
                    found = tree.search(asks[r], label[r], same, *(np.array(c[r], np.int64) for c in (low, high, floor)), k)
                    out += [[np.full(len(b[0]), cls[r]), np.full(len(b[0]), w), b[0], b[1], own[b[2]]] for w, b in enumerate(found) if len(b[0])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["cls", "w", "score", "id", "own"])

    group = ["cell", "d", "block", "share"]
    found = here.union(there).repartition(*group).sortWithinPartitions(*group, "kind").mapInArrow(searched, "cls long, w long, score long, id long, own long")
    first = Window.partitionBy("cls", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("cls", F.col("w").cast("int").alias("w"), "n", "score", "id", "own")
