"""Boosted regression trees over a sparse matrix, fitted on all of its rows.

The trees are those of Spark ML's ``GBTRegressor``: its squared error, bins, gains and
rules for leaves, and the result is its model.  Two things differ: the bounds of the
bins come from all rows, where the library looks at a sample of some 10,000, and what
is in the bin of zero is not added up column by column, but is the rest of a node.

The matrix is dealt out by columns, once; two bytes an entry stay cached.  A level of a
tree is one job over them, for all fits that are made together (the folds of a cross-validation): each task adds up
the bins of its columns and hands back the best split of every node, with the rows that it parts
from the others, a bit a row at most.  Sums of bins stay in the tasks.  Labels, predictions and
nodes, some 20 bytes a row, are the driver's.  Of a matrix with fewer entries each fit is one
task from its first to its last tree, as the jobs would take longer than their work.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose numbers stay in a core's cache while the entries of a block are added up.
BLOCK_BITS = 14
#: Columns of a chunk have no more bins, and but for a single one no more entries, together.
CHUNK_CELLS, CHUNK_ENTRIES = 1 << 13, 1 << 20
#: Entries of a matrix that one task fits by itself, in some 40 bytes each.
ALONE_ENTRIES = 12_000_000
#: Rows of the matrix that make a block; chunks that are handed to a task at a time.
BATCH, CHUNKS = 256, 2
#: Shards of the columns that one task of a level holds at most, where cores are few.
SHARDS_TOGETHER = 8
#: Gains and means that differ by no more than this (relatively) are the same but for rounding.
SAME_GAIN, SAME_MEAN = 1e-9, 1e-12
#: A node of less variance is a leaf (the library's bound).
EPSILON = 2.220446049250313e-16

_BLOCK = "shard int, part int, seq int, n int, label binary, fold binary, col binary, row binary, val binary"
_CHUNK = "number int, fold int, bins int, cols binary, cuts binary, zero binary, local binary, seg_start binary, seg_cell binary, block_at binary"
_KINDS = {"cols": np.int32, "cuts": np.float64, "zero": np.int32, "local": np.uint16, "seg_start": np.int32, "seg_cell": np.uint16, "block_at": np.int32}


# -- columns ------------------------------------------------------------------

def deal(shards: int):
    """Batches of (label, fold, indices, values) as blocks of entries, one for every shard of columns."""
    def run(batches):
        part = TaskContext.get().partitionId()
        for seq, b in enumerate(x for x in batches if x.num_rows):
            lens = b.column("indices").value_lengths().to_numpy(zero_copy_only=False)
            col = b.column("indices").flatten().to_numpy(zero_copy_only=False)
            val = b.column("values").flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows, dtype=np.int32), lens)
            there = np.flatnonzero(val)
            col, val, row = col[there], val[there], row[there]
            to = (col % shards).astype(np.uint16)
            order = np.argsort(to, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=shards))))
            own = [order[ends[s]:ends[s + 1]] for s in range(shards)]
            if np.isnan(label := b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)).any():
                raise ValueError("labels must not be null or NaN")
            fold = b.column("fold").to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(range(shards), pa.int32()), *[pa.array([x] * shards, pa.int32()) for x in (part, seq, b.num_rows)],
                *[pa.array([x] * shards, pa.binary()) for x in (label.tobytes(), fold)],
                pa.array([(col[o] // shards).astype(np.int32).tobytes() for o in own], pa.binary()),
                pa.array([row[o].tobytes() for o in own], pa.binary()),
                pa.array([val[o].tobytes() for o in own], pa.binary())],
                names=["shard", "part", "seq", "n", "label", "fold", "col", "row", "val"])
    return run


def _columns(batches, width: int):
    """(label, fold, ends of the columns, row and value of their entries by value)."""
    blocks = sorted(((r["part"], r["seq"], r) for b in batches for r in b.to_pylist()), key=lambda x: x[:2])
    blocks = [r for _, _, r in blocks]
    sizes = [r["n"] for r in blocks]
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def joined(name, kind, add=None):
        parts = [np.frombuffer(r.pop(name), kind) for r in blocks]
        return np.concatenate(parts if add is None else [(p + a).astype(kind) for p, a in zip(parts, add, strict=True)])

    label, fold = joined("label", np.float64), joined("fold", np.int32)
    col, row, val = joined("col", np.int32), joined("row", np.int32, starts[:-1]), joined("val", np.float64)
    ends = np.concatenate(([0], np.cumsum(np.bincount(col, minlength=width)))).astype(np.int64)
    order = np.argsort(col.astype(np.uint16) if width < 1 << 16 else col, kind="stable")
    row, val = row[order], val[order]
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        by = np.argsort(val[a:z], kind="stable")
        row[a:z], val[a:z] = row[a:z][by], val[a:z][by]
    return label, fold, ends, row, val


def bounds(values: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Where the library cuts a column of ``rows`` rows whose values other than zero are
    ``values`` (sorted), if it looks at all of them: between any two values, or where
    their cumulated count is nearest to a multiple of the mean count of a bin."""
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    distinct, counts = values[at], np.diff(np.concatenate((at, [len(values)])))
    if rows > len(values):
        z = np.searchsorted(distinct, 0.0)
        distinct, counts = np.insert(distinct, z, 0.0), np.insert(counts, z, rows - len(values))
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) < bins:
        return middles
    stride = rows / bins
    total = np.cumsum(counts)
    pairs = total[:-1] + total[1:]  # the earlier of two sums is the nearer one where this exceeds twice the target
    cuts, at, target = [], 0, stride
    while (at := max(at, int(np.searchsorted(pairs, 2 * target, side="right")))) < len(pairs):
        cuts.append(middles[at])
        at, target = at + 1, target + stride
    return np.array(cuts)


class Chunk:
    """Some columns of one fit with the same number of bins: their entries by block of
    rows and by cell (column and bin).  Entries in the bin of zero are left out."""

    def __init__(self, fold: int, bins: int, cols, cuts, zero, local, seg_start, seg_cell, block_at):
        self.fold, self.bins, self.cols, self.zero, self.local, self.block_at = fold, bins, cols, zero, local, block_at
        self.cuts = cuts.reshape(len(cols), bins - 1)
        self.seg_start, self.seg_cell, self.size = seg_start, seg_cell, len(cols) * bins
        self.block_seg = np.searchsorted(seg_start, block_at)

    @classmethod
    def made(cls, fold: int, bins: int, cols, cuts: list[np.ndarray], entries: list, rows: int) -> Chunk:
        """``entries``: (rows, values) of each column, by value."""
        zero = np.array([np.searchsorted(c, 0.0) for c in cuts], np.int32)
        row, cell = [], []
        for f, ((r, v), c) in enumerate(zip(entries, cuts, strict=True)):
            at = np.concatenate(([0], np.searchsorted(v, c, side="right"), [len(v)]))
            a, z = at[zero[f]], at[zero[f] + 1]
            row.append(np.concatenate((r[:a], r[z:])))
            ends = np.diff(at)
            ends[zero[f]] = 0
            cell.append(np.repeat(np.arange(f * bins, f * bins + len(ends), dtype=np.uint16), ends))
        row, cell = np.concatenate(row), np.concatenate(cell)
        block = row >> BLOCK_BITS
        by = np.argsort(block.astype(np.uint16) if rows >> BLOCK_BITS < 1 << 16 else block, kind="stable")
        block, cell = block[by], cell[by]
        first = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])))) if len(cell) else np.zeros(0, int)
        padded = np.full((len(cuts), bins - 1), np.inf)
        for f, c in enumerate(cuts):
            padded[f, :len(c)] = c
        return cls(fold, bins, np.asarray(cols, np.int32), padded, zero, (row[by] & ((1 << BLOCK_BITS) - 1)).astype(np.uint16),
                   first.astype(np.int32), cell[first].astype(np.uint16), np.searchsorted(block, np.arange((rows >> BLOCK_BITS) + 2)).astype(np.int32))

    def _blocks(self):
        for k in range(len(self.block_at) - 1):
            a, z = int(self.block_at[k]), int(self.block_at[k + 1])
            if a < z:
                yield slice(k << BLOCK_BITS, (k + 1) << BLOCK_BITS), a, z, slice(self.block_seg[k], self.block_seg[k + 1])

    def _total(self, v: np.ndarray) -> np.ndarray:
        """Sums by cell of a complex number per row."""
        segs = np.empty(len(self.seg_start), np.complex128)
        for rows, a, z, s in self._blocks():
            got = np.take(v[rows], self.local[a:z], mode="clip")
            np.add.reduceat(got, self.seg_start[s] - a, out=segs[s])
        return np.bincount(self.seg_cell, segs.real, self.size) + 1j * np.bincount(self.seg_cell, segs.imag, self.size)

    def sums(self, x: Level) -> np.ndarray:
        """(node, column, bin) sums of the residuals and, as the imaginary part, of the
        rows that count: the largest node by all entries, the entries of the others picked out."""
        out = np.zeros((x.nodes, self.size), np.complex128)
        if len(self.local):
            out[x.largest] = self._total(x.of_largest)
            if x.nodes > 1:
                keys, weights = [], []
                for rows, a, z, s in self._blocks():
                    got = np.take(x.others[rows], self.local[a:z], mode="clip")
                    here = np.flatnonzero(got != x.nodes)
                    cell = np.repeat(self.seg_cell[s], np.diff(np.append(self.seg_start[s], z)))
                    keys.append(got[here].astype(np.int64) * self.size + cell[here])
                    weights.append(np.take(x.residuals[rows], self.local[a:z][here], mode="clip"))
                keys = np.concatenate(keys)
                both = np.bincount(keys, np.concatenate(weights), x.nodes * self.size) + 1j * np.bincount(keys, minlength=x.nodes * self.size)
                out += both.reshape(out.shape)  # nothing of the largest node is in it
        return out.reshape(x.nodes, len(self.cols), self.bins)

    def best(self, x: Level, least: int, least_gain: float) -> list:
        """For every node (gain, column here, bin, rows and sum on the left) of its best split, or None."""
        found = []
        for k, sums in enumerate(self.sums(x)):
            n, s = x.counts[k], x.totals[k]
            there = np.flatnonzero(sums.imag.any(1))  # all rows of the node are in the bin of zero of the other columns
            cnt, tot, every, zero = sums.imag[there], sums.real[there], np.arange(len(there)), self.zero[there]
            tot[cnt == 0] = 0.0
            cnt[every, zero], tot[every, zero] = n - cnt.sum(1), s - tot.sum(1)
            nl, sl = np.cumsum(cnt, 1)[:, :-1], np.cumsum(tot, 1)[:, :-1]
            nr, sr = n - nl, s - sl
            ok = (nl >= max(1, least)) & (nr >= max(1, least))
            ml, mr = sl / np.where(ok, nl, 1.0), sr / np.where(ok, nr, 1.0)
            ok &= np.abs(ml - mr) > SAME_MEAN * (np.abs(ml) + np.abs(mr))
            gain = np.where(ok, nl * nr / (n * n) * (ml - mr) ** 2, -1.0)
            most = gain.max(initial=-1.0)
            if most <= 0 or most < least_gain:
                found.append(None)
                continue
            f, b = np.unravel_index(int(np.argmax(gain >= most * (1 - SAME_GAIN))), gain.shape)
            found.append((float(gain[f, b]), int(there[f]), int(b), float(nl[f, b]), float(sl[f, b])))
        return found

    def side(self, f: int, b: int) -> tuple[bool, np.ndarray]:
        """Whether the right side of a split is given, and the rows of the side that is
        given: the one without the bin of zero."""
        right = bool(self.zero[f] <= b)
        a, z = (f * self.bins + b + 1, (f + 1) * self.bins) if right else (f * self.bins, f * self.bins + b + 1)
        segs = np.flatnonzero((self.seg_cell >= a) & (self.seg_cell < z))
        starts, ends = self.seg_start[segs], np.append(self.seg_start, len(self.local))[segs + 1]
        blocks = np.searchsorted(self.block_at, starts, side="right") - 1
        return right, np.concatenate([np.zeros(0, np.int32), *[
            self.local[i:j].astype(np.int32) + (int(k) << BLOCK_BITS) for i, j, k in zip(starts, ends, blocks, strict=True)]])


def chunked(cols: list[int], cuts: list[np.ndarray], entries: list, rows: int, fold: int):
    """Columns as chunks: those with about as many bins together; a column without a bound is in none."""
    by_bins: dict[int, list[int]] = {}
    for i, c in enumerate(cuts):
        if len(c):
            by_bins.setdefault(1 << int(len(c)).bit_length(), []).append(i)
    for bins, members in sorted(by_bins.items()):
        a, size = 0, 0
        for z, i in enumerate([*members, None]):
            more = 0 if i is None else len(entries[i][0])
            if z > a and (i is None or size + more > CHUNK_ENTRIES or (z - a + 1) * bins > CHUNK_CELLS):
                take = members[a:z]
                yield Chunk.made(fold, bins, [cols[j] for j in take], [cuts[j] for j in take], [entries[j] for j in take], rows)
                a, size = z, 0
            size += more


# -- levels -------------------------------------------------------------------

class Level:
    """What the bins of a fit are added up by: the nodes to split (their rows, sums and
    members) and the residuals of the rows that count."""

    def __init__(self, slot: np.ndarray, counts: list[float], totals: list[float], residuals: np.ndarray, drawn: np.ndarray):
        self.slot, self.nodes, self.counts, self.totals = slot, len(counts), np.array(counts), np.array(totals)
        self.largest = int(np.argmax(self.counts))
        self.residuals = residuals
        here = drawn & (slot == self.largest)
        self.of_largest = np.where(here, residuals, 0.0) + 1j * here
        self.others = np.where(drawn & ~here, slot, np.array(self.nodes, slot.dtype)).astype(slot.dtype)


def _better(a, b) -> bool:
    """The larger gain; of those that are the same but for rounding, the first column's."""
    return b is None or a[0] > b[0] * (1 + SAME_GAIN) or (a[0] >= b[0] * (1 - SAME_GAIN) and a[1] < b[1])


def answers(chunks, levels: dict[int, Level], p: dict) -> dict[int, list]:
    """By fit and node (gain, column, bound, rows and sum on the left, whether the right side is given, the rows
    of the given side) of the best split among the columns of ``chunks``."""
    best = {fold: [None] * x.nodes for fold, x in levels.items()}
    for c in chunks:
        if (x := levels.get(c.fold)) is None:
            continue
        for k, found in enumerate(c.best(x, p["least"], p["gain"])):
            if found and _better((found[0], int(c.cols[found[1]])), best[c.fold][k]):
                gain, f, b, nl, sl = found
                right, rows = c.side(f, b)
                best[c.fold][k] = (gain, int(c.cols[f]), float(c.cuts[f, b]), nl, sl, right, rows[x.slot[rows] == k])
    return best


def _packed(rows: np.ndarray, n: int) -> bytes:
    if 32 * len(rows) < n:
        return b"r" + rows.astype(np.int32).tobytes()
    bits = np.zeros(n, bool)
    bits[rows] = True
    return b"b" + np.packbits(bits).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32, offset=1) if raw[:1] == b"r" else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=n))


# -- trees --------------------------------------------------------------------

def _variance(n: float, s: float, ss: float) -> float:
    return max(0.0, ss / n - (s / n) ** 2)


class Fit:
    """A fit as it grows: the first tree on the labels, each further one on twice what is
    left of them, as the library does."""

    def __init__(self, fold: int, label: np.ndarray, train: np.ndarray, p: dict):
        self.fold, self.label, self.train, self.p = fold, label, train, p
        self.made, self.trees = np.zeros(len(label)), []

    def begin(self) -> None:
        t, p = len(self.trees), self.p
        self.residuals = self.label if t == 0 else 2.0 * (self.label - self.made)
        self.drawn = self.train
        if p["share"] < 1.0:
            self.drawn = self.train & (np.random.default_rng([p["seed"] & (1 << 63) - 1, t]).random(len(self.label)) < p["share"])
        r = np.where(self.drawn, self.residuals, 0.0)
        self.squares = r * r
        self.at = np.ones(len(r), np.int32)  # places as in a heap: the root is 1, below k are 2 k and 2 k + 1
        x = {"n": float(self.drawn.sum()), "s": float(r.sum()), "ss": float(self.squares.sum())}
        self.nodes, self.level = {1: x}, 0
        self.open = [1] if p["depth"] and x["n"] and _variance(**x) >= EPSILON else []

    def asked(self) -> tuple[np.ndarray, list[float], list[float]]:
        """Node of every row (past the last: of none that is open), rows and sums of the nodes."""
        k = len(self.open)
        slots = np.full(1 << self.level + 1, k, np.uint8 if k < 255 else np.int32)
        slots[self.open] = np.arange(k)
        at = np.where(self.at >> self.level > 0, self.at, 0) if self.level else self.at
        return slots[at], [self.nodes[i]["n"] for i in self.open], [self.nodes[i]["s"] for i in self.open]

    def split(self, found: list) -> None:
        p, self.level = self.p, self.level + 1
        to = np.arange(1 << self.level + 1, dtype=np.int32)
        new, moved = [], []
        for k, best in zip(self.open, found, strict=True):
            if best is None:
                continue
            gain, col, cut, nl, sl, right, rows = best
            x = self.nodes[k]
            self.nodes[2 * k], self.nodes[2 * k + 1] = {"n": nl, "s": sl}, {"n": x["n"] - nl, "s": x["s"] - sl}
            x |= {"f": col, "cut": cut, "gain": gain}
            moved.append((rows, 2 * k + right))
            to[k] = 2 * k + (not right)
            new += [2 * k, 2 * k + 1]
        if moved:
            self.at = to[self.at]
            for rows, child in moved:
                self.at[rows] = child
            ss = np.bincount(self.at, self.squares, len(to))
            for k in new:
                self.nodes[k]["ss"] = float(ss[k])
        self.open = [k for k in new if _variance(**self.nodes[k]) >= EPSILON] if self.level < p["depth"] else []

    def end(self) -> None:
        value = np.zeros(1 << self.p["depth"] + 1)
        for k, x in self.nodes.items():
            value[k] = x["s"] / x["n"] if x["n"] else 0.0
        self.made += (1.0 if not self.trees else self.p["step"]) * value[self.at]
        self.trees.append(self.nodes)

    def result(self) -> list:
        """(fold, mean absolute error over the rows that were held out, None) or (-1, None, trees)."""
        return [self.fold, None, self.trees] if self.train.all() else [self.fold, float(np.abs(self.label - self.made)[~self.train].mean()), None]


def boost(fits: list[Fit], p: dict, ask) -> None:
    """All trees of all fits; ``ask(fits, first)`` gives the best splits of the open nodes of each."""
    for _ in range(p["trees"]):
        for x in fits:
            x.begin()
        first = True
        while live := [x for x in fits if x.open]:
            found = ask(live, first)
            first = False
            for x in live:
                x.split(found[x.fold])
        for x in fits:
            x.end()


def started(label: np.ndarray, fold: np.ndarray, held: list[int], p: dict) -> list[Fit]:
    """A fit for each number of a fold, on the rows of the others (-1: on all rows)."""
    return [Fit(k, label, fold != k, p) for k in held]


# -- tasks --------------------------------------------------------------------

def _chunks(columns, shard: int, shards: int, held: list[int], p: dict):
    """The chunks of a shard's columns for each fit; bounds are from the rows that it is fitted on."""
    label, fold, ends, row, val = columns
    cols = range(shard, shard + shards * (len(ends) - 1), shards)
    entries = [(row[a:z], val[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
    for k in held:
        train = fold != k
        n = int(train.sum())
        # the library has no more bins than rows
        cuts = [bounds(v if n == len(label) else v[train[r]], n, min(p["bins"], n)) for r, v in entries]
        yield from chunked(cols, cuts, entries, len(label), k)


def alone(width: int, held: list[int], p: dict):
    """A whole fit in a task, the one of the task's number in ``held``."""
    def run(batches):
        columns = _columns(batches, width)
        own = [held[TaskContext.get().partitionId()]]
        fits, chunks = started(columns[0], columns[1], own, p), list(_chunks(columns, 0, 1, own, p))

        def ask(live, first):
            return answers(chunks, {x.fold: Level(*x.asked(), x.residuals, x.drawn) for x in live}, p)

        boost(fits, p, ask)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fits[0].result())])], names=["made"])
    return run


def lay_out(width: int, shards: int, held: list[int], p: dict):
    """The chunks of a shard; with the first shard, as number -1, labels and folds of the rows."""
    kinds = [(x.split()[0], pa.binary() if x.endswith("binary") else pa.int32()) for x in _CHUNK.split(", ")]

    def batch(**x):
        return pa.RecordBatch.from_arrays([pa.array([x.get(k)], kind) for k, kind in kinds], names=[k for k, _ in kinds])

    def run(batches):
        shard = TaskContext.get().partitionId()
        columns = _columns(batches, len(range(shard, width, shards)))
        if shard == 0:
            yield batch(number=-1, cols=columns[0].tobytes(), cuts=columns[1].tobytes())
        for i, c in enumerate(_chunks(columns, shard, shards, held, p)):
            yield batch(number=i * shards + shard, fold=c.fold, bins=c.bins, **{k: getattr(c, k).astype(kind).tobytes() for k, kind in _KINDS.items()})
    return run


def _read(batches):
    for b in batches:
        for i in range(b.num_rows):
            got = {k: np.frombuffer(x, kind) if (x := b.column(k)[i].as_buffer()).size else np.zeros(0, kind) for k, kind in _KINDS.items()}
            yield Chunk(b.column("fold")[i].as_py(), b.column("bins")[i].as_py(), *got.values())


def level(tree, asked, rows: int, p: dict):
    """One level: the best splits among a task's columns."""
    def run(batches):
        levels = {fold: Level(*x, *tree.value[fold]) for fold, x in asked.value.items()}
        for fold, found in answers(_read(batches), levels, p).items():
            kept = [(k, x) for k, x in enumerate(found) if x]
            names = ["fold", "node", "gain", "col", "cut", "nl", "sl", "right", "given"]
            yield pa.RecordBatch.from_arrays([
                pa.array([fold] * len(kept), pa.int32()), pa.array([k for k, _ in kept], pa.int32()),
                *[pa.array([x[i] for _, x in kept], kind) for i, kind in enumerate((pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()))],
                pa.array([_packed(x[6], rows) for _, x in kept], pa.binary())], names=names)
    return run


_FOUND = "fold int, node int, gain double, col int, cut double, nl double, sl double, right boolean, given binary"


# -- driver -------------------------------------------------------------------

def _spread(blocks: DataFrame, width: int, shards: int, held: list[int], p: dict) -> list[Fit]:
    """The fits, with a job for every level."""
    spark = blocks.sparkSession
    sc = spark.sparkContext
    tasks = max(min(shards, sc.defaultParallelism), shards // SHARDS_TOGETHER)
    table = blocks.mapInArrow(lay_out(width, shards, held, p), _CHUNK) \
        .repartitionById(tasks, F.when(F.col("number") < 0, 0).otherwise(F.col("number") % tasks)).persist(StorageLevel.MEMORY_AND_DISK)
    sent: list = []

    def ask(live, first):
        if first:
            while sent:
                sent.pop().destroy()
            sent.append(sc.broadcast({x.fold: (x.residuals, x.drawn) for x in live}))
        asked = sc.broadcast({x.fold: x.asked() for x in live})
        found = chunks.mapInArrow(level(sent[0], asked, len(label), p), _FOUND).collect()
        asked.destroy()
        best = {x.fold: [None] * len(x.open) for x in live}
        for r in found:
            if _better((r.gain, r.col), best[r.fold][r.node]):
                best[r.fold][r.node] = (r.gain, r.col, r.cut, r.nl, r.sl, r.right, r.given)
        return {k: [x and (*x[:-1], _unpacked(bytes(x[-1]), len(label))) for x in b] for k, b in best.items()}

    try:
        rows = table.where("number = -1").select("cols", "cuts").first()
        label, fold = np.frombuffer(rows.cols, np.float64), np.frombuffer(rows.cuts, np.int32)
        chunks = table.where("number >= 0")
        spark.conf.set(_ROWS, str(CHUNKS))
        fits = started(label, fold, held, p)
        boost(fits, p, ask)
        return fits
    finally:
        table.unpersist()
        while sent:
            sent.pop().destroy()


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _run(matrix: DataFrame, width: int, shards: int, held: list[int], est) -> list:
    """``Fit.result`` of each fit."""
    if est.getLossType() != "squared" or est.getFeatureSubsetStrategy() != "all":
        raise ValueError("only the squared error over all columns")
    spark = matrix.sparkSession
    p = {"trees": est.getMaxIter(), "depth": est.getMaxDepth(), "step": est.getStepSize(), "share": est.getSubsamplingRate(), "bins": est.getMaxBins(),
         "least": est.getMinInstancesPerNode(), "gain": est.getMinInfoGain(), "seed": est.getSeed()}
    vector = F.unwrap_udt("features")
    rows = matrix.select(F.col("label").cast("double").alias("label"), (F.col("fold") if held != [-1] else F.lit(0)).cast("int").alias("fold"),
                         vector["indices"].alias("indices"), vector["values"].alias("values"))
    together = (rows.agg(F.sum(F.size("indices"))).first()[0] or 0) <= ALONE_ENTRIES
    shards = 1 if together else max(2, min(shards, width))
    before = spark.conf.get(_ROWS, "10000")
    spark.conf.set(_ROWS, str(BATCH))  # a block holds megabytes
    try:
        blocks = rows.mapInArrow(deal(shards), _BLOCK)
        if together:
            each = blocks.withColumn("shard", F.explode(F.array(*map(F.lit, range(len(held)))))).repartitionById(len(held), "shard")
            return [json.loads(r.made) for r in each.mapInArrow(alone(width, held, p), "made string").collect()]
        return [x.result() for x in _spread(blocks.repartitionById(shards, "shard"), width, shards, held, p)]
    finally:
        spark.conf.set(_ROWS, before)


def fit(matrix: DataFrame, width: int, shards: int, est):
    """The model of ``est`` (a ``GBTRegressor``, which holds the parameters) on all rows of
    (label, features), sparse vectors of ``width`` columns that are dealt out as ``shards``."""
    from pyspark.ml.regression import GBTRegressionModel

    trees = [{int(k): x for k, x in t.items()} for t in _run(matrix, width, shards, [-1], est)[0][2]]
    sc = matrix.sparkSession.sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    ml, uid = jvm.org.apache.spark.ml, est.uid

    def node(t: dict, k: int):
        x = t[k]
        stats = gateway.new_array(jvm.double, 3)
        stats[0], stats[1], stats[2] = x["n"], x["s"], x["ss"]
        kept = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, int(x["n"]))
        value, var = (x["s"] / x["n"], _variance(x["n"], x["s"], x["ss"])) if x["n"] else (0.0, 0.0)
        if "f" not in x:
            return ml.tree.LeafNode(value, var, kept)
        return ml.tree.InternalNode(value, var, x["gain"], node(t, 2 * k), node(t, 2 * k + 1), ml.tree.ContinuousSplit(x["f"], x["cut"]), kept)

    made = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, t in enumerate(trees):
        made[i] = ml.regression.DecisionTreeRegressionModel(f"{uid}_tree_{i}", node(t, 1), width)
        weights[i] = 1.0 if i == 0 else est.getStepSize()
    est._transfer_params_to_java()
    model = GBTRegressionModel(est._java_obj.copyValues(ml.regression.GBTRegressionModel(uid, made, weights, width), ml.param.ParamMap()))
    return est._copyValues(model)


def fold_errors(matrix: DataFrame, width: int, shards: int, folds: int, est) -> list[float]:
    """The mean absolute error over the rows of each ``fold`` of a fit on the others."""
    return [x[1] for x in sorted(_run(matrix, width, shards, list(range(folds)), est))]
