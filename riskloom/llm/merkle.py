"""Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf: the sha256 of its columns.  The leaves of a group stand in
id order under one tree, the groups' roots in group order under a last one.  A
node is the hash of the hex digests of ``fanout`` consecutive nodes; the last
run of a level may be shorter, down to a single node, which is hashed again.

Method: butterfly exchange.  A tree is cut into aligned partitions of a power of
``fanout`` leaves, and a task hashes each partition up to its root.  Then, round
by round, aligned groups of ``fanout`` partitions swap the roots of their
subtrees: partition p meets those that differ from it in digit r of p, written
to the base ``fanout``.  All members of a group hash the common ancestor for
themselves, and each notes its siblings on the way, so after the last round every
partition holds the root and its own upper proof; nothing is handed down the
tree.  Empty partitions pad a tree to a power of ``fanout`` and carry on the roots
of the short right-hand side.  A round moves at most ``fanout`` short rows per
partition.

Places of rows are counted without a window over a group: rows are range
partitioned by group and id, counted within partitions, and the few counts are
summed.  So a group that holds most rows is dealt over all tasks.

Cases: a null column enters a leaf as ``-``, an empty text as ``0:``; texts of any
length are hashed whole; a null group is a group of its own, in front of the
others; rows with a null id come first, ties are ordered by leaf, and repeated
rows are leaves of their own; an empty table gives no rows; other columns are
carried along, those of the names of results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, require, task_number, without

FANOUT = 2
#: A partition holds the largest power of the fanout up to this many leaves.
BLOCK_LEAVES = 4096
#: Rounds between two writes of the partitions' state.
ROUNDS_A_WRITE = 6
_LEVELS = "array<struct<left:string,right:string>>"


def leaf_hash(*columns: Column) -> Column:
    """Hex sha256 over the columns: ``-`` for null, else byte count, ``:``, value."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, levels: Column) -> Column:
    """The root that ``leaf`` leads to with the siblings of ``levels``."""
    return F.aggregate(levels, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_hash(levels: Column) -> Column:
    """Hex sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(levels, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, leaf_col: str = "leaf", id_col: str = "doc_id", group_col: str = "lang", fanout: int = FANOUT,
             block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """``rows`` with levels (siblings to the left and right from the leaf up to
    ``root``), subroot and root."""
    require(rows, leaf_col, id_col, group_col)
    if fanout < 2 or block_leaves < fanout:
        raise ValueError("fanout must be 2 or more, and a block hold a fanout at least")
    kept = without(rows, "levels", "subroot", "root")
    packed = kept.select(
        # names of equal bytes are one group; null sorts in front of the empty name
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("tree"),
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{leaf_col}`").alias("digest"),
        F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"))
    leaves = _numbered(packed, fanout, block_leaves)
    tops = materialize(_butterfly(_block_roots(leaves, fanout), fanout), "partitions")

    groups = _numbered(tops.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"),
                                                      F.struct(F.col("tree").alias("name")).alias("row")), fanout, block_leaves)
    above = _butterfly(_block_roots(groups, fanout), fanout)
    above = _with_levels(groups, above.withColumn("subroot", F.col("root")), fanout).select("row.name", F.col("levels").alias("more"), F.col("root").alias("top"))
    heads = tops.join(above, tops["tree"] == above["name"]).select(
        "tree", "block", F.concat("levels", "more").alias("levels"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    return _with_levels(leaves, heads, fanout).select("row.*", "levels", "subroot", "root")


def _numbered(nodes: DataFrame, fanout: int, block_leaves: int) -> DataFrame:
    """(tree, id, digest, row) with n (nodes of the tree), block and at (place in the block)."""
    size = fanout
    while size * fanout <= block_leaves:
        size *= fanout
    order = ["tree", "id", "digest", "tie"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth, part = None, 0, task_number()
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column(0).dictionary_encode()
            codes, names = trees.indices.to_numpy(), trees.dictionary.to_pylist()
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            first = np.where(np.arange(len(starts)) == 0, nth if names[codes[0]] == last else 0, 0)
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
            place = np.arange(len(codes)) - starts[run] + first[run]
            last, nth = names[codes[-1]], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(np.full(len(codes), part, np.int64)), pa.array(place, pa.int64())],
                names=["tree", "id", "digest", "row", "part", "nth"])

    kinds = dict(nodes.dtypes)
    ranged = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie") \
        .mapInArrow(counted, f"tree string, id {kinds['id']}, digest string, row {kinds['row']}, part long, nth long")
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("start"),
                           F.sum("here").over(Window.partitionBy("tree")).alias("n"))
    placed = ranged.join(counts, ["tree", "part"]).withColumn("place", F.col("start") + F.col("nth"))
    return materialize(placed.select("tree", "digest", "row", "n", F.expr(f"place div {size}").alias("block"),
                                     (F.col("place") % size).cast("int").alias("at"), F.lit(size).alias("size")), "placed")


def _hashed_up(digests: list[str], n: int, size: int, fanout: int) -> list[list[str]]:
    """The levels of a block, leaves first, the block's root last."""
    levels, reach = [digests], 1
    while reach < min(n, size):
        now = levels[-1]
        levels.append([hashlib.sha256("".join(now[k: k + fanout]).encode()).hexdigest() for k in range(0, len(now), fanout)])
        reach *= fanout
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block) of a sorted partition."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        trees, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        starts = [0] + [k for k in range(1, len(trees)) if blocks[k] != blocks[k - 1] or trees[k] != trees[k - 1]] + [len(trees)]
        for s, e in zip(starts[:-1], starts[1:]):
            if held and (trees[s], blocks[s]) != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = (trees[s], blocks[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _block_roots(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, m, root): the root of every partition of the m of its tree."""
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _blocks(batches):
            n, size = whole.column("n")[0].as_py(), whole.column("size")[0].as_py()
            root = _hashed_up(whole.column("digest").to_pylist(), n, size, fanout)[-1][0]
            yield pa.RecordBatch.from_arrays([whole.column("tree").chunk(0).slice(0, 1), pa.array([whole.column("block")[0].as_py()], pa.int64()),
                                              pa.array([-(-n // size)], pa.int64()), pa.array([root])], names=["tree", "block", "m", "root"])

    rows = nodes.select("tree", "block", "at", "digest", "n", "size").repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return materialize(rows.mapInArrow(roots, "tree string, block long, m long, root string"), "roots")


def _butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, levels, root): every partition with its upper proof and the root of its tree."""
    most = blocks.agg(F.max("m")).first()[0] or 1
    padded = F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.lit(1).cast("long"), lambda acc, _: F.when(acc < F.col("m"), acc * fanout).otherwise(acc))
    state = blocks.withColumns({"padded": padded, "levels": F.array().cast(_LEVELS)}) \
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1)))) \
        .withColumn("p", F.col("block") + F.col("k") * F.col("m")).where("p < padded") \
        .select("tree", "p", "m", F.when(F.col("k") == 0, F.col("root")).alias("root"), "levels")
    step, done = 1, 0
    while step < most:
        digit = F.expr(f"cast((p div {step}) % {fanout} as int)")
        # a finished tree sends to itself alone
        to = F.when(F.col("m") > step, F.sequence(F.lit(0), F.lit(fanout - 1))).otherwise(F.array(F.col("digit")))
        sent = state.withColumn("digit", digit).withColumn("to", F.explode(to)) \
            .select("tree", (F.col("p") + (F.col("to") - F.col("digit")) * F.lit(step)).alias("p"), "m", "digit", "root",
                    F.when(F.col("to") == F.col("digit"), F.col("levels")).alias("levels"))
        met = sent.groupBy("tree", "p").agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("digit", "root"))).alias("group"),
                                            F.first("levels", ignorenulls=True).alias("levels")).withColumn("digit", digit)
        text = F.transform("group", lambda x: F.coalesce(x["root"], F.lit("")))
        left = F.array_join(F.slice(text, F.lit(1), F.col("digit")), "")
        right = F.array_join(F.slice(text, F.col("digit") + 2, F.lit(fanout)), "")
        there = F.array_join(text, "")
        going = F.col("m") > step
        state = met.select(
            "tree", "p", "m",
            F.when(going, F.when(there != "", F.sha2(there, 256))).otherwise(F.col("group")[0]["root"]).alias("root"),
            F.when(going, F.concat("levels", F.array(F.struct(left.alias("left"), right.alias("right"))))).otherwise(F.col("levels")).alias("levels"))
        step, done = step * fanout, done + 1
        if done % ROUNDS_A_WRITE == 0:
            state = materialize(state, "round")
    return state.where("p < m").select("tree", F.col("p").alias("block"), "levels", "root")


def _with_levels(nodes: DataFrame, heads: DataFrame, fanout: int) -> DataFrame:
    """row, levels, subroot, root of every node; ``heads`` has the upper levels of
    each block and comes as the first row of its run."""
    row = dict(nodes.dtypes)["row"]

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _blocks(batches):
            upper, subroot, root = (whole.column(c)[0].as_py() for c in ("levels", "subroot", "root"))
            own = whole.slice(1)
            n, size = own.column("n")[0].as_py(), own.column("size")[0].as_py()
            up = _hashed_up(own.column("digest").to_pylist(), n, size, fanout)[:-1]
            left, right, index, at = [], [], [], np.arange(own.num_rows)
            for level in up:
                index.append(at + len(left))
                for k in range(0, len(level), fanout):
                    run = level[k: k + fanout]
                    left += ["".join(run[:j]) for j in range(len(run))]
                    right += ["".join(run[j + 1:]) for j in range(len(run))]
                at = at // fanout
            for s in upper:
                index.append(np.full(own.num_rows, len(left)))
                left.append(s["left"])
                right.append(s["right"])
            flat = pa.array(np.stack(index, axis=1).ravel() if index else np.zeros(0, np.int64), pa.int64())
            pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()).take(flat), pa.array(right, pa.string()).take(flat)], names=["left", "right"])
            offsets = pa.array(np.arange(own.num_rows + 1, dtype=np.int32) * len(index))
            yield pa.RecordBatch.from_arrays(
                [own.column("row").chunk(0) if own.column("row").num_chunks == 1 else own.column("row").combine_chunks(),
                 pa.ListArray.from_arrays(offsets, pairs), pa.array([subroot] * own.num_rows, pa.string()), pa.array([root] * own.num_rows, pa.string())],
                names=["row", "levels", "subroot", "root"])

    rows = nodes.select("tree", "block", "at", "digest", "n", "size", "row", F.lit(None).cast(_LEVELS).alias("levels"),
                        F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    first = heads.select("tree", "block", F.lit(-1).alias("at"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("n"),
                         F.lit(0).alias("size"), F.lit(None).cast(row).alias("row"), "levels", "subroot", "root")
    return rows.union(first).repartition("tree", "block").sortWithinPartitions("tree", "block", "at") \
        .mapInArrow(proved, f"row {row}, levels {_LEVELS}, subroot string, root string")
