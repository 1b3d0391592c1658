"""The Merkle manifest against a tree built in one piece."""

import hashlib
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[k: k + fanout]) for k in range(0, len(now), fanout)])
    return levels


def path_of(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        run = at // fanout * fanout
        out.append(("".join(level[run:at]), "".join(level[at + 1: run + fanout])))
        at //= fanout
    return out


def brute(rows, fanout):
    """rows: (key, group, id, leaf) -> key: (subroot, root, levels)."""
    groups = {}
    for key, group, i, leaf in rows:
        groups.setdefault(group, []).append((i is not None, i or 0, leaf, key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(groups[g])], fanout) for g in names}
    top = tree_of([trees[g][-1][0] for g in names], fanout)
    return {x[3]: (trees[g][-1][0], top[-1][0], path_of(trees[g], at, fanout) + path_of(top, names.index(g), fanout))
            for g in names for at, x in enumerate(sorted(groups[g]))}


@pytest.mark.parametrize("fanout,block", [(2, 16), (3, 9)])
def test_manifest_equals_one_tree(spark, fanout, block):
    rows = [(k, [None, "", "a", "b", "é", "hot", "hot", "hot"][k * k % 8], k * 37 % 501, h(str(k))) for k in range(301)]
    rows += [(1000 + k, "hot", 9000 + k, h("more", str(k))) for k in range(130)] + [(2000, "lone", 5, h("lone"))]
    got = merkle.manifest(spark.createDataFrame(rows, "key int, lang string, doc_id long, leaf string"), fanout=fanout, block_leaves=block)
    want = brute([(k, g, i, leaf) for k, g, i, leaf in rows], fanout)
    found = got.withColumn("folded", merkle.folded(F.col("leaf"), F.col("levels"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.subroot, r.root, [(s.left, s.right) for s in r.levels]) == want[r.key] and r.folded == r.root


def test_manifest_odd_rows(spark):
    rows = [(1, None, "x"), (None, None, "x"), (None, None, "x"), (2, "de", None), (3, "de", ""), (3, "de", ""), (4, "de", "y" * 200_000)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string") \
        .withColumns({"tree": F.lit("t"), "row": F.lit(1), "block": F.lit(2), "levels": F.lit(3), "root": F.lit("r"), "digest": F.lit("d"), "at": F.lit(5)})
    d = d.withColumn("leaf", merkle.leaf_hash(F.col("doc_id"), F.col("text")))
    got = merkle.manifest(d).collect()
    want = brute([(k, g, i, leaf_of(i, t)) for k, (i, g, t) in enumerate(rows)], 2)
    assert sorted(r.subroot for r in got) == sorted(w[0] for w in want.values()) and {r.root for r in got} == {want[0][1]}
    assert {(r.tree, r.row, r.block, r.at) for r in got} == {("t", 1, 2, 5)}
    assert all(sorted((s.left, s.right) for s in r.levels) in [sorted(w[2]) for w in want.values()] for r in got)
    none = merkle.manifest(d.limit(0))
    assert none.count() == 0 and none.columns[-3:] == ["levels", "subroot", "root"]
    lone = merkle.manifest(d.where("doc_id = 4")).first()
    assert lone.levels == [] and lone.root == lone.subroot == lone.leaf


def test_manifest_query_and_tampering(spark):
    d = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in queries.QUERIES["op13_merkle_manifest"](spark, SF).collect()}
    leaves = {r["doc_id"]: leaf_of(*[r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]) for r in d}
    want = brute([(r["doc_id"], r["lang"], r["doc_id"], leaves[r["doc_id"]]) for r in d], 2)
    assert got.keys() == leaves.keys()
    for i, r in got.items():
        subroot, root, path = want[i]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaves[i], subroot, root, h(*[a + b for a, b in path]))
        assert r.verified == (zlib.crc32(str(i).encode()) % 7 != 0) == (r.folded_root == r.root)
    assert not all(r.verified for r in got.values())
