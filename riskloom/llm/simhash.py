"""SimHash near-duplicates.

Method: byte-position inverted index with count filtering.  A fingerprint of
64 bits has eight positional bytes.  Two fingerprints that differ in at most
d bits share at least 8 - d of them: the guaranteed minimum.  A posting per
single byte would hold a 256th of all fingerprints, which grows with the square
of the corpus; the index therefore holds a posting for every choice of one
position less than the minimum, with their bytes.  In a posting the positional
bytes that two fingerprints share are tallied, pairs under the minimum are left
out, and the rest are verified by the bits that differ.

A posting of many fingerprints is split by each of its further positions: a
pair that reaches the minimum shares one of these bytes too.  Only d bytes are
free then, and the fingerprints within d bits of one are looked up, so the work
is linear and not that of all pairs.

Copies are folded first: only different fingerprints enter the index, and a
posting gives the edges of a spanning forest, never all its pairs.

Cases: a null text counts as empty; a text without words has fingerprint zero
and links like any other; fewer words than a shingle are one shingle; an empty
table gives no rows; rows with a null id link too, but a group's id is the
smallest id that is not null (null when it has none); repeated rows stay; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, materialize, require, with_row_ids
from .runs import components, map_runs, roots

SHINGLE_WORDS = 3
MOST_BITS = 2
SEED = 42
#: Fingerprints of a posting that are tallied pair by pair; larger postings are split.
LARGE = 1024


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed number."""
    from xxhash import xxh64_intdigest as h

    found = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    many = max(1, len(found) - words + 1)
    starts, ends = (ends - lengths)[:many], ends[-many:]
    total = np.zeros(64, np.int64)
    for at in range(0, many, 65536):
        hashes = [h(joined[a:b], seed) for a, b in zip(starts[at: at + 65536].tolist(), ends[at: at + 65536].tolist())]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > many).view(">i8")[0])


def with_fingerprints(docs: DataFrame, text_col: str, name: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` and the fingerprint of the text as a long."""
    require(docs, text_col)
    at = docs.columns.index(text_col)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words, seed) for t in byte_values(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(printed, f"{fields}, `{name}` long")


def _positional(fp: Column, kept: tuple[int, ...]) -> Column:
    mask = sum(255 << (8 * i) for i in kept)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def choices(most_bits: int) -> list[tuple[int, ...]]:
    """The byte positions of every posting: one less than the guaranteed minimum."""
    return list(combinations(range(8), 7 - most_bits))


def links(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints (column ``fp``,
    different longs) which chains of at most ``most_bits`` differing bits connect."""
    if not 0 <= most_bits <= 2:
        raise ValueError("postings are bounded for at most 2 differing bits")
    positions = choices(most_bits)
    fp = F.col("fp")
    postings = prints.select("fp", F.posexplode(F.array(*[_positional(fp, c) for c in positions])).alias("choice", "bytes"))

    def linked(whole: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, choice = whole.column("fp").to_numpy().view(np.uint64), whole.column("choice").to_numpy()
        left, right = [], []
        for s, e in zip(starts[:-1][np.diff(starts) > 1].tolist(), starts[1:][np.diff(starts) > 1].tolist()):
            group = values[s:e]
            root = roots(e - s, *_verified(group, most_bits)) if e - s <= LARGE else _split(group, positions[choice[s]], most_bits)
            child = np.flatnonzero(root != np.arange(e - s))
            left.append(group[child])
            right.append(group[root[child]])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64), pa.int64()) for x in (left, right)], names=["a", "b"])

    return map_runs(postings, ["choice", "bytes"], linked, "a long, b long").distinct()


def _counted(group: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a posting that share the guaranteed number of positional bytes."""
    parts = group.view(np.uint8).reshape(-1, 8)
    tally = sum((parts[:, i, None] == parts[None, :, i]).astype(np.int8) for i in range(8))
    i, j = np.nonzero(tally >= 8 - most_bits)
    return i[i < j], j[i < j]


def _verified(group: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of these, the pairs that differ in few enough bits."""
    i, j = _counted(group, most_bits)
    near = np.bitwise_count(group[i] ^ group[j]) <= most_bits
    return i[near], j[near]


def _split(group: np.ndarray, shared: tuple[int, ...], most_bits: int) -> np.ndarray:
    """The smallest index that each fingerprint of a large posting is linked to,
    over its parts by one further byte each."""
    parts, root = group.view(np.uint8).reshape(-1, 8).astype(np.uint32), np.arange(len(group))
    free = [k for k in range(8) if k not in shared]
    flips = [sum(1 << k for k in bits) for many in range(1, most_bits + 1) for bits in combinations(range(8 * most_bits), many)]
    for further in free:
        rest = [k for k in free if k != further]
        key = (parts[:, further] << np.uint32(8 * most_bits)) | sum((parts[:, k] << np.uint32(8 * n) for n, k in enumerate(rest)), np.uint32(0))
        order = np.argsort(key)
        ranked = key[order]
        for flip in flips:
            wanted = key ^ np.uint32(flip)
            at = np.minimum(np.searchsorted(ranked, wanted), len(key) - 1)
            hit = np.flatnonzero(ranked[at] == wanted)
            root = roots(len(key), np.concatenate([hit, np.arange(len(key))]), np.concatenate([order[at[hit]], root]))
    return root


def groups(rows: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(fp, root) of every fingerprint in ``rows`` (column ``fp``)."""
    prints = rows.select("fp").distinct()
    found = components(links(prints, most_bits))
    return prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    most_bits: int = MOST_BITS) -> DataFrame:
    """Per document: the id column, fingerprint (16 hexadecimal digits) and component_id."""
    require(docs, id_col, text_col)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows = materialize(with_fingerprints(rows, "text", "fp", words).select("id", "fp"), "fingerprints")
    per = rows.groupBy("fp").agg(F.min("id").alias("least"))
    named = materialize(groups(per, most_bits).join(per, "fp"), "groups")
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(heads, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                  most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (null
    ids last; of equal ids the first row of the table as written)."""
    require(docs, id_col, text_col)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, text_at = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    stored = materialize(with_row_ids(with_fingerprints(plain, text_at, "fp", words)), "printed")
    order = F.struct(F.col(at).isNull().alias("last"), F.col(at).alias("id"), F.col("rid"))
    per = materialize(stored.groupBy("fp").agg(F.min(order).alias("first")), "firsts")
    best = groups(per, most_bits).join(per, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    return stored.join(best, "rid", "left_semi").drop("rid", "fp").toDF(*names)
