"""Benchmark decontamination.

Method: Wu-Manber multi-pattern search over words.  The patterns are the
windows of the benchmark items.  For patterns of one length a shift table says
for each block of two words how far the search may jump (a block that ends no
pattern early lets it skip), blocks with shift zero select a bucket of test
strings by their suffix, the pattern's first block narrows the bucket, and a
direct comparison of all words confirms an occurrence.  Items shorter than a
window are patterns of their own length with tables of their own.

The benchmark is a stated query set.  Its windows go to the tasks in blocks of
at most ``block_chars`` characters of item text, each block a narrow pass over
all documents, so that no task ever holds more than one bounded table per
pass, whatever the size of the benchmark.

Cases: a null text or a text without words has no words and no hits; a null
or wordless item has no window; equal windows of several items count for each
of them; a repeated item counts once; a null item_id marks words but is not
listed; an empty benchmark leaves every document clean; repeated documents and
null ids are answered row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, require, without

WINDOW_WORDS = 10
#: Item text of one block.  Its tables take some 150 bytes a character in each task.
BLOCK_CHARS = 2_000_000

#: A-Z in lower case; digits, letters and every byte of a non-ASCII character stay; the rest parts words.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32
              for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Occurrences of patterns of one length in a sequence of words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple[str | None, ...]]) -> None:
        self.length, self.width = length, min(2, length)
        self.longest = length - self.width + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.width, length + 1):
                block, far = b" ".join(pattern[end - self.width: end]), length - end
                if far < self.shift.get(block, self.longest):
                    self.shift[block] = far
            suffix, prefix = b" ".join(pattern[-self.width:]), b" ".join(pattern[: self.width])
            self.buckets.setdefault(suffix, {}).setdefault(prefix, []).append((list(pattern), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[str | None, ...]]]:
        """(start, items) of every occurrence."""
        length, longest, shift, at, n = self.length, self.longest, self.shift.get, self.length, len(words)
        pair = self.width == 2
        while at <= n:
            block = words[at - 2] + b" " + words[at - 1] if pair else words[at - 1]
            far = shift(block, longest)
            if far:
                at += far
                continue
            start = at - length
            first = words[start] + b" " + words[start + 1] if pair else words[start]
            for pattern, items in self.buckets[block].get(first, ()):
                if words[start: at] == pattern:
                    yield start, items
            at += 1


def matchers(items: list[tuple[str | None, bytes]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if words else 0):
            by_length.setdefault(length, {}).setdefault(tuple(words[start: start + length]), set()).add(item)
    return [WuManber(n, {p: tuple(s) for p, s in found.items()}) for n, found in sorted(by_length.items())]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list]:
    """The items in blocks of about ``block_chars`` characters."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text")) \
        .where("text is not null and text <> ''")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        found = [(r.item, r.text.encode()) for r in part.toLocalIterator()]
        if found:
            yield found


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = WINDOW_WORDS, block_chars: int = BLOCK_CHARS,
                 prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated
    (names after ``prefix``); columns of ``docs`` that had these names are replaced."""
    require(docs, text_col)
    added = [prefix + n for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")]
    docs = without(docs, *added)
    spark = docs.sparkSession
    spans, items = added[5:]
    n_words, n_hit, n_items, digest, contaminated = added[:5]
    out = docs.withColumns({spans: F.lit(None).cast("binary"), items: F.array().cast("array<string>")})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    at = out.columns.index(text_col)

    def one_pass(shared, last: bool):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = matchers(shared.value if shared else [], window)
            for batch in batches:
                own, (before, had) = batch.columns[:-2], [c.to_pylist() for c in batch.columns[-2:]]
                rows = [_searched(tables, words_of(t), b, h) for t, b, h in zip(byte_values(batch.column(at)), before, had)]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*[(_counted if last else _carried)(r) for r in rows]) if rows else
                                                                [[]] * 5, _COUNTED if last else _CARRIED)]
                yield pa.RecordBatch.from_arrays(own + columns, names=batch.schema.names[:-2] + (added[:5] if last else added[5:]))
        return search

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    blocks = item_blocks(benchmark, item_col, item_text_col, block_chars)
    block = next(blocks, None)
    while True:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(block) if block else None
        out = out.mapInArrow(one_pass(shared, after is None), fields if after is not None else
                             f"{kept}, `{n_words}` long, `{n_hit}` long, `{n_items}` long, `{digest}` string, `{contaminated}` boolean")
        if after is None:
            return out
        block = after


_CARRIED = (pa.binary(), pa.list_(pa.string()))
_COUNTED = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


def _searched(tables: list[WuManber], words: list[bytes], before: bytes | None, had: list[str]) -> tuple:
    places, found = [], set(had)
    for t in tables:
        for start, who in t.search(words):
            places += (start, t.length)
            found.update(i for i in who if i is not None)
    return len(words), (before or b"") + np.array(places, "<i4").tobytes(), sorted(found)


def _carried(row: tuple) -> tuple:
    return row[1:]


def _counted(row: tuple) -> tuple:
    n, places, items = row
    hit = bytearray(n)
    for start, length in np.frombuffer(places, "<i4").reshape(-1, 2).tolist():
        hit[start: start + length] = b"\x01" * length
    hits = hit.count(1)
    return n, hits, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hits > 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark window occurs, all columns as they were."""
    prefix = "found_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    found = find_windows(docs, benchmark, text_col, prefix=prefix, **more)
    return found.where(~F.col(prefix + "contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
