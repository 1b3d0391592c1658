"""Best-fit packing of documents into token sequences.

Method: bounded-space online best-fit.  Every task packs the documents of its
own input split, so nothing is shuffled and a lost task is simply run again.
A fixed number of bins is open; a bitset keyed by free space finds the open
bin with the least room that still holds a piece, and when a new bin is needed
beyond the bound, the fullest open bin closes first.  Pieces of one Arrow
batch are placed from long to short, a look-ahead of bounded size.

Tokens come from the given tokenizer file.  Its pre-tokenizer never joins
across white space, so a text's ids are the ids of its white-space-free runs,
one after the other; a worker keeps the ids of runs it has met in a bounded
dictionary of packed little-endian 32-bit ids.

Cases: a null text counts as empty and becomes one piece with the end id
alone; an empty table gives no rows; repeated rows and rows with a null id are
packed one by one; other columns are ignored whatever their names.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_values, require, task_number

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Open bins per task, and runs of text whose ids a task remembers.
OPEN_BINS = 2048
REMEMBERED_RUNS = 600_000
ASKED_AT_ONCE = 256
SHARE_BYTES = 2_000_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class OpenBins:
    """Best-fit over a fixed number of open bins.

    ``free`` is an integer whose bit f says that some open bin has f tokens of
    room; ``bins`` lists those bins by their room."""

    def __init__(self, capacity: int, most: int) -> None:
        if capacity < 1 or most < 1:
            raise ValueError("capacity and the number of open bins must be positive")
        self.capacity, self.most = capacity, most
        self.free, self.bins, self.open, self.made = 0, {}, 0, 0

    def _take(self, room: int) -> int:
        same = self.bins[room]
        found = same.pop()
        if not same:
            self.free ^= 1 << room
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of 1 to ``capacity`` tokens."""
        if not 0 < size <= self.capacity:
            raise ValueError(f"a piece of {size} tokens does not fit {self.capacity}")
        fitting = self.free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            found = self._take(room)
        else:
            found, room = self.made, self.capacity
            self.made += 1
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        offset, room = self.capacity - room, room - size
        if room:
            same = self.bins.setdefault(room, [])
            same.append(found)
            self.free |= 1 << room
            self.open += 1
        return found, offset


class RunEncoder:
    """text (UTF-8) -> its ids as packed little-endian unsigned 32-bit numbers.

    Remembers the ids of runs, the ones met lately in ``now`` and those before
    in ``past``; each holds ``remembered`` runs at most.  A run of ASCII
    letters and digits has the same ids in either case, and punctuation that
    ends such a run is a token sequence of its own, so both are looked up
    before the tokenizer is asked."""

    def __init__(self, path: str, remembered: int = REMEMBERED_RUNS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are packed as native 32-bit numbers, which must be little-endian")
        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith(mark) for k in range(self.tokenizer.get_vocab_size())]) \
            if mark else None
        self.now: dict[bytes, bytes] = {}
        self.past: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text.  New runs are asked for many texts at a time."""
        for some in _shares(texts, SHARE_BYTES):
            if len(self.now) > self.remembered:
                self.now, self.past = {}, self.now
            # split at ASCII white space, which no token crosses; the tokenizer folds case itself, but for its special tokens
            split = [(t if b"<|" in t else t.lower()).split() for t in some]
            found = [list(map(self.now.get, runs)) for runs in split]
            self._learn({r for runs, ids in zip(split, found) if None in ids for r, i in zip(runs, ids) if i is None})
            for runs, ids in zip(split, found):
                yield b"".join(ids if None not in ids else [self.now[r] if i is None else i for r, i in zip(runs, ids)])

    def _learn(self, new: set[bytes]) -> None:
        now, before, ask, later = self.now, self.past.get, set(), []
        now[b""] = b""
        for run in new:
            ids = before(run)
            if ids is not None:
                now[run] = ids
                continue
            word = run.rstrip(PUNCTUATION)
            if not word.isalnum():
                ask.add(run)
                continue
            end, word, known = run[len(word):], word.lower(), True
            for part in (word, end):
                if part not in now:
                    ids = before(part)
                    if ids is None:
                        ask.add(part)
                        known = False
                    else:
                        now[part] = ids
            if known:
                now[run] = now[word] + now[end]
            elif word != run:
                later.append(run)
        self._ask(ask)
        for run in later:
            word = run.rstrip(PUNCTUATION)
            now[run] = now[word.lower()] + now[run[len(word):]]


    def _ask(self, parts: set[bytes]) -> None:
        """Ids from the tokenizer.  Plain words are asked for many at a time, as
        one text: each is one token sequence and ends with the only token that
        carries the mark of a word's end."""
        now, words = self.now, [p for p in parts if self.ends is not None and p.isalpha()]
        for at in range(0, len(words), ASKED_AT_ONCE):
            some = words[at: at + ASKED_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * np.flatnonzero(self.ends[ids]) + 4
            if len(ends) == len(some):
                raw, start = ids.tobytes(), 0
                for word, end in zip(some, ends.tolist()):
                    now[word], start = raw[start:end], end
        rest = [p for p in parts if p not in now]
        found = self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)
        now.update((part, array("I", e.ids).tobytes()) for part, e in zip(rest, found))


def _shares(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    share, held = [], 0
    for text in texts:
        share.append(text)
        held += len(text)
        if held >= size:
            yield share
            share, held = [], 0
    if share:
        yield share


_ENCODERS: dict[str, RunEncoder] = {}


def run_encoder(path: str) -> RunEncoder:
    """One encoder for all tasks of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RunEncoder(path)
    return _ENCODERS[path]


PIECE_FIELDS = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32,
    sequence_id and offset.  See the module for the method and the cases."""
    require(docs, id_col, text_col)
    path = tokenizer or default_tokenizer()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, base = run_encoder(path), OpenBins(capacity, open_bins), task_number() << 36
        for batch in batches:
            found = []
            for row, ids in enumerate(encode([t or b"" for t in byte_values(batch.column(1))])):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start: 4 * (start + capacity)]
                    found.append((len(part) // 4, row, piece, start, zlib.crc32(part)))
            found.sort(key=lambda x: -x[0])
            placed = [bins.place(x[0]) for x in found]
            if found:
                size, row, piece, start, crc = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = rows.mapInArrow(packed, f"id {id_type}, {PIECE_FIELDS}")
    return out.withColumnRenamed("id", id_col)
