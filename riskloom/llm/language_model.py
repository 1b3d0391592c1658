"""Language-model scoring.

Method: a hashed maximum-entropy model with class-factored softmax.  A word's
probability is that of its class times that of the word within its class.
Class logits are sums of weight rows for hashed features of the history: the
previous word (an n-gram feature) and the word before it (a skip feature).
The most frequent words have classes by frequency, and within such a class a
second softmax over its words has rows for hashed pairs of class and previous
word, and of class and the word before it.  All other words have a class by
their form (last byte and length); within it a word has its add-one relative
frequency, unseen words that of one occurrence less.

Counts cover all training documents.  Training passes over all of them once:
in each round the tasks start from the same weights, make gradient updates on
mini-batches of their own documents, and hand on what their rows moved by;
Spark sums the moves by row block, weighted by how often a task saw the row.
The number of training tasks is bounded, so is what one block gathers.

Scoring looks words up in a bounded dictionary of the most frequent ones; the
counts of rarer words come by a join, so hot words are never shuffled.

Cases: a null text counts as empty and has the end token alone; without
training documents every score is 0; empty tables give no rows; repeated rows
and null ids are answered row by row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, materialize, require, task_number

END = b""
#: Classes of frequent words and words in each; classes by form; words whose counts a task holds.
HEAD_CLASSES, CLASS_WORDS, FORM_CLASSES, DICTIONARY = 24, 32, 8, 65536
CLASSES = HEAD_CLASSES + FORM_CLASSES
ROW_BITS = 15
ROWS = 1 << ROW_BITS
ROUNDS, MINI_BATCH, RATE = 2, 6144, 0.5
#: Training tasks per round at most; rows of one block of what they hand on.
WORKERS, BLOCK_ROWS = 2048, 128
FLUSH_WORDS = 700_000
_START = DICTIONARY + FORM_CLASSES


def tokens_of(text: bytes | None) -> list[bytes]:
    found = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    found.append(END)
    return found


def form_class(word: bytes) -> int:
    return (31 * word[-1] + len(word)) % FORM_CLASSES if word else 0


@dataclass
class Vocabulary:
    """The most frequent words with their counts, by falling count; sizes of all classes by form."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    form_tokens: np.ndarray
    form_words: np.ndarray

    def __post_init__(self) -> None:
        head = HEAD_CLASSES * CLASS_WORDS
        self.ids = {w: k for k, w in enumerate(self.words)}
        n = len(self.words)
        self.class_of = np.array([k // CLASS_WORDS if k < head else HEAD_CLASSES + form_class(w) for k, w in enumerate(self.words)]
                                 + [HEAD_CLASSES + k for k in range(FORM_CLASSES)], np.int64)
        self.known = np.append(np.log10(self.counts + 1.0), np.zeros(FORM_CLASSES))
        self.form_rest = np.log10(self.form_tokens + self.form_words + 1.0)
        self.size = n


@dataclass
class Weights:
    classes: np.ndarray  # ROWS + 1 x CLASSES; the last row is the bias
    words: np.ndarray    # ROWS + HEAD_CLASSES x CLASS_WORDS; the last rows are each class's bias


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all documents, the end token as the empty word."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            words = list(found)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for text in byte_values(batch.column(0)):
                found.update(tokens_of(text))
            if len(found) > FLUSH_WORDS:
                yield flushed()
                found.clear()
        if found:
            yield flushed()

    rows = docs.select(docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _form_of(word: Column) -> Column:
    """``form_class`` in SQL."""
    last = F.conv(F.hex(F.substring(word.cast("binary"), F.octet_length(word), F.lit(1))), 16, 10).cast("int")
    return F.when(word == "", 0).otherwise((31 * last + F.octet_length(word)) % FORM_CLASSES)


def _step_of(n: Column) -> Column:
    return F.floor(F.log2(n) * 16)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The dictionary holds the words whose count reaches a step of a logarithmic
    scale, the lowest one that leaves at most ``DICTIONARY`` of them, and of the
    next step the words whose hash is low enough to fill the room that is left;
    so no task sorts or sends more than there is room for."""
    forms = {r.form: (r.tokens, r.words) for r in
             counts.groupBy(_form_of(F.col("word")).alias("form")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).collect()}
    room, step, share = DICTIONARY, 0, 1.0
    for r in sorted(counts.groupBy(_step_of(F.col("n")).alias("step")).count().collect(), key=lambda r: -r.step):
        step = r.step
        if r["count"] > room:
            share = max(0.0, room - 4 * room ** 0.5) / r["count"]
            break
        room -= r["count"]
    low = F.xxhash64("word") < F.lit(min(int((2 * share - 1) * 2 ** 63), 2 ** 63 - 1)).cast("long")
    wanted = (_step_of(F.col("n")) > step) | (_step_of(F.col("n")) == step) & (low if share < 1 else F.lit(True))
    frequent = sorted(counts.where(wanted).select("word", "n").collect(), key=lambda r: (-r.n, r.word))[:DICTIONARY]
    tokens, distinct = (np.array([forms.get(k, (0, 0))[i] for k in range(FORM_CLASSES)], float) for i in (0, 1))
    total, different = int(tokens.sum()), int(distinct.sum())
    for r in frequent[: HEAD_CLASSES * CLASS_WORDS]:  # these have classes of their own
        form = form_class(r.word.encode())
        tokens[form] -= r.n
        distinct[form] -= 1
    return Vocabulary([r.word.encode() for r in frequent], np.array([r.n for r in frequent], float), total, different, tokens, distinct)


def first_weights(v: Vocabulary) -> Weights:
    """Zero but for the biases, which give every word its overall frequency."""
    head = np.zeros(HEAD_CLASSES * CLASS_WORDS)
    n = min(len(head), v.size)
    head[:n] = v.counts[:n]
    head = head.reshape(HEAD_CLASSES, CLASS_WORDS)
    words = np.zeros((ROWS + HEAD_CLASSES, CLASS_WORDS), np.float32)
    words[ROWS:] = np.where(head > 0, np.log(np.maximum(head, 1) / np.maximum(head.sum(axis=1, keepdims=True), 1)), -30)
    classes = np.zeros((ROWS + 1, CLASSES), np.float32)
    share = np.concatenate([head.sum(axis=1), v.form_tokens + v.form_words + 1.0])
    classes[ROWS] = np.where(share > 0, np.log(np.maximum(share, 1) / share.sum()), -30)
    return Weights(classes, words)


def _read(v: Vocabulary, texts: list[bytes | None], tokens: int) -> Iterator[tuple]:
    """Mini-batches of whole texts' tokens: (number of each token's text, word
    id, class, previous word, the word before it, places of the tokens outside
    the dictionary, their words)."""
    get, unknown = v.ids.get, repeat(-1)
    words, line, owners, sizes = [], [], [], []
    for k, text in enumerate(texts):
        found = tokens_of(text)
        for at in range(0, len(found), 4 * tokens):
            part = found[at: at + 4 * tokens]
            # two places in front of a part hold what comes before it
            line += [get(t, v.size + form_class(t)) for t in found[at - 2: at]] if at else (_START, _START)
            line += map(get, part, unknown)
            words += part
            owners.append(k)
            sizes.append(len(part))
            if len(words) >= tokens:
                yield _batch(v, words, line, owners, sizes)
                words, line, owners, sizes = [], [], [], []
    if words:
        yield _batch(v, words, line, owners, sizes)


def _batch(v: Vocabulary, words: list[bytes], line: list[int], owners: list[int], sizes: list[int]) -> tuple:
    line, sizes = np.array(line, np.int32), np.array(sizes)
    place = np.arange(len(words)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    owner = np.repeat(np.array(owners), sizes)
    rare = np.flatnonzero(line[place] < 0)
    outside = [words[j] for j in rare.tolist()]
    line[place[rare]] = [v.size + form_class(w) for w in outside]
    word = line[place]
    return owner, word, v.class_of[word], line[place - 1], line[place - 2], rare, outside


def _row(*parts: np.ndarray) -> np.ndarray:
    found = np.zeros(len(parts[0]), np.uint32)
    for k, p in enumerate(parts):
        found = (found ^ p.astype(np.uint32)) * np.uint32((2654435761, 2246822519, 3266489917)[k])
        found ^= found >> np.uint32(15)
    return (found >> np.uint32(32 - ROW_BITS) if len(parts) == 1 else found & np.uint32(ROWS - 1)).astype(np.uint16)


def _features(cls: np.ndarray, one: np.ndarray, two: np.ndarray, head: np.ndarray) -> tuple[list, list]:
    c = cls[head]
    return ([_row(one), _row(two, np.full_like(two, 7))],
            [_row(c, one[head], np.full_like(c, 13)), _row(c, two[head], np.full_like(c, 17))])


def _softmax(logits: np.ndarray, at: np.ndarray, shares: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(natural log of the probability at the given column, all probabilities if wanted)."""
    np.clip(logits, -60, 60, out=logits)  # what float32 can sum as powers of e
    own = logits[np.arange(len(at)), at]
    p = np.exp(logits, out=logits)
    z = p @ np.ones(p.shape[1], p.dtype)
    if shares:
        p *= (1 / z)[:, None]
    return own - np.log(z), p if shares else None


def _forward(w: Weights, word: np.ndarray, cls: np.ndarray, one: np.ndarray, two: np.ndarray, shares: bool = True) -> tuple:
    head = np.flatnonzero(cls < HEAD_CLASSES)
    by_class, by_word = _features(cls, one, two, head)
    logits = w.classes[by_class[0]]
    for f in by_class[1:]:
        logits += w.classes[f]
    logits += w.classes[ROWS]
    class_log, class_p = _softmax(logits, cls, shares)
    logits = w.words[ROWS + cls[head]]
    for f in by_word:
        logits += w.words[f]
    place = word[head] % CLASS_WORDS
    word_log, word_p = _softmax(logits, place, shares)
    return head, by_class, by_word, class_log, class_p, word_log, word_p, place


def _descend(table: np.ndarray, seen: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], wrong: np.ndarray, rate: float) -> None:
    if not len(wrong):
        return
    every = np.concatenate(rows)
    many = np.bincount(every, minlength=len(table))
    at = np.flatnonzero(many)
    rank = np.zeros(len(table), np.int64)
    rank[at] = np.arange(len(at))
    place, columns = rank[every], wrong.T.astype(float)
    move = np.empty((len(columns), len(at)))
    for j, column in enumerate(columns):  # one pass per output is far cheaper than adding rows at an index
        move[j] = np.bincount(place, np.tile(column, len(rows)), len(at))
    squares[at] += np.einsum("ji,ji->i", move, move)
    table[at] -= (rate * move / np.sqrt(1 + squares[at])).T
    seen[at] += many[at]


def train(docs: DataFrame, v: Vocabulary, text_col: str = "text", rounds: int = ROUNDS, workers: int | None = None,
          rate: float = RATE) -> Weights:
    """One pass over ``docs`` in ``rounds`` disjoint parts (by hash of the text)."""
    spark = docs.sparkSession
    weights = first_weights(v)
    if not v.size:
        return weights
    most = workers or min(WORKERS, spark.sparkContext.defaultParallelism)
    rows = docs.select(docs[text_col].cast("string").alias("text"))
    shared_v = spark.sparkContext.broadcast(v)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def descended(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start = shared.value
            tables = [start.classes.copy(), start.words.copy()]
            own = Weights(*tables)
            seen, squares = ([np.zeros(len(t), np.float32) for t in tables] for _ in range(2))
            for batch in batches:
                for _, word, cls, one, two, *_ in _read(shared_v.value, byte_values(batch.column(0)), MINI_BATCH):
                    head, by_class, by_word, _, class_p, _, word_p, place = _forward(own, word, cls, one, two)
                    class_p[np.arange(len(cls)), cls] -= 1
                    _descend(tables[0], seen[0], squares[0], by_class, class_p, rate)
                    if len(head):
                        word_p[np.arange(len(head)), place] -= 1
                        _descend(tables[1], seen[1], squares[1], by_word, word_p, rate)
            for t, (table, first) in enumerate(zip(tables, (start.classes, start.words))):
                for block in range(0, ROWS, BLOCK_ROWS):
                    at = np.flatnonzero(seen[t][block: min(ROWS, block + BLOCK_ROWS)]) + block
                    if len(at):
                        many = seen[t][at]
                        yield _packed(t, block, at, many, (table[at] - first[at]) * many[:, None])

        moves = rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).coalesce(most).mapInArrow(descended, _MOVES)
        weights = _moved(weights, moves.groupBy("part", "block").applyInArrow(_summed, _MOVES))
        shared.unpersist()
    return weights


_MOVES = "part int, block int, rows binary, many binary, move binary"


def _packed(part: int, block: int, at: np.ndarray, many: np.ndarray, move: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in
         (at.astype("<i4"), many.astype("<f4"), move.astype("<f4")))], names=["part", "block", "rows", "many", "move"])


def _unpacked(rows: bytes, many: bytes, move: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.frombuffer(rows, "<i4")
    return at, np.frombuffer(many, "<f4"), np.frombuffer(move, "<f4").reshape(len(at), -1)


def _summed(group: pa.Table) -> pa.Table:
    """The moves of one block, summed over the tasks."""
    part, block = (group.column(c)[0].as_py() for c in ("part", "block"))
    width = (CLASSES, CLASS_WORDS)[part]
    many, move = np.zeros(BLOCK_ROWS), np.zeros((BLOCK_ROWS, width))
    for x in zip(*(group.column(c).to_pylist() for c in ("rows", "many", "move"))):
        at, n, m = _unpacked(*x)
        many[at - block] += n
        move[at - block] += m
    at = np.flatnonzero(many)
    return pa.Table.from_batches([_packed(part, block, at + block, many[at], move[at])])


def _moved(weights: Weights, moves: DataFrame) -> Weights:
    """The next weights; the tables' size does not depend on the corpus."""
    tables = [weights.classes.copy(), weights.words.copy()]
    for r in moves.collect():
        at, many, move = _unpacked(r.rows, r.many, r.move)
        tables[r.part][at] += move / many[:, None]
    return Weights(*tables)


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens, n_known, train_tokens, base_score and score."""
    require(docs, id_col, text_col)
    sc = docs.sparkSession.sparkContext
    shared, shared_w = sc.broadcast(v), sc.broadcast(weights)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w, rid = shared.value, shared_w.value, task_number() << 40
        for batch in batches:
            many, known, base, model = (np.zeros(batch.num_rows) for _ in range(4))
            rare_owners, rare_words = [np.zeros(0, np.int64)], []
            for owners, word, cls, one, two, rare, outside in _read(v, byte_values(batch.column(1)), MINI_BATCH):
                head, _, _, class_log, _, word_log, _, _ = _forward(w, word, cls, one, two, False)
                logs = class_log.astype(float) / np.log(10)
                logs[head] += word_log / np.log(10)
                form = cls >= HEAD_CLASSES
                logs[form] += v.known[word[form]] - v.form_rest[cls[form] - HEAD_CLASSES]
                for into, what in ((many, None), (known, (word < v.size).astype(float)), (base, v.known[word]), (model, logs)):
                    into += np.bincount(owners, what, batch.num_rows)
                rare_owners.append(owners[rare])
                rare_words += outside
            edges = np.searchsorted(np.concatenate(rare_owners), np.arange(batch.num_rows + 1)).tolist()
            own = [Counter(rare_words[a:b]) for a, b in zip(edges, edges[1:])]
            ends = np.cumsum([0, *map(len, own)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + batch.num_rows)), batch.column(0),
                 *(pa.array(x.astype(np.int64)) for x in (many, known)), pa.array(base), pa.array(model),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([t for c in own for t in c], pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([n for c in own for n in c.values()], pa.int32()))],
                names=["rid", "id", "n_tokens", "n_known", "base", "model", "rare", "times"])
            rid += batch.num_rows

    kind = rows.schema["id"].dataType.simpleString()
    found = materialize(rows.mapInArrow(scored, f"rid long, id {kind}, n_tokens long, n_known long, base double, model double, "
                                                "rare array<string>, times array<int>"), "scored")
    rare = found.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "times")).alias("w")) \
        .select("rid", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    more = rare.join(counts.select("word", "n"), "word").groupBy("rid") \
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    more_log, total = F.coalesce("more", F.lit(0.0)), float(np.log10(v.tokens + v.distinct + 1.0))
    return found.drop("rare", "times").join(more, "rid", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more_log - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("model") + more_log if v.size else F.lit(0.0)).alias("score"))


def fit_and_score(docs: DataFrame, learned_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    require(learned_from, text_col)
    counts = materialize(count_words(learned_from, text_col), "words")
    v = vocabulary(counts)
    return score(docs, counts, v, train(learned_from, v, text_col, **more), id_col, text_col)
