"""Chat formatting by quotation linking.

Method: the lines of a message are parsed by quote level (the number of quote
marks in front); each run of lines of one level is a passage.  A message's own
text is level 0.  Own texts and quoted passages are cut into units - the whole,
paragraphs, lines and sentences -, normalised (letters and digits only, folded
case) and hashed.  Hashes of quoted units are joined to those of own units
within the conversation; the newest earlier message with that unit is the
original.  A message replies to the original of its first linked passage of the
lowest level, else to the message before it.  Quoted lines and the lines that
introduce them go; what is left is ordered by reply: each thread (a message
that links to none, and all that link to it through others) in one piece, in
the order of its first message, replies after what they reply to.

No group is gathered: the newest earlier original, the message before and the
place in a conversation come from two-step prefix scans over bounded blocks,
so that one conversation or one passage may hold any share of all rows.

Cases: a null text counts as empty and stays in its place; null conversations
are one conversation; a null turn comes last; repeated rows are messages of
their own, in any order; a passage that nobody wrote before stays unlinked and
goes all the same; quotes of a later message do not link; sentences of fewer
than ``least_chars`` letters and digits do not link, such lines only where nothing longer does; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, require, with_row_ids

LEAST_CHARS = 8
#: Rows of one key that a window sorts at once.
BLOCK_TURNS = 1024

_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
# How mail and forum programs introduce a quote.
_INTRODUCES = re.compile(r"[^\n]{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió|ha scritto)\b[^\n]{0,40}:\s*\Z", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W_]+")


def passages(text: str) -> list[tuple[int, list[str]]]:
    """Runs of lines of one quote level, in order: (level, lines without marks)."""
    found: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level, rest = (m[1].count(">"), line[m.end():]) if m else (0, line)
        if found and found[-1][0] == level:
            found[-1][1].append(rest)
        else:
            found.append((level, [rest]))
    return found


def own_text(found: list[tuple[int, list[str]]]) -> str:
    """The text of level 0, without the lines that introduce a quote."""
    kept = []
    for k, (level, lines) in enumerate(found):
        if level:
            continue
        if k + 1 < len(found):
            lines = list(lines)
            while lines and not lines[-1].strip():
                lines.pop()
            if lines and _INTRODUCES.match(lines[-1]):
                lines.pop()
        kept.append("\n".join(lines).strip("\n"))
    return "\n".join(t for t in kept if t.strip()).strip() if any(level for level, _ in found) else "\n".join("\n".join(x) for _, x in found)


def units(lines: list[str], least: int) -> dict[int, int]:
    """Hash of each unit -> its rank: 0 the whole, 1 paragraphs, 2 lines, 3 sentences of
    at least ``least`` letters and digits, 4 shorter paragraphs and lines."""
    from xxhash import xxh64_intdigest

    out: dict[int, int] = {}
    whole = "\n".join(lines)
    paragraphs = re.split(r"\n[ \t]*\n", whole)
    for rank, parts in enumerate(([whole], paragraphs, lines, [s for p in paragraphs for s in _SENTENCE.split(p)])):
        for part in parts:
            plain = "".join(_WORD.findall(part.casefold()))
            if not rank and not plain:
                plain = "".join(part.split())  # signs alone, as a whole only
            if plain and (rank < 3 or len(plain) >= least):
                out.setdefault(xxh64_intdigest(plain.encode()) - (1 << 63), rank if not rank or len(plain) >= least else 4)
    return out


def _scope(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("null"))


def last_before(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last value that is not null in an earlier row of the
    key; ``order`` (a struct of turn and row) orders them.  Blocks of turns are
    scanned on their own and take over what the blocks before them hold."""
    block = F.floor(F.col(f"{order}.turn") / BLOCK_TURNS)
    rows = rows.withColumns({"_block": block, "_value": value})
    # a row without a value comes before one with a value at the same place: no message is its own original
    within = Window.partitionBy(*keys, "_block").orderBy(order, F.col("_value").isNotNull())
    rows = rows.withColumn("_own", F.last("_value", True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy(*keys, "_block").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct(order, "_value"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end._value", True).over(before)).select(*keys, "_block", "_before")
    return rows.join(ends, [*keys, "_block"]).withColumn(name, F.coalesce("_own", "_before")).drop("_block", "_value", "_own", "_before")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
         least_chars: int = LEAST_CHARS) -> DataFrame:
    """Per message: conversation, turn, role, position, parent_turn, thread_turn,
    text without quotes, n_quoted and n_linked passages."""
    require(messages, conv_col, turn_col, role_col, text_col)
    rows = messages.select(messages[conv_col].alias("conv"), messages[turn_col].cast("long").alias("turn"), messages[role_col].alias("role"),
                           messages[text_col].cast("string").alias("text"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                found = passages(text or "")
                clean = own_text(found)
                quoted = [(level, lines) for level, lines in found if level and any(x.strip() for x in lines)]
                keys = [{"hash": h, "level": 0, "passage": -1, "rank": r} for h, r in units(clean.split("\n"), least_chars).items()]
                for k, (level, lines) in enumerate(quoted):
                    keys += [{"hash": h, "level": level, "passage": k, "rank": r} for h, r in units(lines, least_chars).items()]
                out.append((clean if text is not None else None, len(quoted), keys))
            texts, many, keys = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(many, pa.int32()), pa.array(keys, _KEYS)],
                                             names=["conv", "turn", "role", "text", "n_quoted", "keys"])

    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("conv", "turn", "role"))
    found = rows.mapInArrow(parsed, f"{fields}, text string, n_quoted int, "
                                    "keys array<struct<hash: long, level: int, passage: int, rank: int>>")
    found = materialize(with_row_ids(found), "messages").withColumns({
        "scope": _scope(F.col("conv")), "at": F.struct(F.coalesce("turn", F.lit(1 << 62) + F.col("rid")).alias("turn"), F.col("rid"))})
    linked = materialize(_links(found), "links")
    narrow = found.select("scope", "at", "rid", "turn", "n_quoted")
    narrow = last_before(narrow, ["scope"], "at", F.col("at"), "previous").join(linked, "rid", "left")
    tree = materialize(narrow.select("scope", "at", "rid", F.coalesce("original", "previous").alias("parent"), "original",
                                     F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "replies")
    placed = _placed(_threads(tree))
    turn_of = lambda c: F.when(F.col(f"{c}.turn") < (1 << 62), F.col(f"{c}.turn"))
    return found.drop("scope", "at").join(placed, "rid").select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "position",
        turn_of("parent").alias("parent_turn"), turn_of("thread").alias("thread_turn"), F.col("text").alias(text_col), "n_quoted", "n_linked")


_KEYS = pa.list_(pa.struct([("hash", pa.int64()), ("level", pa.int32()), ("passage", pa.int32()), ("rank", pa.int32())]))


def _links(found: DataFrame) -> DataFrame:
    """(rid, original, n_linked) of the messages that have a linked passage."""
    quoted = found.where("n_quoted > 0").select("scope").distinct()  # only there originals matter
    keys = found.select("scope", "at", "rid", "keys").join(quoted, "scope", "left_semi") \
        .select("scope", "at", "rid", F.explode("keys").alias("k")).select("scope", "at", "rid", "k.*")
    seen = last_before(keys, ["scope", "hash"], "at", F.when(F.col("level") == 0, F.col("at")), "original")
    best = seen.where("level > 0 and original is not null").groupBy("rid", "passage") \
        .agg(F.min("level").alias("level"), F.min_by("original", F.struct("rank", -F.col("original.turn"), "hash")).alias("original"))
    return best.groupBy("rid").agg(F.min_by("original", F.struct("level", "passage")).alias("original"), F.count(F.lit(1)).cast("int").alias("n_linked"))


def _threads(tree: DataFrame) -> DataFrame:
    """``tree`` with the first message of each message's thread, by doubling the
    links of the messages that have one (a logarithm of the longest chain)."""
    linked = tree.where("original is not null").select("rid", F.col("original").alias("up"))
    linked = materialize(linked, "up")
    for _ in range(64):  # a reply's original is always earlier, so chains end
        higher = linked.select(F.col("rid").alias("next"), F.col("up").alias("higher"))
        step = linked.join(higher, F.col("up.rid") == F.col("next"), "left")
        if step.where("higher is not null").isEmpty():
            break
        linked = materialize(step.select("rid", F.coalesce("higher", "up").alias("up")), "up")
    else:
        raise RuntimeError("replies form a cycle")
    return tree.join(linked, "rid", "left").withColumn("thread", F.coalesce("up", "at")).drop("up", "original")


def _placed(tree: DataFrame) -> DataFrame:
    """``tree`` with the place of each message in its conversation: a range sort,
    a count in each part of a conversation, and what the parts before hold."""
    ranged = tree.repartitionByRange("scope", "thread", "at").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    place = F.row_number().over(Window.partitionBy("part", "scope").orderBy("thread", "at"))
    before = F.sum("count").over(Window.partitionBy("scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy("part", "scope").count().withColumn("before", F.coalesce(before, F.lit(0))).drop("count")
    return ranged.withColumn("place", place).join(parts, ["part", "scope"]) \
        .select("rid", "parent", "thread", "n_linked", (F.col("place") + F.col("before") - 1).alias("position"))


def formatted(linked: DataFrame, role_col: str = "role", text_col: str = "text", name: str = "formatted") -> DataFrame:
    """Each message as a turn of a chat, for texts that follow each other by ``position``."""
    role, text = F.coalesce(F.col(role_col), F.lit("user")), F.coalesce(F.col(text_col), F.lit(""))
    return linked.withColumn(name, F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n")))
