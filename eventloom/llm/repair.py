r"""Conversation structure repair (operator 12).

The cheapest edits that give a conversation's roles the form ``(s?(ua)+)?`` (initials of system, user and
assistant): keep a row (0), give it another role (2), delete it (3; blank rows and rows seen earlier must go), insert
an empty user or assistant row (2); a truncated row that isn't deleted adds 1. Of equally cheap lists of edits the one
whose initials (D, I, K, R) are ASCII-least is taken.

The state between two rows is what the last row out was: nothing yet, s, u or a. The cost from a row on to the end is a
vector of four numbers, one for each state, computed backward. Those vectors are stored only at checkpoints, the ends of
blocks of about the square root of the conversation's rows (``BLOCK`` at least); walking forward, a block recomputes its own vectors from
its checkpoint and takes, row by row, the least initial among the edits that are tight, which stay on a cheapest path.

Blocks are rows of a table, so a conversation with a third of all rows is worked on by many tasks: each block first
gives the min-plus matrix from its end to its beginning; a fold of a conversation's matrices, a square root of its
rows, gives the checkpoints; each block is walked from each state that it may be entered in, and a second fold finds
which of them it is. Only what is one value by contract runs through a conversation in order: its digest, in a
stream that holds no more than a row and the conversation's edits, a byte for each row.

Shuffles: rows to ranges of (conversation, turn), which may cut a conversation anywhere; digests of (role, text) to find
rows seen earlier, pre-aggregated; a byte for each row to its block; rows and walked blocks to the conversation's stream. Memory: a block, or
a square root of the longest conversation's rows; a stream holds one row's text and one conversation's edits.

Defined results: a null role or text is one space. Rows go by turn, nulls first; rows of one turn by role, then
by a digest of role and text. A row's role counts by its first character; roles that begin with none of s, u and a can't be kept, nor can an s that isn't first.
Very long texts pass whole. Repeated rows are rows seen earlier. A null conversation id is a conversation of its own. An empty table gives an
empty result; of a conversation without rows, where its id is asked for, everything is zero, the edits are empty and the
digest is that of the empty string. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm._shared import kept, small_or_shuffled
from eventloom.operators.numbering import numbered

#: Rows of a block at least.
BLOCK = 1024
#: Conversations, or rows seen earlier, beyond which they are joined by a shuffle.
MOST_BROADCAST = 200_000
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The row that must follow each state, and the edits that make one: insert, rerole.
NEXT = (USER, USER, ASSISTANT, USER)
INSERTS, REROLES = {USER: "x", ASSISTANT: "y"}, {USER: "U", ASSISTANT: "A"}
NAMES = {"x": "user", "U": "user", "y": "assistant", "A": "assistant"}
INITIALS = str.maketrans("xyUA", "IIRR")
NEVER = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)
BLANK = r"^[\x20\x09-\x0D]*$"
CLOSED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_CHUNK = re.compile("[xy]*[DKUA]")


def _classes() -> dict[str, tuple[int | None, bool, bool]]:
    """A row's class by letter: the role that it may be kept in, whether it must go, whether it is truncated.

    Letters: s, u, a and o for other roles; capitals if truncated; b and d for blank and seen rows, whose roles don't matter.
    """
    roles = {"s": SYSTEM, "u": USER, "a": ASSISTANT, "o": None}
    return {k: (r, False, False) for k, r in roles.items()} | {k.upper(): (r, False, True) for k, r in roles.items()} | {k: (None, True, False) for k in "bd"}


CLASSES = _classes()


def _kept_in(state: int, role: int | None) -> bool:
    """Whether a row of ``role`` may follow ``state``."""
    return role == NEXT[state] or (role == SYSTEM and state == START)


def back(row: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost from before a row of class ``row``, by state, given that from behind it."""
    role, must_go, cut = CLASSES[row]
    extra = CUT if cut else 0
    base = [DELETE + after[q] for q in range(4)]
    if not must_go:
        for q in range(4):
            if _kept_in(q, role):
                base[q] = min(base[q], KEEP + extra + after[role])
            base[q] = min(base[q], REROLE + extra + after[NEXT[q]])
    user, assistant = min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER])
    return min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user, assistant


def through(rows: str) -> list[tuple[int, ...]]:
    """The min-plus matrix of a block: [entered in][left in], the least cost between."""
    columns = []
    for leave in range(4):
        v = tuple(0 if q == leave else NEVER for q in range(4))
        v = _inserted(v)
        for row in reversed(rows):
            v = tuple(min(x, NEVER) for x in back(row, v))
        columns.append(v)
    return [tuple(columns[leave][enter] for leave in range(4)) for enter in range(4)]


def _inserted(v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs by state if rows may be inserted first."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


def walk(rows: str, checkpoint: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least tight edits of a block entered in ``state``, and the state that it is left in.

    Rows behind the last one are inserted only in the conversation's last block.
    """
    costs = [checkpoint]
    for row in reversed(rows):
        costs.append(back(row, costs[-1]))
    out = []
    for row in rows:
        here = costs.pop()
        after = costs[-1]
        role, must_go, cut = CLASSES[row]
        extra = CUT if cut else 0
        while True:
            if here[state] == DELETE + after[state]:
                out.append("D")
                break
            follow = NEXT[state]
            if here[state] == INSERT + here[follow]:
                out.append(INSERTS[follow])
                state = follow
            elif not must_go and _kept_in(state, role) and here[state] == KEEP + extra + after[role]:
                out.append("K")
                state = role
                break
            else:
                out.append(REROLES[follow])
                state = follow
                break
    while last and state not in (START, ASSISTANT):
        state = NEXT[state]
        out.append(INSERTS[state])
    return "".join(out), state


# --- tables ------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes out its full stops and marks, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), fault.alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_times")).drop("_times")


def _key(conv_id: str = "conv_id") -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def placed(turns: DataFrame) -> DataFrame:
    """(_key, conv_id, turn, role, text, place from 0 in the conversation, n rows of it, fault), written."""
    space = F.lit(" ")
    rows = turns.select(_key().alias("_key"), "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.withColumn("_seen", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    base = numbered(rows, ["_key", F.asc_nulls_first("turn"), "role", "_seen"], "_at")
    base = kept(base, "repair-rows")
    # written, so that the joins have plain shuffles below them, which Spark can split at a hot conversation
    spans = kept(base.groupBy("_key").agg(F.min("_at").alias("_from"), F.count("*").alias("n")), "repair-spans")
    first = kept(base.groupBy("_key", "_seen").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repair-seen")
    met = base.join(small_or_shuffled(first, first.count(), MOST_BROADCAST), ["_key", "_seen"], "left").join(small_or_shuffled(spans, spans.count(), MOST_BROADCAST), "_key")
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(F.col("_at") > F.col("_first"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return kept(met.select("_key", "conv_id", "turn", "role", "text", (F.col("_at") - F.col("_from")).alias("place"), "n", fault.alias("fault")), "repair-placed")


def blocks_of(rows: DataFrame, least: int | None = None) -> DataFrame:
    """(_key, block, first, blocks, classes): a letter for each row of ``placed``, some square root of a conversation's rows together."""
    size = F.greatest(F.lit(least or BLOCK), F.ceil(F.sqrt("n")).cast("long"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault") == "blank", "b").when(F.col("fault") == "duplicate", "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    cut = rows.select("_key", F.floor(F.col("place") / size).alias("block"), F.ceil(F.col("n") / size).alias("blocks"), "place", letter.alias("c"))
    made = cut.groupBy("_key", "block").agg(F.min("place").alias("first"), F.first("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("place", "c"))).alias("rows"))
    return made.select("_key", "block", "first", "blocks", F.array_join(F.transform("rows", lambda r: r["c"]), "").alias("classes"))


def _mapped(df: DataFrame, columns: list[str], made: T.DataType, f) -> DataFrame:
    """``df`` with ``made``, what ``f`` gives of ``columns`` row by row."""
    schema = T.StructType([*df.schema.fields, T.StructField("made", made)])
    names = [*df.columns, "made"]
    at = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(made)
        for batch in batches:
            values = zip(*(batch.column(i).to_pylist() for i in at), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f(*v) for v in values], kind)], names=names)

    return df.mapInArrow(run, schema)


_VECTOR = T.ArrayType(T.LongType())


def _checkpoints(matrices: list[list[int]]) -> list[list[int]]:
    """The cost vector at each block's end, from the blocks' matrices in order."""
    out, v = [], END
    for m in reversed(matrices):
        out.append(list(v))
        v = tuple(min(m[4 * enter + leave] + v[leave] for leave in range(4)) for enter in range(4))
    return out[::-1]


def _entered(exits: list[list[int]]) -> list[int]:
    """The state that each block is entered in, from the state that each leaves in by each state entered in."""
    out, state = [], START
    for by in exits:
        out.append(state)
        state = by[state]
    return out


def _folded(blocks: DataFrame, column: str, made: T.DataType, f) -> DataFrame:
    """(_key, block, made): ``f`` of a conversation's ``column`` in block order, an entry for each block."""
    together = blocks.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("block", column))).alias("all"))
    lists = together.select("_key", F.transform("all", lambda x: x["block"]).alias("ids"), F.transform("all", lambda x: x[column]).alias("values"))
    done = _mapped(lists, ["values"], T.ArrayType(made), f)
    return done.select("_key", F.explode(F.arrays_zip("ids", "made")).alias("x")).select("_key", F.col("x.ids").alias("block"), F.col("x.made").alias("made"))


def walked(blocks: DataFrame) -> DataFrame:
    """(_key, first, classes, edits): the edits of each block; letters x, y insert user, assistant, U, A rerole, D, K."""
    text = T.StringType()
    whole = _mapped(blocks.where("blocks = 1"), ["classes"], text, lambda c: walk(c, END, START, True)[0])
    many = kept(blocks.where("blocks > 1"), "repair-blocks")
    matrices = _mapped(many.select("_key", "block", "classes"), ["classes"], _VECTOR, lambda c: [x for row in through(c) for x in row])
    ends = _folded(matrices.select("_key", "block", F.col("made").alias("matrix")), "matrix", _VECTOR, _checkpoints)
    ended = many.join(ends.withColumnRenamed("made", "checkpoint"), ["_key", "block"])
    walks = T.ArrayType(T.StructType([T.StructField("edits", text), T.StructField("state", T.LongType())]))

    def each(classes: str, checkpoint: list[int], block: int, blocks_: int) -> list[dict]:
        ways = (walk(classes, tuple(checkpoint), q, block + 1 == blocks_) for q in range(4))
        return [{"edits": e, "state": s} for e, s in ways]

    four = kept(_mapped(ended, ["classes", "checkpoint", "block", "blocks"], walks, each).withColumnRenamed("made", "ways"), "repair-ways")
    entered = _folded(four.select("_key", "block", F.transform("ways", lambda w: w["state"]).alias("exits")), "exits", T.LongType(), _entered)
    taken = four.join(entered, ["_key", "block"]).select("_key", "first", "classes", F.get("ways", F.col("made").cast("int"))["edits"].alias("edits"))
    return whole.select("_key", "first", "classes", F.col("made").alias("edits")).unionByName(taken)


def _streamed(rows: DataFrame, edits: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids, walked blocks and rows of each conversation together and in order; one exchange."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    kind = rows.schema["conv_id"].dataType
    turn = rows.schema["turn"].dataType
    at = lambda place, what: [place.cast("long").alias("_place"), F.lit(what).alias("_what")]
    heads = ids.select(_key().alias("_key"), *at(F.lit(-1), 0), "conv_id", none("turn", turn), none("role", "string"), none("text", "string"))
    walks = edits.select("_key", *at(F.col("first"), 1), none("conv_id", kind), none("turn", turn), F.col("classes").alias("role"), F.col("edits").alias("text"))
    body = rows.select("_key", *at(F.col("place"), 2), none("conv_id", kind), "turn", "role", "text")
    return heads.unionByName(walks).unionByName(body).repartition("_key").sortWithinPartitions("_key", "_place", "_what")


class _Conversation:
    """What a stream keeps of the conversation that passes."""

    def __init__(self, conv_id):
        self.conv_id, self.edits, self.classes = conv_id, [], []
        self.turns: list = [None, None, 0]
        self.last, self.illegal, self.lines = None, 0, 0
        self.chunks: Iterator = iter(())
        self.rest = ""
        self.digest = hashlib.sha256()

    def begin_block(self, classes: str, edits: str) -> None:
        self.edits.append(edits)
        self.classes.append(classes)
        self.chunks, self.rest = _CHUNK.finditer(edits), edits[len(edits.rstrip("xy")) :]

    def line(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update((("\n" if self.lines else "") + role + ":").encode())
        self.digest.update(text.encode())
        self.lines += 1
        return role, text

    def row(self, turn, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The rows that stand in a row's place: (edit, role, text)."""
        if turn is not None:
            low, high, distinct = self.turns
            self.turns = [turn if low is None else low, turn, distinct + (turn != high)]
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        for edit in next(self.chunks)[0]:
            if edit in "xy":
                yield "I", *self.line(NAMES[edit], "")
            elif edit == "K":
                yield "K", *self.line(role, text)
            elif edit in "UA":
                yield "R", *self.line(NAMES[edit], text)

    def finish(self) -> Iterator[tuple[str, str, str]]:
        """Rows inserted behind the last one."""
        for edit in self.rest:
            yield "I", *self.line(NAMES[edit], "")

    def report(self) -> tuple:
        edits, classes = "".join(self.edits), "".join(self.classes)
        low, high, distinct = self.turns
        gaps = high - low + 1 - distinct if distinct else 0
        own = edits.translate({ord("x"): None, ord("y"): None})
        cut = sum(c.isupper() and e != "D" for c, e in zip(classes, own, strict=True))
        cost = REROLE * (own.count("U") + own.count("A")) + DELETE * own.count("D") + INSERT * (len(edits) - len(own)) + CUT * cut
        truncated = sum(map(str.isupper, classes))
        return self.conv_id, gaps, classes.count("b"), classes.count("d"), truncated, self.illegal, cost, edits.translate(INITIALS), self.digest.hexdigest()


def _run(stream: DataFrame, fields: list[T.StructField], per_row: bool) -> DataFrame:
    """Reports of the stream's conversations, or their repaired rows."""
    conv = T.StructField("conv_id", stream.schema["conv_id"].dataType)
    names = ["conv_id", *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(conv.dataType), *[to_arrow_type(f.dataType) for f in fields]]
        out: list[tuple] = []
        held, now, place = 0, None, 0

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def take(rows: Iterator[tuple[str, str, str]]) -> int:
            nonlocal place
            size = 0
            for row in rows:
                if per_row:
                    out.append((now.conv_id, place, *row))
                    size += len(row[2]) + 50
                place += 1
            return size

        def finish() -> int:
            size = take(now.finish())
            if not per_row:
                out.append(now.report())
                size += len(out[-1][-2]) + 100
            return size

        for batch in batches:
            for at in range(batch.num_rows):
                _, _, what, conv_id, turn, role, text = (batch.column(c)[at].as_py() for c in range(7))
                if what == 0:
                    held += finish() if now else 0
                    now, place = _Conversation(conv_id), 0
                elif what == 1:
                    now.begin_block(role, text)
                else:
                    held += take(now.row(turn, role, text))
                if held >= 4 << 20 or len(out) >= 10_000:
                    yield passed()
                    out.clear()
                    held = 0
        if now:
            finish()
        if out:
            yield passed()

    return stream.mapInArrow(run, T.StructType([conv, *fields]))


def _stream_of(turns: DataFrame, ids: DataFrame | None, least: int | None) -> DataFrame:
    rows = placed(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    edits = kept(walked(blocks_of(rows, least)), "repair-edits")
    return _streamed(rows, edits, (rows if ids is None else ids).select("conv_id").distinct())


def report(turns: DataFrame, ids: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """A row for each conversation of ``turns`` (conv_id, turn, role, text), or of ``ids`` (conv_id), which must hold them all.

    gaps (turns missing between the first and the last), rows by their first fault (blank, duplicate, truncated), illegal neighbours,
    the edits' cost and initials, and the digest of the repaired rows.
    """
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [T.StructField(c, T.LongType()) for c in longs] + [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]
    return _run(_stream_of(turns, ids, least), fields, False)


def repaired(turns: DataFrame, least: int | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, row by row."""
    fields = [T.StructField("place", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]
    return _run(_stream_of(turns, None, least), fields, True)
