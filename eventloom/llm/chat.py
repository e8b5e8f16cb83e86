r"""Chat formatting from event logs (operator 8).

A log row is an event of one conversation. Logs are dealt out by conversation, sorted by sequence
within partitions, and folded as they stream by: ``message`` begins a message, ``delta`` appends
to the last one, ``edit`` replaces the text of message ``target`` and ``regenerate`` drops message
``target`` and all after it; targets count from 0, negative ones from the last message back (-1).
What is left is rendered with a template

    ### role: text</turn>\n

in which ``\``, ``###`` and ``</turn>`` inside texts (and ``:`` and line feeds inside roles) are
escaped by a backslash, so ``parse`` gives back every role and text. The loss mask holds the
spans of the assistant's texts in the output, in code points. A task holds the messages of one
conversation, and finished ones up to ``FLUSH`` characters; the rest streams through the
partition. One conversation is folded in one task, however long it is. ``parse`` looks at marks
only, so its memory is a small multiple of the text.

Null texts and roles are empty ones. Events with equal sequence are ordered by role, then text.
An event that targets a missing message, or a delta before any message, is ignored. A null
conversation id is a conversation of its own. An empty log gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "### ", "</turn>"
#: Characters of finished conversations that a task holds before it passes them on.
FLUSH = 4 << 20
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_BACK = re.compile(r"\\(\\|###|</turn>|:|\n)")
_ROLE_STOP = re.compile(r"\\(?:\\|###|</turn>|:|\n)|: ")
_TEXT_STOP = re.compile(r"\\(?:\\|###|</turn>)|</turn>")


def escape(text: str) -> str:
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(messages: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) messages, and the spans whose tokens are learnt."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{BEGIN}{_ROLE.sub(lambda m: chr(92) + m[0], role)}: ", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def _stop(marks: re.Pattern, formatted: str, at: int) -> tuple[int, int]:
    """Where the first mark from ``at`` that no backslash escapes begins and ends."""
    for m in marks.finditer(formatted, at):
        if m[0][0] != "\\":
            return m.span()
    raise ValueError(f"a turn without its end at {at}")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that ``render`` was given; a text that ``render`` hasn't made is an error."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(BEGIN, at):
            raise ValueError(f"no turn begins at {at}")
        role_end, text_at = _stop(_ROLE_STOP, formatted, at + len(BEGIN))
        text_end, after = _stop(_TEXT_STOP, formatted, text_at)
        turns.append((unescape(formatted[at + len(BEGIN) : role_end]), unescape(formatted[text_at:text_end])))
        at = after + 1
    return turns


def step(messages: list[list], event: str, target: int | None, role: str | None, text: str | None) -> None:
    """Takes one event into ``messages``, a list of [role, parts of the text]."""
    if event == "message":
        messages.append([role or "", [text or ""]])
    elif event == "delta" and messages:
        messages[-1][1].append(text or "")
    elif event in ("edit", "regenerate") and target is not None and -len(messages) <= target < len(messages):
        if event == "edit":
            messages[target][1] = [text or ""]
        else:
            del messages[target:]


def fold(events: Iterator[tuple[str, int | None, str | None, str | None]]) -> list[tuple[str, str]]:
    """The final messages of one conversation's sorted (event, target, role, text) events."""
    messages: list[list] = []
    for event in events:
        step(messages, *event)
    return [(role, "".join(parts)) for role, parts in messages]


def events_of(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """A log that ends in a table of finished turns (conv_id, turn, role, text).

    A learnt turn is begun, streamed up to its half and regenerated, then streamed whole in two
    deltas; any other is typed, and edited from its first half to the whole text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.ceil(F.length(text) / 2).cast("int")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, half)
    back = F.lit(-1)

    def rows(*events: tuple) -> Column:
        return F.array(*[F.struct(F.lit(e).alias("event"), (back if t else F.lit(None)).cast("int").alias("target"), x.alias("text")) for e, t, x in events])

    none = F.lit("")
    streamed = rows(("message", 0, none), ("delta", 0, head), ("regenerate", 1, none), ("message", 0, none), ("delta", 0, head), ("delta", 0, tail))
    typed = rows(("message", 0, head), ("edit", 1, text))
    key = F.struct("turn", F.col("role").alias("of"), F.xxhash64(text).alias("row"), F.monotonically_increasing_id().alias("no")).alias("key")
    made = turns.select("conv_id", key, F.col("role"), F.posexplode(F.when(F.col("role") == learn, streamed).otherwise(typed)).alias("part", "e"))
    return made.select("conv_id", F.struct("key", "part").alias("seq"), "e.event", "e.target", "role", "e.text")


def format_conversations(log: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, end>>) of a log (conv_id, seq, event, target, role, text)."""
    kind = log.schema["conv_id"].dataType.simpleString()
    dealt = log.select("conv_id", "seq", "event", "target", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text").drop("seq")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        messages: list[list] = []
        conv, begun, kind_of, held = None, False, pa.int64(), 0

        def passed() -> pa.RecordBatch:
            loss = pa.array([[{"start": a, "end": b} for a, b in m[2]] for m in made], spans)
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], kind_of), pa.array([m[1] for m in made], pa.string()), loss], names=["conv_id", "formatted", "loss"])

        def finish() -> int:
            text, learnt = render([(role, "".join(parts)) for role, parts in messages], learn)
            made.append((conv, text, learnt))
            return len(text)

        for batch in batches:
            kind_of = batch.schema.field(0).type
            for row in range(batch.num_rows):
                of, *event = (batch.column(c)[row].as_py() for c in range(5))
                if not begun or of != conv:
                    if begun:
                        held += finish()
                    if held >= FLUSH or len(made) >= 1000:
                        yield passed()
                        made, held = [], 0
                    conv, messages, begun = of, [], True
                step(messages, *event)
        if begun:
            finish()
            yield passed()

    return dealt.mapInArrow(run, f"conv_id {kind}, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) parsed from the output."""
    import hashlib

    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                text, spans = batch.column(1)[at].as_py(), batch.column(2)[at].as_py()
                turns = parse(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
