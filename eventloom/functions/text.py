"""Text columns: sentences, substrings, n-grams, ids, dates, places.

All patterns run in the JVM. Offsets are code points, from 0, end exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx

WHITE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, WHITE, "")


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or the empty text."""
    return F.coalesce(F.regexp_extract(text, pattern, group), F.lit(""))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether any of the words is part of the text."""
    return F.coalesce(text.rlike("|".join(map(re.escape, words))), F.lit(False))


#: Pieces of a text whose offsets are summed up together.
RUN = 64


def sentences(text: Column, end: str = lx.SENTENCE_END) -> Column:
    """array<struct<sentence, start, end>> of the non-empty pieces between single end characters.

    Offsets are summed up within runs of ``RUN`` pieces, then over the runs, so that arrays that grow
    piece by piece stay short and a long text costs time in proportion to its pieces.
    """
    rows = "array<struct<sentence:string,start:int,end:int>>"
    begin = F.struct(F.array().cast(rows).alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, piece: Column) -> Column:
        to = acc["at"] + F.length(piece)
        row = F.array(F.struct(piece.alias("sentence"), acc["at"].alias("start"), to.alias("end")))
        return F.struct(F.when(F.length(piece) > 0, F.concat(acc["out"], row)).otherwise(acc["out"]).alias("out"), (to + 1).alias("at"))

    def runs(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / RUN).cast("int")), lambda r: F.aggregate(F.slice(pieces, r * RUN + 1, F.lit(RUN)), begin, step))

    def joined(runs_: Column) -> Column:
        first = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
        starts = F.aggregate(runs_, first, lambda acc, r: F.struct(F.array_append(acc["out"], acc["at"]).alias("out"), (acc["at"] + r["at"]).alias("at")), lambda acc: acc["out"])
        moved = lambda pair: F.transform(pair["r"]["out"], lambda s: F.struct(s["sentence"].alias("sentence"), (s["start"] + pair["s"]).alias("start"), (s["end"] + pair["s"]).alias("end")))
        return F.flatten(F.transform(F.arrays_zip(runs_.alias("r"), starts.alias("s")), moved))

    let = lambda value, body: F.transform(F.array(value), body)[0]
    return let(F.split(F.coalesce(text, F.lit("")), end, -1), lambda pieces: let(runs(pieces), joined))


def simple_sentences(text: Column, least: int = 1) -> Column:
    """Stripped sentences of at least so many characters."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), lx.SIMPLE_SENTENCE_END, -1), strip), lambda s: F.length(s) >= least)


def overlaps(a: Column, b: Column) -> Column:
    """Whether one text is part of the other; never for an empty one."""
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (F.contains(a, b) | F.contains(b, a))


def grams(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def gram_overlap(a: Column, b: Column, n: int = 2) -> Column:
    """Share of the shorter text's distinct n-grams that the longer one has."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    both = F.struct(grams(short, n).alias("own"), grams(long, n).alias("other"))  # each made once
    shared = F.get(F.transform(F.array(both), lambda g: (F.size(F.array_intersect(g["own"], g["other"])) / F.size(g["own"])).cast("double")), F.lit(0))
    return F.when(F.length(short) == 0, 0.0).when(F.length(short) < n, F.contains(long, short).cast("double")).otherwise(shared)


def ids_in(text: Column, prefix: str = "D", digits: str = "{3,4}") -> Column:
    """Distinct ids (prefix and digits) in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"({prefix}\d{digits})"), 1))


def id_number(id_: Column, pattern: str = lx.ID) -> Column:
    """The id's number, or 10**9."""
    return F.coalesce(F.regexp_extract(F.coalesce(id_, F.lit("")), pattern, 1).try_cast("long"), F.lit(10**9).cast("long"))


def trailing_number(id_: Column) -> Column:
    """The digits that end an id as a number, or 10**9."""
    return F.coalesce(F.regexp_extract(F.coalesce(id_.cast("string"), F.lit("")), r"(\d+)$", 1).try_cast("long"), F.lit(10**9).cast("long"))


def first_trigger(text: Column, triggers: dict[str, list[str]] | None = None) -> Column:
    """struct<position, trigger, kind> of the leftmost trigger (of equals the first listed), or null.

    One alternation in the listed order finds it in a single scan of the text.
    """
    triggers = triggers or lx.TRIGGERS
    listed = [(word, kind) for kind, words in triggers.items() for word in words]
    pattern = "|".join(re.escape(w) for w, _ in listed)
    word = F.regexp_extract(text, f"({pattern})", 1)
    kinds = F.create_map(*[F.lit(x) for pair in dict(reversed(listed)).items() for x in pair])
    return F.when(F.coalesce(word, F.lit("")) != "", F.struct((F.instr(text, word) - 1).alias("position"), word.alias("trigger"), F.element_at(kinds, word).alias("kind")))


def _padded(year: Column | None, month: Column, day: Column) -> Column:
    pad = lambda c, n: F.lpad(c.cast("int").cast("string"), n, "0")
    return F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)) if year is not None else F.concat_ws("-", pad(month, 2), pad(day, 2))


def normal_time(raw: Column, published: Column) -> Column:
    """A date text in ISO form where its form is known; a missing year is taken from ``published``."""
    raw = strip(F.coalesce(raw, F.lit("")))
    full, part = r"^(\d{1,4})年(\d{1,2})月(\d{1,2})日$", r"^(\d{1,2})月(\d{1,2})日$"
    year = F.regexp_extract(F.coalesce(published, F.lit("")), r"\d{4}", 0)
    g = lambda p, i: F.regexp_extract(raw, p, i)
    return (
        F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), raw)
        .when(raw.rlike(full), _padded(g(full, 1), g(full, 2), g(full, 3)))
        .when(raw.rlike(part) & (year != ""), F.concat_ws("-", year, _padded(None, g(part, 1), g(part, 2))))
        .otherwise(raw)
    )


def time_in(text: Column, published: Column) -> Column:
    """The first date of a text, normalised; empty if none."""
    return normal_time(find(text, lx.TIME), published)


def location_in(text: Column) -> Column:
    """The first place name, without function characters before it (one character always stays)."""
    return F.regexp_replace(find(text, lx.LOCATION), f"^[{lx.LOCATION_LEAD}]+(?=.)", "")


def instrument_in(text: Column) -> Column:
    value = strip(find(text, lx.INSTRUMENT, 1))
    return F.when(value.rlike(r"^[\d\s]+$"), "").otherwise(value)


def manner_in(text: Column) -> Column:
    return strip(find(text, lx.MANNER, 1))
