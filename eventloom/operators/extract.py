"""Events from documents: sentences, triggers, times, places and arguments, by rules."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.functions import text as tx
from eventloom.functions.numbers import exact_round
from eventloom.operators.numbering import numbered

TOKENS = "array<struct<word:string,flag:string,start:int,end:int>>"
MODEL_NAMES = ("pai", "pai-extractor", "ner", "seq2seq")


def tokens(text: Column) -> Column:
    """Words with part-of-speech flags and offsets; none where no tagger is installed."""
    if importlib.util.find_spec("jieba") is None:
        return F.array().cast(TOKENS)
    import pandas as pd

    @F.pandas_udf(TOKENS)
    def tagged(texts: pd.Series) -> pd.Series:
        import jieba.posseg

        def one(t: str | None) -> list[dict]:
            at, out = 0, []
            for w in jieba.posseg.cut(t or ""):
                found = (t or "").find(w.word, at)
                at = at if found < 0 else found
                out.append({"word": w.word, "flag": w.flag, "start": at, "end": at + len(w.word)})
                at += len(w.word)
            return out

        return texts.map(one)

    return tagged(text)


def trigger_index(words: Column, position: Column) -> Column:
    """Index (from 0) of the token that holds the position, or -1."""
    return F.array_position(F.transform(words, lambda t: (t["start"] <= position) & (position < t["end"])), True).cast("int") - 1


def _first_noun(words: Column) -> Column:
    """The first noun of the tokens before a sentence boundary; skipped words don't count."""
    stop = F.array_position(F.transform(words, lambda t: t["word"].isin(list("。！？；\n"))), True).cast("int")
    near = F.when(stop > 0, F.slice(words, F.lit(1), stop - 1)).otherwise(words)
    nouns = F.filter(near, lambda t: (t["flag"].startswith("n") | (t["flag"] == "j")) & (t["word"] != "") & ~t["word"].isin(lx.SKIPPED_NOUNS))
    return F.coalesce(F.try_element_at(nouns, F.lit(1))["word"], F.lit(""))


def noun_before(words: Column, index: Column, span: int = 8) -> Column:
    """The nearest noun among the ``span`` tokens before the index."""
    left = F.greatest(index - span, F.lit(0))
    return F.when(index > 0, _first_noun(F.reverse(F.slice(words, left + 1, index - left)))).otherwise("")


def noun_after(words: Column, index: Column, span: int = 8) -> Column:
    return F.when(index >= 0, _first_noun(F.slice(words, index + 2, F.lit(span)))).otherwise("")


def _pair(role: str, value: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), value.alias("value"))


def arguments(sentence: Column, position: Column, time: Column, location: Column) -> Column:
    """time, location, subject, object, instrument and manner, those that aren't empty."""
    words = tokens(sentence)
    index = trigger_index(words, position)
    pairs = F.array(
        _pair("time", time), _pair("location", location), _pair("subject", noun_before(words, index)), _pair("object", noun_after(words, index)),
        _pair("instrument", tx.instrument_in(sentence)), _pair("manner", tx.manner_in(sentence)),
    )
    return F.filter(pairs, lambda a: a["value"] != "")


def events(docs: DataFrame, triggers: dict[str, list[str]] | None = None, order: list | None = None, within: list | None = None, model: str = "rule", extractor: Callable | None = None) -> DataFrame:
    """At most one event for each sentence of ``docs`` (doc_id, text, publish_time).

    Ids are numbered by ``order`` (default doc_id) and sentence, over all rows (by ranges, see
    ``numbering``) or ``within`` the given columns.
    """
    if model in MODEL_NAMES:
        if extractor is None:
            raise FileNotFoundError(f"model {model!r} has no weights here; pass an extractor that maps (doc_id, sentence) rows to events")
        return extractor(docs)
    if model != "rule":
        raise ValueError(f"unknown extraction model: {model}")
    sentences = docs.withColumn("_s", F.explode(tx.sentences(F.col("text")))).withColumn("_t", tx.first_trigger(F.col("_s.sentence"), triggers)).where(F.col("_t").isNotNull())
    timed = sentences.withColumn("time", tx.time_in(F.col("_s.sentence"), F.col("publish_time"))).withColumn("location", tx.location_in(F.col("_s.sentence")))
    order = [*(order or ["doc_id"]), "_s.start"]
    hits = F.when(F.col("time") != "", 0.1).otherwise(0.0) + F.when(F.col("location") != "", 0.1).otherwise(0.0)
    if within:
        placed = timed.withColumn("node_ord", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))
    else:
        placed = numbered(timed, order, "node_ord")
    return placed.select(
        *(within or []), "node_ord", F.format_string("E%03d", F.col("node_ord")).alias("event_id"), "doc_id",
        F.col("_t.kind").alias("event_type"), F.col("_t.trigger").alias("trigger"), F.col("_s.sentence").alias("mention"),
        arguments(F.col("_s.sentence"), F.col("_t.position"), F.col("time"), F.col("location")).alias("arguments"),
        "time", "location", F.array("_s.start", "_s.end").alias("char_offset"),
        exact_round(F.least(F.lit(0.7) + hits, F.lit(0.95)), 2).alias("confidence"),
    )


def span_of(starts: Column, ends: Column) -> Column:
    """struct<start, end> of the likeliest span over token scores; token 0 stands for none, as does a
    start behind its end, and both give null."""
    best = lambda scores: F.array_position(scores, F.array_max(scores)).cast("int") - 1
    s, e = best(starts), best(ends)
    return F.when((F.size(starts) > 0) & (F.size(ends) > 0) & (s > 0) & (e > 0) & (s <= e), F.struct(s.alias("start"), e.alias("end")))


def decoded(scores: DataFrame, type_threshold: float = 0.5, least_confidence: float = 0.0) -> DataFrame:
    """Events from a model's scores, one for each sentence and type.

    ``scores`` has (doc_id, doc_ord, sent_start, sentence, event_type, type_prob, role, start, end),
    offsets in the sentence; role ``trigger`` is the trigger. Types under the threshold or without a
    trigger span give nothing; the confidence filter comes before numbering.
    """
    text = F.expr("substring(sentence, start + 1, end - start)")
    kept = scores.where((F.col("type_prob") >= type_threshold) & F.col("start").isNotNull() & (F.col("start") < F.col("end"))).withColumn("_x", text)
    by = ["doc_id", "doc_ord", "sent_start", "sentence", "event_type"]
    args = F.array_sort(F.collect_list(F.when(F.col("role") != "trigger", F.struct("start", "role", F.col("_x").alias("value")))))
    found = kept.groupBy(*by).agg(F.max(F.when(F.col("role") == "trigger", F.col("_x"))).alias("trigger"), F.max("type_prob").alias("_p"), args.alias("_a")).where(F.col("trigger").isNotNull())
    sure = found.withColumn("confidence", exact_round(F.col("_p"), 4)).where(F.col("confidence") >= least_confidence)
    pick = lambda role: F.coalesce(F.try_element_at(F.filter("_a", lambda a: a["role"] == role), F.lit(1))["value"], F.lit(""))
    return numbered(sure, ["doc_ord", "sent_start", "event_type"], "node_ord").select(
        "node_ord", F.format_string("E%03d", F.col("node_ord")).alias("event_id"), "doc_id", "event_type", "trigger", F.col("sentence").alias("mention"),
        F.transform("_a", lambda a: F.struct(a["role"].alias("role"), a["value"].alias("value"))).alias("arguments"), pick("time").alias("time"), pick("location").alias("location"),
        F.expr("array(sent_start, sent_start + length(sentence))").alias("char_offset"), "confidence",
    )


def contract(events_: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts of broken rules: repeated ids, unknown types or roles, offsets off the mention, confidences."""
    joined = events_.join(docs.select("doc_id", "text"), "doc_id", "left")
    cut = F.expr("substring(text, char_offset[0] + 1, char_offset[1] - char_offset[0])")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    return joined.agg(
        (F.count("*") - F.count_distinct("event_id")).alias("repeated_ids"),
        n(~F.col("event_type").isin(lx.EVENT_TYPES)).alias("unknown_types"),
        n(F.exists("arguments", lambda a: ~a["role"].isin(lx.ROLES))).alias("unknown_roles"),
        n(~cut.eqNullSafe(F.col("mention"))).alias("wrong_offsets"),
        n(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("wrong_confidences"),
    )


def training_samples(rows: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """(text, event_type, role, start, end, label) for each event and role of converted training rows:
    the trigger and the first argument of each role are positive, all other roles negative."""
    wanted = ["trigger", *(roles or lx.ROLES)]
    event = rows.select("text", F.explode("events").alias("e")).select("text", F.col("e.mapped_type").alias("event_type"), F.col("e.trigger").alias("t"), F.col("e.arguments").alias("a"), F.explode(F.array(*map(F.lit, wanted))).alias("role"))
    arg = F.try_element_at(F.filter("a", lambda x: x["mapped_role"] == F.col("role")), F.lit(1))
    start, end = (F.when(F.col("role") == "trigger", F.col(f"t.{c}")).otherwise(arg[c]) for c in ("start", "end"))
    return event.select("text", "event_type", "role", F.coalesce(start, F.lit(0)).alias("start"), F.coalesce(end, F.lit(0)).alias("end"), start.isNotNull().cast("int").alias("label"))
