"""One event for each document of a pack: special kinds, stage labels, arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.functions import text as tx


def is_digest(title: Column, text: Column) -> Column:
    return (F.size(F.regexp_extract_all(text, F.lit(lx.DIGEST_HEAD), 1)) >= 3) | title.rlike(lx.DIGEST_TITLE)


def special_kind(title: Column, text: Column) -> Column:
    """digest, conflict, background or null."""
    blob = F.concat(title, F.lit("\n"), text)
    return F.when(is_digest(title, text), "digest").when(blob.rlike(lx.CONFLICT), "conflict").when(blob.rlike(lx.BACKGROUND), "background")


def digest_labels(docs: DataFrame) -> DataFrame:
    """(graph_id, event_id, label) named in the digests of each pack, the first one each."""
    heads = docs.where(is_digest(F.col("title"), F.col("text"))).select("graph_id", "doc_ord", F.posexplode(F.regexp_extract_all("text", F.lit(lx.DIGEST_HEAD), 0)).alias("i", "m"))
    named = heads.select("graph_id", "doc_ord", "i", F.upper(F.regexp_replace(F.regexp_extract("m", lx.DIGEST_HEAD, 1), r"(?U)\s+", "")).alias("event_id"), tx.strip(F.regexp_extract("m", lx.DIGEST_HEAD, 2)).alias("label"))
    return named.groupBy("graph_id", "event_id").agg(F.min_by("label", F.struct("doc_ord", "i")).alias("label"))


def stage_label(doc_id: Column, title: Column, text: Column) -> Column:
    """The first stage with a word in the document, else the title's first twelve characters, else the id."""
    blob = F.concat(title, F.lit("\n"), text)
    stages = reduce(lambda c, s: c.when(blob.rlike("|".join(s[1])), s[0]), lx.STAGE_WORDS, F.when(F.lit(False), ""))
    return F.coalesce(stages, F.nullif(F.left(title, F.lit(12)), F.lit("")), doc_id)


def labels(docs: DataFrame, hints: DataFrame) -> DataFrame:
    """(graph_id, doc_id, kind, hint, label): special labels, hints, then unused stages in document order;
    when they run out, a guess that nothing has used before, or a numbered label."""
    asked = hints.select("graph_id", F.col("event_id").alias("doc_id"), F.col("label").alias("asked"))
    digest = digest_labels(docs).select("graph_id", F.col("event_id").alias("doc_id"), F.col("label").alias("in_digest"))
    kind = special_kind(F.col("title"), F.col("text"))
    special = F.create_map(*[F.lit(x) for kv in lx.SPECIAL_LABELS.items() for x in kv])
    known = docs.withColumn("kind", kind).join(asked, ["graph_id", "doc_id"], "left").join(digest, ["graph_id", "doc_id"], "left").withColumn("hint", F.coalesce(F.nullif("asked", F.lit("")), F.nullif("in_digest", F.lit(""))))
    known = known.withColumn("fixed", F.coalesce(F.try_element_at(special, F.col("kind")), F.col("hint")))
    pack = Window.partitionBy("graph_id")
    stages = F.array(*map(F.lit, lx.STAGES))
    used = known.withColumn("used", F.collect_set("fixed").over(pack)).withColumn("free", F.array_except(stages, F.col("used")))
    placed = used.withColumn("place", F.count(F.when(F.col("fixed").isNull(), 1)).over(pack.orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, 0)))
    over = placed.withColumn("extra", F.when(F.col("fixed").isNull() & (F.col("place") > F.size("free")), F.col("place") - F.size("free"))).withColumn("guess", F.when(F.col("extra").isNotNull(), stage_label(F.col("doc_id"), F.col("title"), F.col("text"))))
    first = F.row_number().over(Window.partitionBy("graph_id", "guess").orderBy("doc_ord")) == 1
    fresh = first & ~F.array_contains("used", F.col("guess")) & ~F.array_contains(stages, F.col("guess"))
    late = F.when(fresh, F.col("guess")).otherwise(F.concat(F.lit("后续事件"), F.col("extra").cast("string")))
    return over.select("graph_id", "doc_id", "kind", "hint", F.coalesce("fixed", F.when(F.col("extra").isNull(), F.try_element_at("free", F.col("place").cast("int"))), late).alias("label"))


def events(docs: DataFrame, hints: DataFrame) -> DataFrame:
    """One node for each document, of the document's id."""
    sentences = tx.simple_sentences(F.col("text"), 6)
    body = F.filter("_s", lambda s: s != F.col("title"))
    impact = F.try_element_at(F.filter(F.slice("_b", F.lit(1), F.lit(4)), lambda s: tx.any_of(s, lx.IMPACT_CUES)), F.lit(1))
    pair = lambda role, value: F.struct(F.lit(role).alias("role"), F.coalesce(value, F.lit("")).alias("value"))
    time, place = tx.find(F.col("text"), lx.PACK_TIME), tx.find(F.col("text"), lx.PACK_LOCATION)
    args = F.filter(F.array(pair("时间", time), pair("地点", place), pair("主体", tx.find(F.col("text"), lx.PACK_ORGANISATION)), pair("影响", F.left(impact, F.lit(80)))), lambda a: a["value"] != "")
    rows = docs.join(labels(docs, hints), ["graph_id", "doc_id"]).withColumn("_s", sentences).withColumn("_b", body)
    return rows.select(
        "graph_id", F.col("doc_ord").alias("node_ord"), F.col("doc_id").alias("event_id"), "doc_id", F.col("label").alias("event_type"), F.col("label").alias("trigger"),
        F.coalesce(F.try_element_at("_b", F.lit(1)), F.try_element_at("_s", F.lit(1)), F.col("title")).alias("mention"), args.alias("arguments"), time.alias("time"), place.alias("location"),
        F.lit(None).cast("array<int>").alias("char_offset"), F.when(F.col("kind").isNotNull(), 0.35).when(F.col("hint").isNotNull(), 0.7).otherwise(0.55).alias("confidence"),
    )
