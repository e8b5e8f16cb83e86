r"""Benchmark decontamination with DataFrame functions only (operator 4).

The benchmark's windows of ``n`` normalised words are hashed by their first ``LEAD`` words. This set
of hashes is broadcast, and the words of the training texts stream past it: every place whose
``LEAD`` words are in the set is compared with the windows word by word, and the words inside
windows that agree are marked. Windows of other lengths (items of fewer than ``n`` words) are looked
up in the same way, by fewer words if they have fewer.

The texts are read where they lie and never shuffled: scan, look-up and filter are one stage, and
only places that may begin a window go on. A broadcast has at most ``MOST_LEADS`` hashes; a larger
benchmark is cut into blocks by hash, each streamed past in its turn, so no size makes the corpus
move. Windows and hits are broadcast if they are counted to be few, else joined by a shuffle of
places and of narrow rows. Texts meet their hits only if a broadcast bitmap of the hits' keys, which
has one size for any number, lets them through.

Null and empty texts have no words: no hits. Hits are gathered by key and text, so repeated rows
are judged alike and rows that share a key by their own texts. An item without words is in no text.
An empty benchmark or table gives no hits or an empty result. A text is split into words at once:
the longest text bounds a task's memory. Extra columns pass through,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm._shared import kept, packed, parted, small_or_shuffled, unpacked
from eventloom.llm.line_dedup import LOWER, UPPER, but

LEAD = 3
MOST_LEADS = 4_000_000
MOST_BROADCAST = 300_000
#: what separates words once A-Z are lower-cased, and before; what words consist of, before
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _full(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def word_array(text: Column) -> Column:
    """Lower-cased words of ``text``; none for null."""
    return _full(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK))


def benchmark_windows(items: DataFrame, n: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(_dc_item, _dc_size, _dc_window): each item's windows, words joined by a space."""
    words = items.select(F.col(key).cast("string").alias("_dc_item"), word_array(F.col(text)).alias("_dc_words")).where(F.size("_dc_words") > 0)
    sized = words.withColumn("_dc_size", F.least(F.lit(n), F.size("_dc_words")))
    spread = sized.withColumn("_dc_at", F.explode(F.sequence(F.lit(1), F.size("_dc_words") - F.col("_dc_size") + 1)))
    return spread.select("_dc_item", "_dc_size", F.array_join(F.slice("_dc_words", F.col("_dc_at"), F.col("_dc_size")), " ").alias("_dc_window")).distinct()


def _lead(words: str, at: str, n: int) -> Column:
    return F.expr("xxhash64(" + ", ".join(f"get({words}, {at} + {j})" for j in range(n)) + ")")


def places(docs: DataFrame, windows: DataFrame, key: str, text: str) -> DataFrame:
    """(_dc_key, _dc_hash, _dc_at, _dc_size, _dc_window): where a window may begin in a text, with the words there."""
    leads = kept(windows.select("_dc_size", F.least(F.lit(LEAD), F.col("_dc_size")).alias("_dc_n"), F.split("_dc_window", " ").alias("_dc_words"))
                 .select("_dc_size", "_dc_n", *[_lead("_dc_words", "0", n).alias(f"_dc_lead{n}") for n in range(1, LEAD + 1)])
                 .select("_dc_size", "_dc_n", F.expr("CASE _dc_n " + " ".join(f"WHEN {n} THEN _dc_lead{n}" for n in range(1, LEAD + 1)) + " END").alias("_dc_lead")).distinct(), "benchmark-leads")
    found = []
    for n, rows in leads.groupBy("_dc_n").agg(F.count("*")).orderBy("_dc_n").collect():  # a row for each of 1..LEAD at most
        words = docs.select(F.col(key).alias("_dc_key"), F.xxhash64(text).alias("_dc_hash"), word_array(F.col(text)).alias("_dc_words"))
        spread = words.select("_dc_key", "_dc_hash", "_dc_words", F.posexplode("_dc_words").alias("_dc_at", "_dc_w"))
        looked = spread.select("_dc_key", "_dc_hash", "_dc_words", "_dc_at", _lead("_dc_words", "_dc_at", n).alias("_dc_lead"))
        blocks = -(-rows // MOST_LEADS)
        for block in range(blocks):
            some = leads.where((F.col("_dc_n") == n) & (F.pmod("_dc_lead", F.lit(blocks)) == block)).select("_dc_size", "_dc_lead")
            met = looked.join(F.broadcast(some), "_dc_lead").where(F.col("_dc_at") + F.col("_dc_size") <= F.size("_dc_words"))
            found.append(met.select("_dc_key", "_dc_hash", "_dc_at", "_dc_size", F.array_join(F.slice("_dc_words", F.col("_dc_at") + 1, F.col("_dc_size")), " ").alias("_dc_window")))
    if not found:
        return docs.sparkSession.createDataFrame([], f"_dc_key {docs.schema[key].dataType.simpleString()}, _dc_hash long, _dc_at int, _dc_size int, _dc_window string")
    return reduce(DataFrame.unionByName, found)


def hits(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_dc_key, _dc_hash, n_hit, _dc_items, _dc_hit) of the rows with a hit, by key and text hash: sorted item
    ids as strings and hit word positions from 0. Written to the shared folder."""
    windows = kept(benchmark_windows(items, n, item_key, item_text), "benchmark-windows")
    by_window = windows.groupBy("_dc_size", "_dc_window").agg(F.collect_set("_dc_item").alias("_dc_ids"))
    known = small_or_shuffled(by_window, windows.count(), MOST_BROADCAST)
    per_text = places(docs, windows, key, text).join(known, ["_dc_size", "_dc_window"]).groupBy("_dc_key", "_dc_hash").agg(
        F.collect_set(F.struct("_dc_at", "_dc_size")).alias("_dc_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_dc_ids")))).alias("_dc_items"),
    )
    marked = F.array_distinct(F.flatten(F.transform("_dc_spans", lambda s: F.sequence(s["_dc_at"], s["_dc_at"] + s["_dc_size"] - 1))))
    return kept(per_text.select("_dc_key", "_dc_hash", "_dc_items", marked.alias("_dc_hit")).withColumn("n_hit", F.size("_dc_hit").cast("long")), "benchmark-hits")


def _few(found: DataFrame) -> DataFrame:
    return small_or_shuffled(found, found.count(), MOST_BROADCAST)


def report(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    n_words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(key), F.xxhash64(text).alias("_dc_own"), n_words.alias("n_words"))
    found = hits(docs, items, n, key, text).select("_dc_key", "_dc_hash", "n_hit", F.size("_dc_items").cast("long").alias("n_items"), F.array_join("_dc_items", ",").alias("_dc_ids"))
    return rows.join(_few(found), F.col(key).eqNullSafe(F.col("_dc_key")) & (F.col("_dc_own") == F.col("_dc_hash")), "left").select(
        key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("_dc_ids", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _parted(docs: DataFrame, found: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, Column]:
    """Packed rows that may have a hit, those that have none, and what joins the first with ``found``."""
    own = F.col("_row")
    maybe, clean = parted(packed(docs), F.xxhash64(own[key], F.xxhash64(own[text])), found, F.xxhash64("_dc_key", "_dc_hash"))
    return maybe, clean, own[key].eqNullSafe(F.col("_dc_key")) & (F.xxhash64(own[text]) == F.col("_dc_hash"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, all columns."""
    found = hits(docs, items, n, key, text).select("_dc_key", "_dc_hash")
    maybe, clean, same = _parted(docs, found, key, text)
    return unpacked(clean.unionByName(maybe.join(found, same, "left_anti")), docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs``; where it has hits, ``text`` keeps the words outside them, as they were
    written, joined by a space."""
    found = hits(docs, items, n, key, text).select("_dc_key", "_dc_hash", "_dc_hit")
    maybe, clean, same = _parted(docs, found, key, text)
    own = F.col("_row")[text]
    new = F.when(F.col("_dc_hit").isNotNull(), F.array_join(but(_full(F.split(own, CASED_BREAK)), F.col("_dc_hit")), " ")).otherwise(own)
    return unpacked(clean, docs.columns).unionByName(unpacked(maybe.join(found, same, "left"), docs.columns, **{text: new}))
