r"""Corpus-wide line deduplication with DataFrame functions only (operator 9).

Lines are exploded with their position, normalised, and hashed (MD5, 128 bits); a hash keeps the
number of distinct documents and the largest document id. Lines of at least ``least_chars`` code
points whose hash occurs in ``least_docs`` documents or more go, except in the largest id.

Texts are split and hashed once: the (document, position, hash) rows of the lines that are long
enough are written, counted by hash (aggregated before they move) and met again by the common
hashes. These are counted too; few are broadcast, many meet the lines in a join of two plain
shuffles, which Spark splits at a hot hash. What moves besides are the positions to drop, narrow
rows. Of the texts those that lose a line are shuffled; the others pass by, told apart by a broadcast
bitmap of the documents' keys that has one size for any corpus (``_shared.parted``). Rewriting is
linear in a document's lines, and its memory is bounded by them.

A null text is one empty line, as is an empty one. Rows that share a doc_id count as one document
for the threshold and for "the largest doc_id"; each is rewritten by its own lines. A null doc_id
counts as one document, smaller than every id. An empty table gives an empty result. Extra
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm._shared import kept, packed, parted, small_or_shuffled, unpacked

MOST_BROADCAST = 300_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"


def normalised(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def but(items: Column, positions: Column) -> Column:
    """``items`` without those at ``positions`` (from 0), in time linear in both."""
    left = F.array_except(F.sequence(F.lit(0), F.size(items) - 1), positions)
    return F.transform(left, lambda i: F.get(items, i))


def dropped_positions(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(_ld_k, _ld_h, _ld_drop array<int>): the lines to drop, for rows that have any; _ld_h is the text's hash."""
    rows = docs.select(F.col(key).alias("_ld_k"), F.coalesce(F.col(text), F.lit("")).alias("_ld_text"))
    lines = kept(
        rows.select("_ld_k", F.xxhash64("_ld_text").alias("_ld_h"), F.posexplode(_lines(F.col("_ld_text"))).alias("_ld_pos", "_ld_line"))
        .where(F.length("_ld_line") >= least_chars)
        .withColumn("_ld_line", normalised(F.col("_ld_line")))
        .where(F.length("_ld_line") >= least_chars)
        .select("_ld_k", "_ld_h", "_ld_pos", F.unhex(F.md5("_ld_line")).alias("_ld_hash")),
        "lines",
    )
    common = (
        lines.groupBy("_ld_hash", "_ld_k").agg(F.lit(1).alias("_ld_one"))
        .groupBy("_ld_hash").agg(F.sum("_ld_one").alias("_ld_docs"), F.max("_ld_k").alias("_ld_keep"))
        .where(F.col("_ld_docs") >= least_docs)
        .select("_ld_hash", "_ld_keep")
    )
    common = kept(common, "common-lines")
    return (
        lines.join(small_or_shuffled(common, common.count(), MOST_BROADCAST), "_ld_hash")
        .where(~F.col("_ld_k").eqNullSafe(F.col("_ld_keep")))
        .groupBy("_ld_k", "_ld_h")
        .agg(F.collect_set("_ld_pos").alias("_ld_drop"))
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3, counts: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``text`` rewritten; with ``counts`` also n_lines and n_dropped, which
    replace columns of these names."""
    drops = kept(dropped_positions(docs, key, text, least_chars, least_docs), "dropped-lines")
    rows = packed(docs)
    own = F.col("_row")[text]
    whole = F.coalesce(own, F.lit(""))
    hashed = F.xxhash64(F.col("_row")[key], F.xxhash64(whole))
    maybe, untouched = parted(rows, hashed, drops, F.xxhash64("_ld_k", "_ld_h"))
    # a sort-merge join at every size: texts are too large a side to build tables of
    met = maybe.join(drops.hint("merge"), F.col("_row")[key].eqNullSafe(F.col("_ld_k")) & (F.xxhash64(whole) == F.col("_ld_h")), "left")
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    columns = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]

    def made(rows: DataFrame, new: Column, n_dropped: Column) -> DataFrame:
        counted = {"n_lines": n_lines.cast("long"), "n_dropped": n_dropped.cast("long")} if counts else {}
        return unpacked(rows, columns, **{text: new}, **counted)

    left = F.when(F.col("_ld_drop").isNull(), whole).otherwise(F.array_join(but(_lines(own), F.col("_ld_drop")), "\n"))
    return made(untouched, whole, F.lit(0)).unionByName(made(met, left, F.coalesce(F.size("_ld_drop"), F.lit(0))))
