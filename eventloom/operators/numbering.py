"""Rows numbered 1, 2, 3 … and looked ahead from, over a whole table or large groups of it, without passing these through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.sources.storage import kept

#: Rows of a group that one task may number, or look ahead in.
MOST = 100_000


def numbered(df: DataFrame, order: list, column: str) -> DataFrame:
    """``df`` with ``column``, its place by ``order``.

    Rows are dealt out by ranges of the order and sorted within them; a range's first number is the
    sum of the counts before it, a table of one row for each partition.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = kept(dealt.withColumn("_part", F.shiftright("_id", 33)).withColumn("_local", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(starts), "_part").withColumn(column, F.col("_start") + F.col("_local") + 1).drop("_part", "_local", "_start", "_id")


def large(df: DataFrame, group: str) -> DataFrame | None:
    """The groups (``group``) of more than ``MOST`` rows, written; None if there is none."""
    found = kept(df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST).select(group), "large-groups")
    return None if found.isEmpty() else found


def placed(df: DataFrame, group: str, order: list, column: str, large_: DataFrame | None) -> DataFrame:
    """``df`` with ``column``, its place 1, 2, 3 … by ``order`` in its group: by a window, but ``large_`` groups by ranges of the order."""
    by_window = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")
    if large_ is None:
        return df.withColumn(column, by_window)
    df = kept(df, "placed")
    small = df.join(large_, group, "left_anti").withColumn(column, by_window)
    wide = kept(numbered(df.join(large_, group, "left_semi"), [group, *order], "_at"), "placed")
    start = wide.groupBy(group).agg(F.min("_at").alias("_from"))
    return small.unionByName(wide.join(start, group).withColumn(column, F.col("_at") - F.col("_from") + 1).select(*small.columns))


def ahead(df: DataFrame, group: str, place: str, own: Column, reach: int) -> DataFrame:
    """``df`` with ``ahead``, array<struct<distance, b>>: ``own`` of the next ``reach`` rows of its group, null behind the last.

    Rows are looked at in blocks of ``MOST`` places; a block also gets the first ``reach`` rows of the next one.
    """
    block = F.floor(F.col(place) / MOST)
    blocks = F.when((F.col(place) % MOST < reach) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    order = Window.partitionBy(group, "_block").orderBy(place)
    found = F.array(*[F.struct(F.lit(d).alias("distance"), F.lead(own, d).over(order).alias("b")) for d in range(1, reach + 1)])
    return df.withColumn("_block", F.explode(blocks)).withColumn("ahead", found).where(F.col("_block") == block).drop("_block")
