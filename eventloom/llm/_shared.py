"""What the operators of this subpackage share: written tables, joins by counted size, packed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.sources.storage import kept, shared_dir

__all__ = ["kept", "packed", "parted", "shared_dir", "small_or_shuffled", "unpacked"]


def small_or_shuffled(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are at most ``most``; else as it is."""
    return F.broadcast(df) if rows <= most else df


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``_row``, so that no name of its columns clashes with inner ones."""
    return df.select(F.struct(*df.columns).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The ``columns`` of ``_row``, some replaced; those of ``new`` that aren't among them come last."""
    return df.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns], *[v.alias(c) for c, v in new.items() if c not in columns])


#: Bits of a filter of keys, and those of one of its rows; all rows together take 8 MB.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def parted(df: DataFrame, hashed: Column, keys: DataFrame, key_hash: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: the rows whose ``hashed`` may be the ``key_hash`` of a row of ``keys``, and those for which it isn't.

    The second part needs no join with anything of these keys, so its rows needn't move. The keys are
    a bitmap of ``FILTER_BITS`` bits that is broadcast, of the same size for any number of keys: with
    very many, more rows of the first part meet none.
    """
    place = lambda h: F.pmod(h, F.lit(FILTER_BITS)) + 1
    ones = keys.select(place(key_hash).alias("_at")).select(F.bitmap_bucket_number("_at").alias("_bucket"), F.bitmap_bit_position("_at").alias("_bit"))
    bitmap = kept(ones.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "key-filter")
    at = df.select(F.struct(*df.columns).alias("_own"), place(hashed).alias("_at"))
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = at.join(F.broadcast(bitmap), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left").select("_own", F.coalesce(F.getbit(byte, (bit % 8).cast("int")), F.lit(0)).alias("_held"))
    return tuple(met.where(F.col("_held") == held).select("_own.*") for held in (1, 0))
