"""Uniform shuffle into shards of exact sizes (operator 11), all of it DataFrame plans.

A communication matrix says how many rows of each input partition go to each shard. Its rows add up to
the partitions' counts and its columns to the shards' sizes (``rows // shards``, one more for the first
``rows % shards``), and it is drawn from the law that a uniform permutation of all rows would give: the
multivariate hypergeometric one. It is drawn down a tree of partitions: a node with the shards' capacities
deals them out to its at most ``FANOUT`` children, child after child and shard after shard, one hypergeometric
number at a time; the last child gets what is left. So a matrix of any height takes a few joins of narrow
tables, no task draws for more than ``FANOUT`` children of a node at once, and nothing passes the driver.

Then every partition is permuted locally (a sort by a random number within the partition, no exchange), and
written once with its rows' places. Places and matrix row give each row its shard: the first so many rows go
to shard 0, the next to shard 1. One exchange brings the rows of a shard's bucket together, buckets being
ranges of a second random number, some ``BUCKET`` rows each; sorted by it, with the counts of the
buckets before, they get their slots. Sorting all of a shard by one random number is the second permutation.
So each shard's rows are a uniform sample in uniform order, whatever keys, sources or groups of copies the
table holds: no plan here groups by the rows' own values, and a third of all rows with one text
spreads like any others.

A hypergeometric number is drawn by the ratio of uniforms: candidates from under a hat that covers the law
(Stadlober 1990; a test holds the covering and the counts against exact probabilities), accepted by
the logarithm of its probability against the mode's, by Stirling differences that keep their digits at large
counts. ``TRIES`` candidates all fail with a chance below 1e-20, which gives the mode. Random numbers are hashes of
the seed and their place in the draw, so lost tasks draw the same again.

Shuffles: narrow ones for the matrix, one of the rows. Memory: a task holds one node's children, or sorts a bucket.
The matrix is broadcast up to ``MOST_PARTS`` partitions (200 bytes each at 24 shards), else joined by a shuffle; so
are the buckets' starts up to ``MOST_BUCKETS``.

Defined results: nulls in any column and empty texts are rows like others; repeated rows are separate
rows with slots of their own, and ties in a random number are told apart by the rows' places. With fewer rows
than shards the last shards are empty; an empty table gives an empty result. Extra columns stay; existing
columns ``shard`` and ``slot`` are replaced, other names never clash. The same seed gives the same shuffle while the
table is read in the same partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm._shared import kept, packed, small_or_shuffled, unpacked

FANOUT_BITS = 6
#: Children of a node of the tree of partitions.
FANOUT = 1 << FANOUT_BITS
#: Candidates for one hypergeometric number.
TRIES = 64
#: Rows of a shard that are sorted together, on average.
BUCKET = 250
MOST_PARTS, MOST_BUCKETS = 200_000, 200_000
#: The hat's width is WIDE times the deviation plus MORE: twice the roots of 2/e, and three less twice that of 3/e.
WIDE, MORE = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _uniform(*place: Column | int) -> Column:
    """A number in (0, 1) that is a hash of ``place``."""
    h = F.xxhash64(*[F.lit(x) if isinstance(x, int) else x for x in place])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _correction(x: Column) -> Column:
    """What Stirling's formula lacks of the log-gamma of x, for x over 20."""
    return (F.lit(1 / 12) - (F.lit(1 / 360) - F.lit(1 / 1260) / (x * x)) / (x * x)) / x


def _log_growth(a: Column, d: Column) -> Column:
    """ln((a + d)!) - ln(a!), from a difference where both are large."""
    x, y = a + 1.0, a + d + 1.0
    small = lambda v: F.log(F.factorial(v.cast("int")).cast("double"))
    stirling = lambda v: (v - 0.5) * F.log(v) - v + F.lit(0.5 * math.log(2 * math.pi)) + _correction(v)
    one = lambda v: F.when(v <= 20, small(v)).otherwise(stirling(v + 1.0))
    return F.when((a > 20) & (a + d > 20), (x - 0.5) * F.log1p(d / x) + d * F.log(y) - d + _correction(y) - _correction(x)).otherwise(one(a + d) - one(a))


def hypergeometric(good: Column, bad: Column, sample: Column, uniform: Callable[[Column], Column]) -> Column:
    """How many of ``sample`` rows, drawn from ``good`` and ``bad`` ones without putting back, are good.

    ``uniform`` gives the i-th random number of this draw.
    """

    def drawn(p: Column) -> Column:
        low, high, m = p["low"], p["high"], p["m"]

        def from_hat(q: Column) -> Column:
            def candidate(i: Column) -> Column:
                x, y = uniform(i * 2), uniform(i * 2 + 1)
                spot = F.floor(q["centre"] + q["width"] * (y - 0.5) / x)

                def judged(z: Column) -> Column:
                    d = (z - q["mode"]).cast("double")
                    grown = _log_growth(q["mode"].cast("double"), d) + _log_growth((low - q["mode"]).cast("double"), -d)
                    grown = grown + _log_growth((m - q["mode"]).cast("double"), -d) + _log_growth((high - m + q["mode"]).cast("double"), d)
                    inside = (z >= 0) & (z <= F.least(low, m))
                    return F.when(inside & (2.0 * F.log(x) <= -grown), z).otherwise(F.lit(-1).cast("long"))

                return _let(spot, judged)

            found = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(-1).cast("long"), lambda got, i: F.when(got >= 0, got).otherwise(candidate(i)))
            return _let(found, lambda z: F.when(z >= 0, z).otherwise(q["mode"]))

        n = (low + high).cast("double")
        share = low / n
        spread = F.sqrt((n - m) * m * share * (1.0 - share) / (n - 1.0) + 0.5)
        mode = F.floor((m + 1) * ((low + 1) / (n + 2.0)))
        hat = F.struct((m * share + 0.5).alias("centre"), (WIDE * spread + MORE).alias("width"), F.least(mode, low, m).alias("mode"))
        return F.when((low == 0) | (m == 0), F.lit(0).cast("long")).otherwise(_let(hat, from_hat))

    # drawn for the smaller kind and the smaller part, then turned round
    whole = F.struct(F.least(good, bad).alias("low"), F.greatest(good, bad).alias("high"), F.least(sample, good + bad - sample).alias("m"))

    def turned(z: Column) -> Column:
        low_in = F.when(sample * 2 > good + bad, F.least(good, bad) - z).otherwise(z)
        return F.when(good > bad, sample - low_in).otherwise(low_in)

    return _let(_let(whole, drawn), turned)


def _dealt(capacity: Column, children: Column, seed: int, level: int) -> Column:
    """array<array<long>>: what each child (struct<child, n>) gets of each shard's ``capacity``."""
    longs, none = "array<bigint>", F.array().cast("array<bigint>")

    def child_draw(left: Column, child: Column) -> Column:
        start = F.struct(child["n"].alias("sample"), F.aggregate(left, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), none.alias("counts"))

        def shard_draw(state: Column, s: Column) -> Column:
            good = F.get(left, s)
            random = lambda i: _uniform(seed, level, child["child"], s, i)
            x = hypergeometric(good, state["total"] - good, state["sample"], random)
            return _let(x, lambda z: F.struct((state["sample"] - z).alias("sample"), (state["total"] - good).alias("total"), F.concat(state["counts"], F.array(z)).alias("counts")))

        return F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), start, shard_draw)["counts"]

    def step(state: Column, child: Column) -> Column:
        after = lambda got: F.struct(F.zip_with(state["left"], got, lambda a, b: a - b).alias("left"), F.concat(state["rows"], F.array(got)).alias("rows"))
        return _let(child_draw(state["left"], child), after)

    return F.aggregate(children, F.struct(capacity.cast(longs).alias("left"), F.array().cast(f"array<{longs}>").alias("rows")), step)["rows"]


def matrix(counts: DataFrame, sizes: Column, seed: int = 0) -> DataFrame:
    """(part, dealt array<long>) for ``counts`` (part, n): the rows that each shard gets of a partition.

    ``sizes`` is an array of the shards' sizes, whose sum is that of ``n``; parts are numbers from 0, gaps allowed.
    """
    spark = counts.sparkSession
    top = counts.agg(F.max("part")).first()[0]
    if top is None:
        return counts.select("part", F.array().cast("array<bigint>").alias("dealt"))
    levels = max(1, math.ceil(int(top).bit_length() / FANOUT_BITS))
    at = spark.range(1).select(F.lit(0).cast("long").alias("node"), sizes.cast("array<bigint>").alias("dealt"))
    for level in range(levels, 0, -1):
        sums = counts.groupBy(F.shiftright("part", FANOUT_BITS * (level - 1)).alias("child")).agg(F.sum("n").alias("n"))
        children = sums.groupBy(F.shiftright("child", FANOUT_BITS).alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("children"))
        shared = at.join(children, "node").select("children", _dealt(F.col("dealt"), F.col("children"), seed, level).alias("rows"))
        at = shared.select(F.explode(F.arrays_zip("children", "rows")).alias("x")).select(F.col("x.children.child").alias("node"), F.col("x.rows").alias("dealt"))
    return at.withColumnRenamed("node", "part")


def shuffled(df: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """``df`` with its rows' ``shard`` (0 to ``shards`` - 1) and ``slot`` in it, from 0 without gaps."""
    columns = df.columns
    order = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    local = packed(df).withColumn("_order", order).sortWithinPartitions("_order").withColumn("_id", F.monotonically_increasing_id())
    mixed = local.select("_row", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    rows = kept(mixed, "shard-parts")
    counts = kept(rows.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n")), "shard-counts")
    parts, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.lit(n // shards).cast("long") + F.when(s < n % shards, 1).otherwise(0))
    ends = F.aggregate("dealt", F.array().cast("array<bigint>"), lambda ends, x: F.concat(ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + x)))
    drawn = kept(matrix(counts, sizes, seed), "shard-matrix").select(F.col("part").alias("_part"), ends.alias("_ends"))
    buckets = max(1, -(-n // (shards * BUCKET)))
    again = F.xxhash64(F.lit(seed + 1), "_part", "_place")
    met = rows.join(small_or_shuffled(drawn, parts, MOST_PARTS), "_part")
    dealt = met.select("_row", "_part", "_place", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))).alias("_shard"), again.alias("_again"))
    dealt = dealt.withColumn("_bucket", F.least(F.floor(F.shiftrightunsigned("_again", 11).cast("double") * F.lit(buckets * 2.0**-53)), F.lit(buckets - 1)))
    # the sort is by the unsigned number, as are the buckets
    unsigned = F.shiftrightunsigned("_again", 1)
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = kept(dealt.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n")), "shard-buckets")
    starts = in_bucket.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy(unsigned, "_again", "_part", "_place"))
    placed = dealt.join(small_or_shuffled(starts, shards * buckets, MOST_BUCKETS), ["_shard", "_bucket"]).withColumn("_in", inside)
    return unpacked(placed, columns, shard=F.col("_shard"), slot=(F.col("_start") + F.col("_in") - 1).cast("long"))


def write_shards(df: DataFrame, folder: str) -> None:
    """Writes what ``shuffled`` gave as Parquet, a folder for each shard; a file holds buckets whole, by slot."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
