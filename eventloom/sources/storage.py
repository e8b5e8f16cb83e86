"""Tables written between stages, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The most bytes of rows that are broadcast without being asked for.
BROADCAST = 1 << 20
#: Shuffles have a partition for so many rows of the largest table read, if that is more than the session's number.
PARTITION_ROWS = 20_000
#: Beyond so many partitions Spark keeps their average sizes only.
MOST_PARTITIONS = 2000
#: The most compressed bytes of shuffled rows that a task is given by joining partitions; joins multiply them.
TASK_BYTES = 4 << 20

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is set on a local master only; on a cluster
    executors would not see it, and that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> str:
    """The new folder that ``df`` is written to as Parquet."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: what follows survives the loss of any executor, and nothing is computed
    twice. Every call writes to a folder of its own.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def joined_by_measure(spark: SparkSession) -> None:
    """From now on the session broadcasts a side by the size of its rows as measured at run time, up to ``BROADCAST`` bytes, or by ``F.broadcast``.

    Before that Spark takes the size of compressed files for that of their rows, which may be twenty times as large: the
    grams of a million questions would pass through the driver. One plan may join dozens of tables, whose broadcasts the driver
    holds at the same time, each as a hash table of several times its rows: so each one has to be small. A smaller bound that the session has stays.

    Unions don't count as dealt out by their sides' keys either: at run time Spark gives each side as many tasks as its rows need, and then can't zip them.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if bound != "-1":
        bound = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", bound)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(min(_bytes(bound), BROADCAST)))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def _bytes(size: str) -> int:
    """A size as Spark writes it (10485760, 256k, 8m, 10485760b) in bytes."""
    digits, unit = re.fullmatch(r"(-?\d+)([a-z]?)b?", size.strip().lower()).groups()
    return int(digits) * 1024 ** " kmgtp".index(unit if unit and unit != "b" else " ")


def sized_by_rows(df: DataFrame) -> DataFrame:
    """``df``, a table as it is read, after the session's shuffles were set to partitions whose number grows with its rows and to tasks of bounded size.

    A fixed number of partitions makes every task grow with the input, and Spark joins small ones up to 64 MB, which are gigabytes once they
    are decompressed and joined. The number never falls: small shuffles are joined into few tasks anyway.
    """
    conf = df.sparkSession.conf
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    conf.set(advised, str(min(_bytes(conf.get(advised)), TASK_BYTES)))
    first, wanted = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", min(-(-df.count() // PARTITION_ROWS), MOST_PARTITIONS)
    if wanted > int(conf.get(first, None) or conf.get("spark.sql.shuffle.partitions")):
        conf.set(first, str(wanted))
    return df


def partitions(df: DataFrame, rows: int) -> int:
    """So many partitions that each holds ``rows`` rows of ``df``, a written table; no fewer than the session's shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """What is written inside joins rows where they lie: sides dealt out by some of a join's keys, in as many partitions, aren't moved by all of them.
    Unions count as dealt out like their sides; these have to be repartitioned to a given number, which Spark doesn't change at run time."""
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.unionOutputPartitioning": "true"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
