"""Token counts as delta-maintained rollups (operator 2).

A batch of changes (insert, delete, revise) becomes signed token and document deltas, summed by
source, language and tokenizer version before they move, and is written as one small table for
the batch. The totals are the sums of all committed batches, so a batch costs what it changes
and never what the corpus holds. A batch id is committed once: each attempt writes its table to a
folder of its own, and then creates the batch's marker, which names that folder. A marker is
created, never overwritten (an exclusive create of the store), so of two writers of one batch the
later one finds it and changes nothing, and what counts is one whole attempt. A writer that dies
between creating and filling the marker leaves an empty one: that batch counts as not committed,
and committing it again is an error until ``recover`` takes the empty marker away.

Null sources, languages and tokenizers are groups of their own; null counts count as nothing; an
operation that is none of the three is an error. Repeated rows count as often as they occur. An
empty batch commits and changes nothing, and a ledger without batches has empty totals. Extra
columns are ignored. Texts are counted whole next to where they are read, one at a time; those
beyond ``bpe.PIECE`` characters are encoded in pieces, whose counts are added.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) deltas of rows (op, source, lang, tokenizer, tokens, old_tokens)."""
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "old_tokens"))
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("no such operation: "), F.coalesce("op", F.lit("null")))))
    rows = changes.withColumn("_op", known)
    docs = F.when(F.col("_op") == "insert", 1).when(F.col("_op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("_op") == "insert", new).when(F.col("_op") == "delete", -new).otherwise(new - old)
    return rows.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Ledger:
    """Committed batches of deltas under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marker(self, batch: int):
        return self._path(f"{self.path}/committed/{int(batch)}")

    def _attempts(self) -> dict[int, str]:
        """The folder of the attempt that counts, by batch; an empty one for a marker without a name."""
        folder = self._path(f"{self.path}/committed")
        named = {}
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            stream = self._fs.open(f.getPath())
            named[int(f.getPath().getName())] = bytes(stream.readAllBytes()).decode()
            stream.close()
        return named

    def committed(self) -> list[int]:
        return sorted(b for b, attempt in self._attempts().items() if attempt)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Commits ``changes`` as ``batch``; False if that batch had been committed before."""
        if self._taken(batch):
            return False
        attempt = f"{int(batch)}-{uuid.uuid4().hex}"
        signed(changes).write.parquet(f"{self.path}/deltas/{attempt}")
        try:
            marker = self._fs.create(self._marker(batch), False)
        except Py4JJavaError:
            if self._taken(batch):  # another writer was faster
                return False
            raise
        marker.write(attempt.encode())
        marker.close()
        return True

    def _taken(self, batch: int) -> bool:
        if not self._fs.exists(self._marker(batch)):
            return False
        if not self._attempts()[int(batch)]:
            raise RuntimeError(f"batch {batch} is being committed, or its writer died: see recover()")
        return True

    def recover(self, batch: int) -> None:
        """Takes away the empty marker that a dead writer of ``batch`` left; only once no writer is at it."""
        if self._fs.exists(self._marker(batch)) and not self._attempts()[int(batch)]:
            self._fs.delete(self._marker(batch), False)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; groups of nothing go."""
        paths = [f"{self.path}/deltas/{attempt}" for attempt in self._attempts().values() if attempt]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def stream_into(ledger: Ledger, changes: DataFrame, checkpoint: str):
    """A streaming query that commits each micro-batch under its epoch id: a replayed epoch changes nothing."""
    return changes.writeStream.foreachBatch(lambda df, epoch: ledger.commit(epoch, df) and None).option("checkpointLocation", checkpoint).start()


def counted(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def changes_of(rows: DataFrame, op: str, tokens: dict[str, Column], old: dict[str, Column] | None = None) -> DataFrame:
    """Change rows of counted ``rows`` (source, lang, …), one for each tokenizer version.

    Count next to the text, write the narrow rows, and join those: texts needn't be shuffled.
    """
    none = F.lit(None).cast("long")
    each = [F.struct(F.lit(name).alias("tokenizer"), n.alias("tokens"), (old[name] if old else none).alias("old_tokens")) for name, n in tokens.items()]
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.explode(F.array(*each)).alias("c")).select("op", "source", "lang", "c.*")


def changes(docs: DataFrame, op: str, tokenizers: dict[str, str], text: Column | None = None, old: Column | None = None) -> DataFrame:
    """Change rows of ``docs`` by each tokenizer version's token pattern."""
    text = F.col("text") if text is None else text
    count = lambda t: {name: counted(t, p) for name, p in tokenizers.items()}
    return changes_of(docs, op, count(text), None if old is None else count(old))


def with_bpe_count(rows: DataFrame, name: str, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``rows`` with the number of BPE tokens of ``text`` as column ``name`` in its place; null counts as empty."""
    from eventloom.llm import bpe

    at = rows.columns.index(text)
    kept_columns = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_columns), f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoding(path, pattern)
        for batch in batches:
            n = pa.array([sum(len(enc.encode_to_numpy(x, disallowed_special=())) for x in bpe.pieces(t.as_py() or "")) for t in batch.column(at)], pa.int64())
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), n], names=[*(batch.schema.names[i] for i in others), name])

    return rows.mapInArrow(run, schema)
