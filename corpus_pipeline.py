"""From raw documents to token ids: five stages, each reading what the one before it kept.

Quality rules reject documents; lines that many documents share go; one document of each group of
near copies stays; documents that hold benchmark passages go; the rest is encoded, and decoded
again to prove the ids.

Defined results, for every stage that takes documents (doc_id, text, lang, source, n_chars and any
other columns, also such that bear names of inner columns): a null or empty text has no words and is
rejected by the quality rules; very long texts are worked on whole, the longest bounds a task's
memory; repeated rows of one doc_id are kept or dropped together by near-dedup and stand for one
document in line counts; of tied copies the smallest doc_id stays, of common lines the largest
doc_id's. An empty table of documents gives an empty result of the same columns, an empty benchmark
drops nothing. ``n_chars`` is that of the raw text, as are all columns but ``text``. The last stage
returns a row for each document that is left: doc_id, lang, source, ids, n_tokens and
decoded_sha256, the digest of the bytes that its ids decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe, decontam, line_dedup, near_dedup, quality_rules
from eventloom.llm._shared import kept

#: No SQL expresses near-duplicates and BPE over the stages; a test holds run() against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_rows(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, counts=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_rows(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carried=("lang", "source"), proven=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_copies), ("decontamination", benchmark), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
