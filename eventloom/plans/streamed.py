"""Registered queries of graphs merged from streams: the tables replayed in several batches, to the results of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import graph
from eventloom.plans import graphs
from eventloom.plans.graphs import table
from eventloom.sources import schemas as sc
from eventloom.sources.storage import shared_path, written
from eventloom.streaming import graphs as streams

PARTS = 6  # files that the records are written to; two of them are a batch


def _replayed(records: DataFrame, ddl: str, merge, name: str) -> str:
    """The folder of rows that the records give, streamed two files at a time; columns that they lack are null."""
    spark, schema = records.sparkSession, sc._ddl(ddl)
    whole = records.select(*[F.col(f.name).cast(f.dataType) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(written(whole.repartition(PARTS), f"{name}-records"))
    path = shared_path(spark, name)
    streams.started(merge(files), path, available_now=True).awaitTermination()
    return path


def streamed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types' relations of every user as a stream, out of order, cleaned to the graph that ``clean_graph`` gives."""
    path = _replayed(graphs.raw_type_relations(spark, sf_dir), sc.EDGE_DDL, streams.merged_edges, "streamed-edges")
    edges = graph.clean_edges(streams.current(spark, path, streams.EDGE_KEYS, sc.EDGE_DDL), graphs.type_nodes(spark, sf_dir))
    return edges.select("graph_id", "relation_id", "cause_event_id", "effect_event_id", F.round("confidence", 6).alias("confidence"))


def streamed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a stream of records, out of order, merged by status as ``node_merge`` does."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("graph_id"), F.col("o_orderstatus").alias("event_id"), F.col("o_orderkey").alias("node_ord"), F.col("o_orderpriority").alias("mention"), (F.col("o_totalprice") / 1e6).alias("confidence"))
    path = _replayed(rows, sc.NODE_DDL, streams.merged_nodes, "streamed-nodes")
    return streams.current(spark, path, streams.NODE_KEYS, sc.NODE_DDL).select("graph_id", "event_id", "node_ord", "mention", F.round("confidence", 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (streamed_graph, streamed_nodes)}
#: the queries whose SQL theirs is
SAME_ROWS = {"streamed_graph": "clean_graph", "streamed_nodes": "node_merge"}
