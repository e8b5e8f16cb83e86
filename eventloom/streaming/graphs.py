"""Nodes and edges merged as their records arrive, to the same graph that ``operators.graph`` builds at once.

No graph is ever state. Edges are aggregated as they arrive, one row of state for each ordered pair of events, however often it is repeated. Nodes
hold no state: what fills a node's empty fields depends on all its records in their order, so each batch appends its distinct records, and
``current`` merges them as ``graph.merge_nodes`` does, by built-in functions. Each batch writes its rows to a folder of its own number, again if it
is run again, so a batch that is lost or repeated counts once; for edges ``current`` takes each key's last row of those folders, which hold a row for
each change. What needs a whole graph (dangling ends, weaker reverses, numbers) is applied to the merged rows when they are read. There is no
watermark: a repeated record may come at any time, and none is dropped. With many edges set RocksDB as the session's state store, so state is not held in executors' heaps.

Nodes and edges come out the same for any order of arrival. Records without graph or ids are ignored; a null confidence counts as 0, a null place as 0;
repeated rows change nothing; a stream without records gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from eventloom.operators import graph
from eventloom.sources import schemas as sc

NODE_KEYS, EDGE_KEYS = ["graph_id", "event_id"], ["graph_id", *graph.ENDS]


def merged_nodes(records: DataFrame) -> DataFrame:
    """A stream of event records (``NODE_DDL``) to the stream of what ``current`` merges to nodes."""
    known = records.where("graph_id IS NOT NULL AND event_id IS NOT NULL")
    zero = {"node_ord": F.coalesce("node_ord", F.lit(0).cast("long")), "confidence": F.coalesce("confidence", F.lit(0.0))}
    return known.select(*[zero[f.name].alias(f.name) if f.name in zero else F.col(f.name) for f in sc._ddl(sc.NODE_DDL)])


def merged_edges(records: DataFrame) -> DataFrame:
    """A stream of relation records (``EDGE_DDL``) to the stream of the edges that they change: of repeated ones the most
    confident, of equals the first, at the first one's place; no loops. Built-in aggregates, which combine before they move."""
    schema = sc._ddl(sc.EDGE_DDL)
    rest = F.struct(*[F.col(f.name) for f in schema if f.name not in (*EDGE_KEYS, "edge_ord")])
    proper = records.where(" AND ".join(f"{c} IS NOT NULL" for c in (*EDGE_KEYS, "edge_ord"))).where(F.col(graph.ENDS[0]) != F.col(graph.ENDS[1]))
    order = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("edge_ord")).alias("o"))
    best = proper.groupBy(*EDGE_KEYS).agg(F.max_by(rest, order).alias("_r"), F.min("edge_ord").alias("edge_ord"))
    return best.select(*[F.col(f.name) if f.name in (*EDGE_KEYS, "edge_ord") else F.col(f"_r.{f.name}") for f in schema])


def started(changes: DataFrame, path: str, available_now: bool = False) -> StreamingQuery:
    """The running query that writes the distinct rows of each batch of ``changes`` below ``path``, with its checkpoint beside them; it goes on where it
    stopped if it is started again. ``path`` must be shared by all executors."""
    schema = changes.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    changes.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")
    made = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return (made.trigger(availableNow=True) if available_now else made).start()


def current(spark: SparkSession, path: str, keys: list[str], ddl: str) -> DataFrame:
    """Each key's row by those that ``started`` wrote below ``path``: nodes merged of their records, edges as they were last."""
    schema = sc._ddl(ddl)
    names = [f.name for f in schema]
    rows = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    if keys == NODE_KEYS:
        return graph.merge_nodes(rows.drop("batch")).select(*names)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in names if c not in keys]), "batch").alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in names])


def current_graph(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all graphs so far: ends that exist, no weaker reverses, relation ids filled by place."""
    nodes = current(spark, nodes_path, NODE_KEYS, sc.NODE_DDL)
    return nodes, graph.clean_edges(current(spark, edges_path, EDGE_KEYS, sc.EDGE_DDL), nodes)
