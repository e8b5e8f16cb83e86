"""Graphs built and cleaned: merged nodes, edges without dangling ends, loops, repeats and weaker reverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.numbers import edge_confidence
from eventloom.operators import numbering

FILLED = ["trigger", "event_type", "time", "location"]
ENDS = ["cause_event_id", "effect_event_id"]


def _conf(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def merge_nodes(events: DataFrame) -> DataFrame:
    """One node for each (graph_id, event_id), at its first place.

    A later record becomes the main one if it has more arguments, or as many and a longer mention;
    empty fields of the main one are filled from the other, record by record, and the confidence is
    the largest. The fold runs over the records of one id only, inside one aggregate; the ids that
    occur once (nearly all) aren't folded.
    """
    columns = [c for c in events.columns if c not in ("graph_id", "event_id")]
    record = F.struct("node_ord", *[c for c in columns if c != "node_ord"])
    grouped = events.groupBy("graph_id", "event_id").agg(F.array_sort(F.collect_list(record)).alias("_r"))

    def better(new: Column, old: Column) -> Column:
        n, o = F.coalesce(F.size(new["arguments"]), F.lit(0)), F.coalesce(F.size(old["arguments"]), F.lit(0))
        return (n > o) | ((n == o) & (F.coalesce(F.length(new["mention"]), F.lit(0)) > F.coalesce(F.length(old["mention"]), F.lit(0))))

    def step(old: Column, new: Column) -> Column:
        main = F.when(better(new, old), new).otherwise(old)
        other = F.when(better(new, old), old).otherwise(new)
        value = {
            "node_ord": old["node_ord"],
            "confidence": F.greatest(_conf(main["confidence"]), _conf(other["confidence"])),
            **{c: F.when(F.coalesce(main[c], F.lit("")) == "", F.coalesce(F.nullif(other[c], F.lit("")), main[c])).otherwise(main[c]) for c in FILLED},
        }
        return F.struct(*[value.get(c, main[c]).alias(c) for c in ["node_ord", *[c for c in columns if c != "node_ord"]]])

    merged = F.when(F.size("_r") == 1, F.col("_r")[0]).otherwise(F.aggregate(F.slice("_r", F.lit(2), F.size("_r")), F.col("_r")[0], step))
    return grouped.withColumn("_m", merged).select("graph_id", "event_id", *[F.col(f"_m.{c}").alias(c) for c in columns])


def existing(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations whose two ends are nodes of their graph."""
    out = relations
    for end in ENDS:
        out = out.join(nodes.select("graph_id", F.col("event_id").alias(end)), ["graph_id", end], "left_semi")
    return out


def strongest(relations: DataFrame) -> DataFrame:
    """No loops; of repeated edges the most confident, of equals the first, at the first one's place."""
    key = Window.partitionBy("graph_id", *ENDS)
    ranked = relations.where(F.col(ENDS[0]) != F.col(ENDS[1])).withColumn("_n", F.row_number().over(key.orderBy(_conf(F.col("confidence")).desc(), "edge_ord"))).withColumn("_first", F.min("edge_ord").over(key))
    return ranked.where("_n = 1").withColumn("edge_ord", F.col("_first")).drop("_n", "_first")


def no_weaker_reverse(edges: DataFrame) -> DataFrame:
    """Without edges whose reverse is strictly more confident; ties keep both.

    Both directions of a pair meet in one partition by their unordered ends: no self-join.
    """
    pair = Window.partitionBy("graph_id", F.least(*ENDS), F.greatest(*ENDS))
    return edges.withColumn("_most", F.max(_conf(F.col("confidence"))).over(pair)).where(_conf(F.col("confidence")) >= F.col("_most")).drop("_most")


def clean_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dangling ends, loops, repeats and weaker reverses go; empty relation ids are filled by position."""
    kept = no_weaker_reverse(strongest(existing(relations, nodes)))
    placed = numbering.placed(kept, "graph_id", ["edge_ord"], "_place", numbering.large(relations, "graph_id"))
    return placed.withColumn("relation_id", F.when(F.coalesce("relation_id", F.lit("")) == "", F.format_string("R%03d", F.col("_place"))).otherwise(F.col("relation_id"))).drop("_place")


def build(events: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every graph."""
    nodes = merge_nodes(events)
    return nodes, clean_edges(relations, nodes)


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, rid, p, ord): ``ord`` is the edge's place among its source's edges."""
    place = F.row_number().over(Window.partitionBy("graph_id", "cause_event_id").orderBy("edge_ord")).cast("int")
    return edges.select("graph_id", F.col("cause_event_id").alias("src"), F.col("effect_event_id").alias("dst"), F.col("relation_id").alias("rid"), edge_confidence(F.col("confidence")).alias("p"), place.alias("ord"))


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_count, edge_count) of every graph that has nodes."""
    counts = nodes.select("graph_id", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select("graph_id", F.lit(0).alias("n"), F.lit(1).alias("e")))
    return counts.groupBy("graph_id").agg(F.sum("n").alias("node_count"), F.sum("e").alias("edge_count")).where("node_count > 0")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, event_id, in_degree, out_degree) of every node."""
    zero, one = F.lit(0), F.lit(1)
    rows = (
        nodes.select("graph_id", "event_id", zero.alias("i"), zero.alias("o"), one.alias("own"))
        .unionByName(edges.select("graph_id", F.col("effect_event_id").alias("event_id"), one.alias("i"), zero.alias("o"), zero.alias("own")))
        .unionByName(edges.select("graph_id", F.col("cause_event_id").alias("event_id"), zero.alias("i"), one.alias("o"), zero.alias("own")))
    )
    return rows.groupBy("graph_id", "event_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("own").alias("_own")).where("_own > 0").drop("_own")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, event_id, node_ord) of nodes without a cause, isolated ones included."""
    caused = edges.select("graph_id", F.col("effect_event_id").alias("event_id")).distinct()  # a row for each event moves, not for each edge
    return nodes.select("graph_id", "event_id", "node_ord").join(caused, ["graph_id", "event_id"], "left_anti")
