"""Graph statistics, centrality and view tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.numbers import edge_confidence, exact_round
from eventloom.operators import graph as gr
from eventloom.sources.storage import kept

DAMPING = 0.85
#: Beyond so many graphs no step of a ranking sends a table through the driver.
FEW_GRAPHS = 1000


def _weights(edges: DataFrame, even: bool = False) -> DataFrame:
    """(graph_id, src, dst, w): each source's confidences (or ones, if ``even``) as shares of their sum."""
    value = F.lit(1.0) if even else edge_confidence(F.col("confidence"))
    conf = edges.select("graph_id", F.col("cause_event_id").alias("src"), F.col("effect_event_id").alias("dst"), value.alias("c"))
    total = conf.groupBy("graph_id", "src").agg(F.sum("c").alias("t")).where("t > 0")
    return conf.join(total, ["graph_id", "src"]).select("graph_id", "src", "dst", (F.col("c") / F.col("t")).alias("w"))


def _even(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(graph_id, event_id, n, r, ends): equal ranks, the graph's number of nodes, and whether a node passes nothing on."""
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    gives = weights.select("graph_id", F.col("src").alias("event_id"), F.lit(False).alias("ends")).distinct()
    return nodes.select("graph_id", "event_id").join(sizes, "graph_id").join(gives, ["graph_id", "event_id"], "left").select("graph_id", "event_id", "n", (F.lit(1.0) / F.col("n")).alias("r"), F.coalesce("ends", F.lit(True)).alias("ends"))


def _many(nodes: DataFrame) -> bool:
    return nodes.select("graph_id").distinct().limit(FEW_GRAPHS + 1).count() > FEW_GRAPHS


def _step(rank: DataFrame, weights: DataFrame, damping: float, tolerance: float = 0.0, many: bool = False) -> DataFrame:
    """One power step of rows (graph_id, event_id, n, ends, r, before, done). The mass of nodes that pass nothing on
    spreads evenly over their graph; a graph whose ranks moved by less than nodes * tolerance before is done and stays.

    A graph's sums are aggregates of a row each, joined back: no graph is gathered in a task. Of ``many`` graphs all joins are
    shuffles: a broadcast of each step's sums, however small, would add up in the driver.
    """
    side = lambda df: df.hint("merge") if many else df
    flows = rank.where("NOT done").select("graph_id", F.col("event_id").alias("src"), "r").join(side(weights), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("event_id"), (F.col("r") * F.col("w")).alias("in"))
    got = flows.groupBy("graph_id", "event_id").agg(F.sum("in").alias("got"))
    sums = rank.groupBy("graph_id").agg(F.sum(F.when(F.col("ends"), F.col("r")).otherwise(0.0)).alias("held"), _near(tolerance).alias("near"))
    joined = rank.join(side(got), ["graph_id", "event_id"], "left").join(side(sums), "graph_id")
    new = damping * (F.coalesce("got", F.lit(0.0)) + F.col("held") / F.col("n")) + (1 - damping) / F.col("n")
    done = F.col("done") | F.col("near")
    return joined.select("graph_id", "event_id", "n", "ends", F.when(done, F.col("r")).otherwise(new).alias("r"), F.col("r").alias("before"), done.alias("done"))


def _near(tolerance: float) -> Column:
    """Aggregate: whether a graph's ranks moved by less than nodes * tolerance in the last step."""
    return F.coalesce(F.sum(F.abs(F.col("r") - F.col("before"))) < F.max("n") * tolerance, F.lit(False))


def _first(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    return kept(_even(nodes, weights).withColumns({"before": F.lit(None).cast("double"), "done": F.lit(False)}), "rank")


def pagerank_steps(nodes: DataFrame, edges: DataFrame, steps: int, damping: float = DAMPING) -> DataFrame:
    """(graph_id, event_id, rank) after a fixed number of power steps."""
    weights = kept(_weights(edges), "rank-weights")
    rank = _first(nodes, weights)
    many = _many(rank)
    for _ in range(steps):
        rank = kept(_step(rank, weights, damping, many=many), "rank")
    return rank.select("graph_id", "event_id", F.col("r").alias("rank"))


def _converged(nodes: DataFrame, weights: DataFrame, damping: float, tolerance: float, most: int) -> DataFrame:
    """(graph_id, event_id, r, done): each graph stops once its ranks moved by less than nodes * tolerance in sum."""
    rank = _first(nodes, weights)
    many = _many(rank)
    for _ in range(most):
        rank = kept(_step(rank, weights, damping, tolerance, many), "rank")
        if rank.where("NOT done").isEmpty():
            break
    last = rank.groupBy("graph_id").agg(_near(tolerance).alias("near"))
    return kept(rank.join(last, "graph_id").withColumn("done", F.col("done") | F.col("near")), "rank")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(graph_id, event_id, rank). A graph that hasn't converged after ``most`` steps gets the rank of its edges
    without weights, and zeros if that doesn't converge either."""
    own = nodes.select("graph_id", "event_id")
    rank = _converged(own, kept(_weights(edges), "rank-weights"), damping, tolerance, most)
    late = kept(rank.where("NOT done").select("graph_id").distinct(), "rank-late")
    done = rank.where("done").select("graph_id", "event_id", F.col("r").alias("rank"))
    if late.isEmpty():
        return done
    rest, links = (df.join(late, "graph_id", "left_semi") for df in (own, edges))
    again = _converged(rest, kept(_weights(links, even=True), "rank-weights"), damping, tolerance, most)
    return done.unionByName(again.select("graph_id", "event_id", F.when(F.col("done"), F.col("r")).otherwise(0.0).alias("rank")))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_count, edge_count, density, n_roots, n_leaves, max_in, max_out) of every graph."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    by = gr.degrees(nodes, edges).groupBy("graph_id").agg(
        F.count("*").alias("node_count"), F.sum("out_degree").cast("long").alias("edge_count"),
        one(F.col("in_degree") == 0).alias("n_roots"), one(F.col("out_degree") == 0).alias("n_leaves"), F.max("in_degree").cast("long").alias("max_in"), F.max("out_degree").cast("long").alias("max_out"),
    )
    n = F.col("node_count")
    return by.withColumn("density", F.when(n > 1, exact_round(F.col("edge_count") / (n * (n - 1)), 4)).otherwise(0.0))


def relation_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id", "relation_type").count()


def most_central(ranks: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """(graph_id, event_id, rank, place): the k largest ranks, of equals the first in node order."""
    order = Window.partitionBy("graph_id").orderBy(F.col("rank").desc(), "node_ord")
    return ranks.join(nodes.select("graph_id", "event_id", "node_ord"), ["graph_id", "event_id"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("node_ord")


def view(nodes: DataFrame, edges: DataFrame, chain: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and link rows to draw: category number, symbol size by degree, and whether the link is in ``chain`` (graph_id, relation_id)."""
    per_graph = Window.partitionBy("graph_id")
    deg = gr.degrees(nodes, edges).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    most = F.greatest(F.max("degree").over(per_graph), F.lit(1))
    drawn = deg.withColumn("symbol_size", exact_round(26 + 22 * F.col("degree") / most, 1)).join(nodes, ["graph_id", "event_id"])
    drawn = drawn.withColumn("category", F.dense_rank().over(per_graph.orderBy("event_type")) - 1).select("graph_id", "event_id", "node_ord", "mention", "event_type", "category", "degree", "symbol_size")
    links = edges.select("graph_id", "relation_id", F.col("cause_event_id").alias("source"), F.col("effect_event_id").alias("target"), "relation_type", "confidence")
    if chain is None:
        return drawn, links.withColumn("highlighted", F.lit(False))
    marked = chain.select("graph_id", "relation_id", F.lit(True).alias("highlighted")).distinct()
    return drawn, links.join(marked, ["graph_id", "relation_id"], "left").fillna(False, ["highlighted"])


def badge(confidence):
    """struct<percent, gold> of a confidence."""
    return F.struct(exact_round(confidence * 100, 0).cast("int").alias("percent"), (confidence >= 0.7).alias("gold"))
