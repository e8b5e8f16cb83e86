"""Interventions: what falls if an event had not happened, and how necessary and sufficient it was."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.numbers import exact_round
from eventloom.operators import dominators as dm
from eventloom.operators import graph as gr
from eventloom.operators import paths as pt
from eventloom.sources.storage import kept, written

PAIR = ["graph_id", "cause"]


def reached(start: DataFrame, edges: DataFrame, keys: list[str], barred: str | None = None, levels: int | None = None) -> DataFrame:
    """(*keys, event_id) reachable from the rows of ``start``, themselves included; keys hold graph_id.

    Level by level over all graphs at once, until no graph gains a node, or for ``levels`` levels.
    Nodes equal to the column ``barred`` are never entered.
    """
    steps = kept(edges.select("graph_id", F.col("cause_event_id").alias("event_id"), F.col("effect_event_id").alias("_to")).distinct(), "steps")
    spark, start = steps.sparkSession, start.select(*keys, "event_id").distinct()
    fronts = [written(start, "front")]  # a level's new rows each; earlier ones are never written again
    read = lambda *paths: spark.read.schema(start.schema).parquet(*paths)
    level = 0
    while levels is None or level < levels:
        out = read(fronts[-1]).join(steps, ["graph_id", "event_id"])
        if barred:
            out = out.where(F.col("_to") != F.col(barred))
        found = out.select(*keys, F.col("_to").alias("event_id")).distinct().join(read(*fronts), [*keys, "event_id"], "left_anti")
        front = written(found, "front")
        if read(front).isEmpty():
            break
        fronts.append(front)
        level += 1
    return read(*fronts)


def above(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that lead to a target (graph_id, event_id), themselves included, and all edges into them: what ``measures`` of targets as effects depends on."""
    back = edges.select("graph_id", F.col("effect_event_id").alias("cause_event_id"), F.col("cause_event_id").alias("effect_event_id"))
    up = reached(targets, back, ["graph_id"])
    return nodes.join(up, ["graph_id", "event_id"], "left_semi"), kept(edges.join(up.withColumnRenamed("event_id", "effect_event_id"), ["graph_id", "effect_event_id"], "left_semi"), "edges-above")


def alive(nodes: DataFrame, edges: DataFrame, causes: DataFrame, levels: int | None = None) -> DataFrame:
    """(graph_id, cause, event_id): what still happens under do(cause = 0): what a root other than the
    cause reaches without it. Loops that no root reaches are dead anyway."""
    start = causes.select(*PAIR).distinct().join(gr.roots(nodes, edges), "graph_id").where(F.col("event_id") != F.col("cause"))
    return reached(start, edges, PAIR, "cause", levels)


def dead(nodes: DataFrame, causes: DataFrame, alive_: DataFrame) -> DataFrame:
    """(graph_id, cause, event_id, node_ord) of the nodes that aren't alive, the cause included."""
    every = causes.select(*PAIR).distinct().join(nodes.select("graph_id", "event_id", "node_ord"), "graph_id")
    return every.join(alive_, [*PAIR, "event_id"], "left_anti")


def marked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, p, ord, node_ord, root): ``adjacency`` without loops, written, with the source's place and whether it is a root; null where it is no node."""
    caused = edges.select("graph_id", F.col("effect_event_id").alias("src"), F.lit(False).alias("_free")).distinct()
    own = nodes.groupBy("graph_id", F.col("event_id").alias("src")).agg(F.min("node_ord").alias("node_ord"))
    own = own.join(caused, ["graph_id", "src"], "left").withColumn("root", F.coalesce("_free", F.lit(True))).drop("_free")
    return kept(gr.adjacency(edges).where("src <> dst").select("graph_id", "src", "dst", "p", "ord").join(own, ["graph_id", "src"], "left"), "measured-edges")


def _around(chains: DataFrame, depth: int) -> DataFrame:
    """Of the chains to each event the best one and, for each event on that, the best without it: the first of their order that lacks it.

    Of what this leaves of two sets of chains it finds what it would of both together, so later chains are added to earlier results.
    """
    order = Window.partitionBy("graph_id", "event_id").orderBy("m", "node_ord", "ords", "path")
    first = chains.withColumns({"_best": F.first("path").over(order), "_n": F.row_number().over(order)})
    lacks = [(F.size("_best") > i + 1) & ~F.array_contains("path", F.get("_best", F.lit(i))) for i in range(depth)]
    seen = {f"_s{i}": F.count(F.when(c, 1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for i, c in enumerate(lacks)}
    picked = [c & (F.col(f"_s{i}") == 1) for i, c in enumerate(lacks)]
    return first.withColumns(seen).where(reduce(lambda x, y: x | F.coalesce(y, F.lit(False)), picked, F.col("_n") == 1)).select(*chains.columns)


def avoiding_chains(nodes: DataFrame, edges: DataFrame, depth: int = 5, adj: DataFrame | None = None) -> DataFrame:
    """(graph_id, event_id, m, node_ord, ords, path): for every node its best chain from a root within ``depth`` edges
    and, for each node on that, the best one that avoids it; m is the negative probability.

    These, depth + 1 at most for a node, give the best chain around any one event, so no graph is copied for a
    cause. Among equal chains the root of the lowest place counts, then the first depth-first. ``adj`` is ``marked`` of the graph.
    The first level is the roots' edges as they are; later ones follow only chains that the level before found.
    """
    at = ["graph_id", "event_id"]
    adj = marked(nodes, edges) if adj is None else adj
    start = kept(gr.roots(nodes, edges).select(*at, F.lit(-1.0).alias("m"), "node_ord", F.array().cast("array<int>").alias("ords"), F.array("event_id").alias("path")), "chains")
    inner = kept(adj.where("NOT root").select("graph_id", F.col("src").alias("event_id"), "dst", "p", "ord"), "inner-edges")
    step = adj.where("root").select("graph_id", F.col("dst").alias("event_id"), (F.lit(-1.0) * F.col("p")).alias("m"), "node_ord", F.array("ord").alias("ords"), F.array("src", "dst").alias("path"))
    known = front = kept(_around(step, depth), "chains")
    for _ in range(depth - 1):
        step = front.join(inner, at).where(~F.array_contains("path", F.col("dst")))
        step = kept(step.select("graph_id", F.col("dst").alias("event_id"), (F.col("m") * F.col("p")).alias("m"), "node_ord", F.array_append("ords", F.col("ord")).alias("ords"), F.array_append("path", F.col("dst")).alias("path")), "chains")
        if step.isEmpty():
            break
        touched = step.select(*at).distinct()
        before = known.join(touched, at, "left_semi")
        found = kept(_around(step.unionByName(before), depth), "chains")
        front = found.join(before.select(*at, "ords", "path"), [*at, "ords", "path"], "left_anti")
        known = kept(known.join(touched, at, "left_anti").unionByName(found), "chains")
    return start.unionByName(known)


def measures(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, depth: int = 5, best: DataFrame | None = None, alive_: DataFrame | None = None) -> DataFrame:
    """(graph_id, cause, effect, pn, ps, pns, alt, effect_dead) of each pair.

    PN is 1 if the effect dies with the cause, else 1 less the best chain from another root that avoids
    the cause, within ``depth`` edges; 0 for one event with itself or a missing one. PS is the best chain
    from cause to effect. A node is no path to itself. Graphs without pairs are dropped first; what dies
    comes from the graphs' dominator trees, or from ``alive_`` where the caller has it.
    """
    pairs = kept(pairs.select("graph_id", "cause", "effect").distinct(), "pairs")
    ours = pairs.select("graph_id").distinct()
    nodes, edges = (df.join(ours, "graph_id", "left_semi") for df in (nodes, edges))
    if best is None:
        best = pt.best_probability(gr.adjacency(edges), depth, pairs.select("graph_id", F.col("cause").alias("event_id")))
    pick = F.min(F.struct("m", "node_ord", "ords", "path")).alias("b")
    chains = avoiding_chains(nodes, edges, depth).withColumnRenamed("event_id", "effect")
    detour = (
        pairs.join(chains, ["graph_id", "effect"]).where(~F.array_contains("path", F.col("cause")))
        .groupBy(*PAIR, "effect").agg(pick).select(*PAIR, "effect", (-F.col("b.m")).alias("detour"), F.col("b.path").alias("alt"))
    )
    if alive_ is None:
        gone = kept(dm.falls(dm.dominators(nodes, edges), pairs), "falls").where("falls").select(*PAIR, "effect", F.lit(True).alias("_dead"))
        lives = F.col("_dead").isNull()
    else:
        gone = alive_.select(*PAIR, F.col("event_id").alias("effect"), F.lit(True).alias("_alive"))
        lives = F.col("_alive").isNotNull()
    node = nodes.select("graph_id", "event_id").distinct()
    known = pairs
    for side in ("cause", "effect"):
        known = known.join(node.select("graph_id", F.col("event_id").alias(side), F.lit(True).alias(f"_{side}")), ["graph_id", side], "left")
    joined = (
        known.join(gone, [*PAIR, "effect"], "left").join(detour, [*PAIR, "effect"], "left")
        .join(best.select("graph_id", F.col("src").alias("cause"), F.col("dst").alias("effect"), F.col("p").alias("_ps")), [*PAIR, "effect"], "left")
    )
    odd = F.col("cause").eqNullSafe(F.col("effect")) | F.col("_cause").isNull() | F.col("_effect").isNull()
    through = F.size("alt") > 1  # a root is no chain to itself
    pn = F.when(odd, 0.0).when(~lives, 1.0).otherwise(exact_round(F.lit(1.0) - F.when(through, F.col("detour")).otherwise(0.0), 6))
    none = F.array().cast(joined.schema["alt"].dataType)
    return joined.select(*PAIR, "effect", pn.alias("pn"), F.coalesce("_ps", F.lit(0.0)).alias("ps"), F.when(odd | ~lives | ~F.coalesce(through, F.lit(False)), none).otherwise(F.col("alt")).alias("alt"), (~odd & ~lives).alias("effect_dead")).withColumn("pns", F.col("pn") * F.col("ps"))


def edge_measures(nodes: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """``measures`` (graph_id, cause, effect, pn, ps, pns, alt_root, effect_dead) of every edge between two nodes.

    Edges move twice, to their causes and to their effects; chains and the tree are rows of the effect alone and meet them there.
    An effect falls with a direct cause just if that is its parent in the dominator tree: any event between the two would be avoided by the edge.
    """
    adj, side = marked(nodes, edges), ["graph_id", "dst"]
    pairs = adj.where("root IS NOT NULL").select("graph_id", "src", "dst", "p", F.lit(True).alias("_edge"))
    far = pt.further(adj, depth, pt.inner(adj)).withColumn("_edge", F.lit(False))
    pairs = pairs.unionByName(far).repartition(*side).groupBy(*side, "src").agg(F.max("p").alias("ps"), F.max("_edge").alias("_edge")).where("_edge")
    chain = F.struct("m", "node_ord", "ords", "path")
    ways = avoiding_chains(nodes, edges, depth, adj).groupBy("graph_id", F.col("event_id").alias("dst")).agg(F.array_sort(F.collect_list(chain)).alias("_ways"))
    tree = dm.dominators(nodes, edges).nodes.select("graph_id", F.col("event_id").alias("dst"), "parent", F.lit(True).alias("_reached"))
    ends = nodes.select("graph_id", F.col("event_id").alias("dst")).distinct().join(ways, side, "left").join(tree, side, "left")
    way = F.try_element_at(F.filter("_ways", lambda w: ~F.array_contains(w["path"], F.col("src"))), F.lit(1))
    joined = pairs.join(kept(ends, "ways"), side).withColumn("_way", way)
    dead, through = F.col("_reached").isNull() | F.col("parent").eqNullSafe(F.col("src")), F.coalesce(F.size("_way.path") > 1, F.lit(False))
    pn = F.when(dead, 1.0).otherwise(exact_round(F.lit(1.0) + F.when(through, F.col("_way.m")).otherwise(0.0), 6))
    return joined.select(
        "graph_id", F.col("src").alias("cause"), F.col("dst").alias("effect"), pn.alias("pn"), "ps", (pn * F.col("ps")).alias("pns"),
        F.when(~dead & through, F.get("_way.path", F.lit(0))).alias("alt_root"), dead.alias("effect_dead"),
    )
