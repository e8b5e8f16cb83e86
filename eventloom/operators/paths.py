"""Hop-bounded paths and their probabilities, for all graphs at once.

Levels are unrolled in one lazy plan: level h+1 joins level h with the edges of its ends. The
best-path table keeps one path for each (graph, source, target) and level, so it holds at most
nodes^2 * hops rows: as confidences are at most 1, the best path of a bound is made of best
paths. The all-path table keeps every simple path and is always started from given sources.
Equal probabilities are ordered by ``ords``, the places of the edges among their sources' edges:
depth-first order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.sources.storage import joined_in_place, kept, partitions

KEYS = ["graph_id", "src", "dst"]
#: Edges of pairs, and of sources, for each partition that these are dealt out to.
PAIR_ROWS, STEP_ROWS = 50_000, 50_000
#: So few events are broadcast.
FEW = 10_000


def _start(adj: DataFrame, sources: DataFrame | None) -> DataFrame:
    first = adj.where(F.col("src") != F.col("dst"))
    if sources is not None:
        first = first.join(sources.select("graph_id", F.col("event_id").alias("src")).distinct(), ["graph_id", "src"], "left_semi")
    return first.select("graph_id", "src", "dst", F.array("src", "dst").alias("path"), F.array("rid").alias("rids"), F.array("ord").alias("ords"), "p", F.lit(1).alias("hops"))


def _next(level: DataFrame, adj: DataFrame) -> DataFrame:
    step = adj.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("rid").alias("_rid"), F.col("p").alias("_p"), F.col("ord").alias("_ord"))
    return (
        level.join(step, ["graph_id", "dst"])
        .where(~F.array_contains("path", F.col("_to")))
        .select("graph_id", "src", F.col("_to").alias("dst"), F.array_append("path", F.col("_to")).alias("path"), F.array_append("rids", F.col("_rid")).alias("rids"), F.array_append("ords", F.col("_ord")).alias("ords"), (F.col("p") * F.col("_p")).alias("p"), (F.col("hops") + 1).alias("hops"))
    )


def source_steps(adj: DataFrame, hops: int) -> DataFrame:
    """(graph_id, src, node, _to, _rid, _p, _ord): for every source the edges that its walks of up to ``hops`` edges take, each once, and for every
    node they meet before their last edge a row without ``_to``, by which paths that end there stay; dealt out by source.

    Paths of all sources then grow where they lie. An edge moves once to each source that can use it, as a narrow row; a path, which holds all its
    ids, would move at each level, and again with each path that shares its edges. ``adj`` is written.
    """
    steps = adj.where("src <> dst").select("graph_id", F.col("src").alias("node"), F.col("dst").alias("_to"), F.col("rid").alias("_rid"), F.col("p").alias("_p"), F.col("ord").alias("_ord"))
    columns, at, n = ["graph_id", "src", "node", "_to", "_rid", "_p", "_ord"], ["graph_id", "node"], partitions(adj, PAIR_ROWS)
    out = steps.withColumn("src", F.col("node")).select(*columns)
    if hops > 1:
        near = steps.select(*at, "_to").repartition(n, *at).distinct()
        front = near.select("graph_id", F.col("node").alias("src"), F.col("_to").alias("node")).repartition(n, *at)
        fronts = [front]
        for _ in range(hops - 2):
            front = front.join(near, at).where("_to <> src").select("graph_id", "src", F.col("_to").alias("node")).repartition(n, *at).distinct()
            fronts.append(front)
        stay = steps.select("graph_id", F.col("_to").alias("node")).distinct()
        dealt = steps.unionByName(stay, allowMissingColumns=True).repartition(n, *at)
        with joined_in_place(adj.sparkSession):
            out = kept(out.unionByName(reduce(DataFrame.unionByName, fronts).distinct().join(dealt, at).select(*columns)), "source-steps")
    return out.repartition(partitions(out, STEP_ROWS) if hops > 1 else n, "graph_id", "src")


def first_steps(steps: DataFrame) -> DataFrame:
    """The paths of one edge among ``source_steps``."""
    return steps.where("node = src").select("graph_id", "src", F.col("_to").alias("dst"), F.array("src", "_to").alias("path"), F.array("_rid").alias("rids"), F.array("_ord").alias("ords"), F.col("_p").alias("p"), F.lit(1).alias("hops"))


def _best_in_place(adj: DataFrame, hops: int) -> DataFrame:
    """``best_paths`` of all sources, written: each pair's best path so far stays, its best one of the last level goes on."""
    steps = source_steps(kept(adj, "path-edges"), hops)
    made = F.struct((-F.col("p")).alias("m"), "ords", "path", "rids", "hops")
    level = first_steps(steps).groupBy(*KEYS).agg(F.min(made).alias("_open")).withColumn("_best", F.col("_open"))
    longer = F.struct(
        (F.col("_open.m") * F.col("_p")).alias("m"), F.array_append("_open.ords", F.col("_ord")).alias("ords"), F.array_append("_open.path", F.col("_to")).alias("path"),
        F.array_append("_open.rids", F.col("_rid")).alias("rids"), (F.col("_open.hops") + 1).alias("hops"),
    )
    goes = F.col("_to").isNotNull()
    for _ in range(hops - 1):
        met = level.join(steps.withColumnRenamed("node", "dst"), KEYS).where(~goes | ~F.array_contains("_open.path", F.col("_to")))
        grown = met.select("graph_id", "src", F.coalesce("_to", "dst").alias("dst"), F.when(goes, longer).alias("_open"), F.when(~goes, F.col("_best")).alias("_best"))
        level = grown.groupBy(*KEYS).agg(F.min("_open").alias("_open"), F.min("_best").alias("_best")).withColumn("_best", F.least("_best", "_open"))
    b = F.col("_best")
    with joined_in_place(adj.sparkSession):
        return kept(level.select(*KEYS, b["path"].alias("path"), b["rids"].alias("rids"), b["ords"].alias("ords"), (-b["m"]).alias("p"), b["hops"].alias("hops")), "best-paths")


def _best(level: DataFrame) -> DataFrame:
    pick = F.min(F.struct((-F.col("p")).alias("m"), "ords", "path", "rids", "hops")).alias("b")
    return level.groupBy(*KEYS).agg(pick).select(*KEYS, F.col("b.path").alias("path"), F.col("b.rids").alias("rids"), F.col("b.ords").alias("ords"), (-F.col("b.m")).alias("p"), F.col("b.hops").alias("hops"))


def _distance(adj: DataFrame, hops: int, targets: DataFrame) -> DataFrame:
    """(graph_id, dst, _need): how many edges, fewer than ``hops``, a node has to go to the nearest target; written."""
    ends = targets.select("graph_id", F.col("event_id").alias("dst")).distinct()
    back = adj.select("graph_id", F.col("src").alias("_from"), "dst").distinct()
    front, fronts = ends, [ends.withColumn("_need", F.lit(0))]
    for need in range(1, hops):
        front = front.join(back, ["graph_id", "dst"]).select("graph_id", F.col("_from").alias("dst")).distinct()
        fronts.append(front.withColumn("_need", F.lit(need)))
    return kept(reduce(DataFrame.unionByName, fronts).groupBy("graph_id", "dst").agg(F.min("_need").alias("_need")), "target-distance")


def all_paths(adj: DataFrame, hops: int, sources: DataFrame | None = None, targets: DataFrame | None = None, between: DataFrame | None = None) -> DataFrame:
    """(graph_id, src, dst, path, rids, ords, p, hops): every simple path of up to ``hops`` edges; with
    ``targets`` (graph_id, event_id) those that end there, and none goes on that can't reach one in time; with
    ``between``, ``inner`` of the graph, only paths that go on move to the next level."""
    level = _start(adj, sources)
    if targets is None:
        out, step = level, adj if between is None else _through(adj, between, "src")
        for _ in range(hops - 1):
            level = _next(level if between is None else _through(level, between, "dst"), step)
            out = out.unionByName(level)
        return out
    far = _distance(adj, hops, targets)
    in_time = lambda df, used: df.join(far, ["graph_id", "dst"]).where(F.col("_need") <= hops - used)
    level = in_time(level, 1)
    out = level.where("_need = 0").drop("_need")
    for used in range(2, hops + 1):
        level = in_time(_next(level.drop("_need"), adj), used)
        out = out.unionByName(level.where("_need = 0").drop("_need"))
    return out


def best_paths(adj: DataFrame, hops: int, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The same columns: the likeliest path of each (source, target), of equals the first depth-first; with
    ``targets`` those that end there, by paths that can reach one in time. Of all sources and targets, paths grow where
    their source's edges lie, and are written."""
    if sources is None and targets is None:
        return _best_in_place(adj, hops)
    far = None if targets is None else _distance(adj, hops, targets)
    in_time = lambda df, used: df if far is None else df.join(far.where(F.col("_need") <= hops - used), ["graph_id", "dst"], "left_semi")
    level = _best(in_time(_start(adj, sources), 1))
    out = level
    for used in range(2, hops + 1):
        level = _best(in_time(_next(level, adj), used))
        out = out.unionByName(level)
    if targets is not None:
        out = out.join(targets.select("graph_id", F.col("event_id").alias("dst")).distinct(), ["graph_id", "dst"], "left_semi")
    return _best(out)


def inner(adj: DataFrame) -> DataFrame:
    """(graph_id, event_id) of events with causes and effects, written; broadcast if they are few: only through these do paths go on."""
    ends = adj.select("graph_id", F.col("dst").alias("src")).distinct()
    out = kept(adj.select("graph_id", "src").distinct().join(ends, ["graph_id", "src"], "left_semi").withColumnRenamed("src", "event_id"), "inner")
    return F.broadcast(out) if out.count() <= FEW else out


def _through(df: DataFrame, between: DataFrame, end: str) -> DataFrame:
    return df.join(between.withColumnRenamed("event_id", end), ["graph_id", end], "left_semi")


def further(adj: DataFrame, hops: int, between: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(graph_id, src, dst, p): the likeliest walk of exactly h edges for each h from 2 to ``hops``, begun by the edges ``first``, through the events ``between``.

    Rows that end elsewhere go nowhere, so they don't move; in shallow graphs these are nearly all.
    """
    step = _through(adj, between, "src").select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("p").alias("_p"))
    level = _through((adj if first is None else first).where(F.col("src") != F.col("dst")), between, "dst").groupBy(*KEYS).agg(F.max("p").alias("p"))
    levels = [level.limit(0)]
    for _ in range(hops - 1):
        level = _through(level, between, "dst").join(step, ["graph_id", "dst"]).where(F.col("_to") != F.col("src")).groupBy("graph_id", "src", F.col("_to").alias("dst")).agg(F.max(F.col("p") * F.col("_p")).alias("p"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def best_probability(adj: DataFrame, hops: int, sources: DataFrame | None = None, between: DataFrame | None = None) -> DataFrame:
    """(graph_id, src, dst, p): ``best_paths`` without the paths, for what needs probabilities only.

    Rows are keys and a number, so every level is a hash aggregate. A walk that comes back to a node is no
    likelier than the path without the loop, so walks needn't be kept apart; none comes back to its source.
    With ``between``, ``inner`` of the graph, only rows that go on move to the next level; targets' rows lie together then.
    """
    first = adj.where(F.col("src") != F.col("dst"))
    if sources is not None:
        first = first.join(sources.select("graph_id", F.col("event_id").alias("src")).distinct(), ["graph_id", "src"], "left_semi")
    if between is not None:
        out = first.select(*KEYS, "p").unionByName(further(adj, hops, between, first).select(*KEYS, "p"))
        return out.repartition("graph_id", "dst").groupBy(*KEYS).agg(F.max("p").alias("p"))
    step = adj.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("p").alias("_p"))
    level = first.groupBy(*KEYS).agg(F.max("p").alias("p"))
    out = level
    for _ in range(hops - 1):
        level = level.join(step, ["graph_id", "dst"]).where(F.col("_to") != F.col("src")).groupBy("graph_id", "src", F.col("_to").alias("dst")).agg(F.max(F.col("p") * F.col("_p")).alias("p"))
        out = out.unionByName(level)
    return out.groupBy(*KEYS).agg(F.max("p").alias("p"))


def top_k(paths: DataFrame, k: int, by: list | None = None, cap: int | None = None, also: Column | None = None) -> DataFrame:
    """The k best paths of each (source, target), numbered by ``rank``; among the first ``cap`` depth-first if given; rows that are ``also`` stay."""
    key = Window.partitionBy(*KEYS)
    if cap is not None:
        paths = paths.withColumn("_d", F.row_number().over(key.orderBy("ords"))).where(F.col("_d") <= cap).drop("_d")
    order = by or [F.col("p").desc()]
    best = F.col("rank") <= k
    return paths.withColumn("rank", F.row_number().over(key.orderBy(*order, "ords"))).where(best if also is None else best | also)


def geometric(p: Column, hops: Column) -> Column:
    """The geometric mean of a path's confidences."""
    return F.when(hops > 0, F.pow(p, F.lit(1.0) / hops)).otherwise(0.0)


def top_paths(paths: DataFrame, k: int = 6, cap: int | None = 300, also: Column | None = None) -> DataFrame:
    """The k best by geometric mean, then fewer hops, among the first ``cap`` depth-first, if given."""
    return top_k(paths.withColumn("score", geometric(F.col("p"), F.col("hops"))), k, [F.col("score").desc(), "hops"], cap, also)


def root_chains(paths: DataFrame, roots: DataFrame, k: int = 6, cap: int = 300) -> DataFrame:
    """For each target the k best chains from root events, by geometric mean, then more hops.

    Chains move once for both windows: a target's lie together, so those of each source do."""
    own = roots.select("graph_id", F.col("event_id").alias("src"), "node_ord")
    capped = paths.join(own, ["graph_id", "src"]).repartition("graph_id", "dst").withColumn("_d", F.row_number().over(Window.partitionBy(*KEYS).orderBy("ords"))).where(F.col("_d") <= cap)
    order = Window.partitionBy("graph_id", "dst").orderBy(F.col("score").desc(), F.col("hops").desc(), "node_ord", "ords")
    return capped.withColumn("score", geometric(F.col("p"), F.col("hops"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_d", "node_ord")


def chains(best: DataFrame, nodes: DataFrame, end: str, most: int | None = None) -> DataFrame:
    """``best`` ranked for each target (end='dst': causes) or source (end='src': effects): by
    probability, then fewer hops, then the other end's place; with ``most`` the first so many, and only what may be one of them meets its place."""
    other = "src" if end == "dst" else "dst"
    if most is not None:
        rough = F.rank().over(Window.partitionBy("graph_id", end).orderBy(F.col("p").desc(), "hops"))
        best = best.withColumn("_r", rough).where(F.col("_r") <= most).drop("_r")
    placed = best.join(nodes.select("graph_id", F.col("event_id").alias(other), "node_ord"), ["graph_id", other])
    order = Window.partitionBy("graph_id", end).orderBy(F.col("p").desc(), "hops", "node_ord")
    ranked = placed.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def noisy_or(best: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(graph_id, dst, p): the chance that at least one of the sources reaches the target; all rows' sources if none are given."""
    own = best if sources is None else best.join(sources.select("graph_id", F.col("event_id").alias("src")).distinct(), ["graph_id", "src"], "left_semi")
    return own.groupBy("graph_id", "dst").agg((F.lit(1.0) - F.product(F.lit(1.0) - F.col("p"))).alias("p"))


def path_probability(paths: DataFrame, adj: DataFrame) -> DataFrame:
    """``paths`` (graph_id, path_id, path) with ``p``, the product along the path; null if an edge is missing, 1 for fewer than two nodes."""
    steps = (
        paths.where(F.size("path") > 1)
        .select("graph_id", "path_id", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(i, path[i - 1] AS src, path[i] AS dst))")).alias("s"))
        .select("graph_id", "path_id", "s.*")
    )
    joined = steps.join(adj.select("graph_id", "src", "dst", F.col("p").alias("_p")), ["graph_id", "src", "dst"], "left")
    folded = joined.groupBy("graph_id", "path_id").agg(F.expr("aggregate(array_sort(collect_list(struct(i, _p))), 1D, (acc, x) -> acc * x._p)").alias("p"), (F.count("_p") == F.count("*")).alias("_all"))
    return paths.join(folded, ["graph_id", "path_id"], "left").withColumn("p", F.when(F.size("path") < 2, 1.0).when(F.col("_all"), F.col("p"))).drop("_all")
