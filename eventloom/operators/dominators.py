"""Which events fall with an event: the dominator trees of all graphs at once, in rounds that grow with the logarithm of their depth.

An event falls with another if every chain from a root to it passes that one. The nearest such event is its parent in the
dominator tree, and it falls with just the ancestors there (and itself). The tree begins as any spanning tree from the roots:
each node points to one cause, pointers are doubled to see who gets to a root, and nodes caught in loops point to
a cause outside instead. Then, all nodes together, each one's parent becomes the nearest common ancestor of its causes
in the present tree, until nothing changes: every ancestor that dominates stays one (the way down from an ancestor avoids
those above it), and a tree in which each parent is above all causes is the dominator tree. Loops need no special care.

Ancestors 1, 2, 4, 8 … steps up are tables, made by joining one with itself, so a chain of n events takes about log2(n) joins.
Common ancestors are found by climbing to equal height and then by falling powers of two; subtree sums by as many joins. Rows
are nodes, or nodes with their causes; no row holds a path, and nothing is listed by pairs of cause and event unless asked for.
Events that no root reaches (loops on their own) fall with every event.

An event with two roots among its causes falls with none but itself, and events beyond it fall with just what they would fall with
if it were a root: so it becomes one, and its edges, most of them in shallow graphs, are left out before the tree is begun.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import graph as gr
from eventloom.sources.storage import kept

AT = ["graph_id", "event_id"]


@dataclass(frozen=True)
class Tree:
    """(graph_id, event_id, parent, top, depth) of all reached events, parents of top ones null; ``ups[j]``: (graph_id, event_id, up), 2^j steps up."""

    nodes: DataFrame
    ups: list[DataFrame]


def _ups(parents: DataFrame) -> list[DataFrame]:
    """Ancestors by powers of two of (graph_id, event_id, parent), as far as there are any."""
    ups = [kept(parents.where("parent IS NOT NULL").select(*AT, F.col("parent").alias("up")), "ups")]
    while True:
        last = ups[-1]
        above = last.select("graph_id", F.col("event_id").alias("up"), F.col("up").alias("_up2"))
        twice = kept(last.join(above, ["graph_id", "up"]).select(*AT, F.col("_up2").alias("up")), "ups")
        if twice.isEmpty():
            return ups
        ups.append(twice)


def _tree(parents: DataFrame) -> Tree:
    """The tree of (graph_id, event_id, parent), with depths: what is left to climb after each power of two."""
    ups = _ups(parents)
    depth = parents.select(*AT, "parent", F.col("event_id").alias("_top"), F.lit(0).cast("long").alias("depth"))
    for j in range(len(ups) - 1, -1, -1):
        up = ups[j].withColumnRenamed("event_id", "_top")
        depth = depth.join(up, ["graph_id", "_top"], "left").select(*AT, "parent", F.coalesce("up", "_top").alias("_top"), (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << j).otherwise(0)).alias("depth"))
    return Tree(kept(depth.withColumnRenamed("_top", "top"), "tree"), ups)


def spanning(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """(graph_id, event_id, parent): a tree from the roots over what they reach; ``steps`` is (graph_id, _from, event_id).

    Each round anchors whoever gets to a root by pointers, then lets nodes caught in loops point to an anchored
    cause; it ends when none has one. Without loops the first round anchors all.
    """
    top = roots.select(*AT).distinct()
    pointer = steps.join(top, AT, "left_anti").groupBy(*AT).agg(F.min("_from").alias("parent"))
    known = top.withColumn("parent", F.lit(None).cast(steps.schema["event_id"].dataType))
    loose = kept(pointer, "pointers")
    anchored = [kept(known, "anchored")]
    while True:
        hung, loose = _hung(loose, anchored)
        anchored.append(hung)
        if loose.isEmpty():
            break
        every = _union(anchored).select("graph_id", F.col("event_id").alias("_from"))
        caught = steps.join(loose.select(*AT), AT, "left_semi").join(every, ["graph_id", "_from"], "left_semi").groupBy(*AT).agg(F.min("_from").alias("_to"))
        caught = kept(caught, "caught")
        if caught.isEmpty():
            break
        loose = kept(loose.join(caught, AT, "left").select(*AT, F.coalesce("_to", "parent").alias("parent")), "pointers")
    return kept(_union(anchored), "spanning")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _hung(loose: DataFrame, anchored: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``loose`` pointers in two: those that lead to an anchored node, and the others; pointers are doubled, so in log rounds."""
    ends = _union(anchored).select("graph_id", F.col("event_id").alias("_at"), F.lit(True).alias("_end"))
    # a pointer that has met an anchored node stays there; others jump to where their target points
    jump = kept(loose.select(*AT, F.col("parent").alias("_at")).join(ends, ["graph_id", "_at"], "left").select(*AT, "_at", F.coalesce("_end", F.lit(False)).alias("_end")), "jumps")
    total, most = jump.count(), 1
    while most < 2 * max(total, 1):
        moving = jump.where("NOT _end")
        if moving.isEmpty():
            break
        on = jump.select("graph_id", F.col("event_id").alias("_at"), F.col("_at").alias("_next"), F.col("_end").alias("_next_end"))
        jump = kept(jump.join(on, ["graph_id", "_at"], "left").select(*AT, F.when(F.col("_end"), F.col("_at")).otherwise(F.coalesce("_next", "_at")).alias("_at"), (F.col("_end") | F.coalesce("_next_end", F.lit(False))).alias("_end")), "jumps")
        most *= 2
    done = jump.where("_end").select(*AT)
    return kept(loose.join(done, AT, "left_semi"), "hung"), kept(loose.join(done, AT, "left_anti"), "loose")


def _climbed(tree: Tree, at: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``_u`` of written rows, ``_u`` climbed by ``_climb`` steps: a join for each bit of the longest climb."""
    top = at.agg(F.max("_climb")).first()[0]
    for j in range(min(int(top or 0).bit_length(), len(tree.ups)) - 1, -1, -1):
        high, up = F.col("_climb").bitwiseAND(F.lit(1 << j)) != 0, tree.ups[j].withColumnRenamed("event_id", "_u")
        at = kept(at.join(up, ["graph_id", "_u"], "left").select(*columns, F.when(high, F.col("up")).otherwise(F.col("_u")).alias("_u"), "_climb"), "climb")
    return at.select(*columns, "_u")


def _common(tree: Tree, causes: DataFrame) -> DataFrame:
    """(graph_id, event_id, near): the nearest common ancestor-or-self of each event's causes (graph_id, event_id, _from); null if none."""
    at = kept(causes.join(tree.nodes.select("graph_id", F.col("event_id").alias("_from"), "depth", "top"), ["graph_id", "_from"]), "heights")
    least = kept(at.groupBy(*AT).agg(F.min("depth").alias("_least"), (F.min("top") != F.max("top")).alias("_parted")), "heights")
    none = least.where("_parted").select(*AT, F.lit(None).cast(causes.schema["_from"].dataType).alias("near"))  # under several roots
    least = least.where("NOT _parted").drop("_parted")
    if least.isEmpty():
        return none
    at = at.join(least, AT).select(*AT, F.col("_from").alias("_u"), (F.col("depth") - F.col("_least")).alias("_climb"), "_least")
    at = _climbed(tree, kept(at, "climb"), [*AT, "_least"])
    top = at.agg(F.max("_least")).first()[0]
    bits = int(top or 0).bit_length()
    at = kept(at.select(*AT, "_u").distinct(), "climb")
    differ = lambda c: F.min(c) != F.max(c)
    for j in range(min(bits, len(tree.ups)) - 1, -1, -1):
        higher = at.join(tree.ups[j].withColumnRenamed("event_id", "_u"), ["graph_id", "_u"], "left")
        apart = higher.groupBy(*AT).agg(F.coalesce(differ("up"), F.lit(False)).alias("_apart"))
        at = kept(higher.join(apart, AT).select(*AT, F.when(F.col("_apart"), F.col("up")).otherwise(F.col("_u")).alias("_u")).distinct(), "climb")
    one = at.groupBy(*AT).agg(F.min("_u").alias("_u"), differ("_u").alias("_apart"))
    up = one.join(tree.nodes.select("graph_id", F.col("event_id").alias("_u"), "parent"), ["graph_id", "_u"])
    return none.unionByName(up.select(*AT, F.when(F.col("_apart"), F.col("parent")).otherwise(F.col("_u")).alias("near")))


def _free(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """(graph_id, event_id) of events with two roots among their causes."""
    first = steps.join(roots.withColumnRenamed("event_id", "_from"), ["graph_id", "_from"], "left_semi")
    return first.groupBy(*AT).agg((F.min("_from") != F.max("_from")).alias("_two")).where("_two").select(*AT)


def dominators(nodes: DataFrame, edges: DataFrame) -> Tree:
    """The dominator tree of every graph: of all events that a root reaches."""
    steps = edges.select("graph_id", F.col("cause_event_id").alias("_from"), F.col("effect_event_id").alias("event_id")).where("_from <> event_id")
    roots = kept(gr.roots(nodes, edges).select(*AT).distinct(), "dominator-roots")
    free = kept(_free(roots, steps), "free")
    steps = kept(steps.join(free, AT, "left_anti").distinct(), "dominator-steps")
    parents = spanning(roots.unionByName(free), steps)
    reached = parents.select("graph_id", F.col("event_id").alias("_from"))
    several = steps.join(reached, ["graph_id", "_from"], "left_semi")
    counts = several.groupBy(*AT).agg(F.count("*").alias("_n")).where("_n > 1")
    several = kept(several.join(counts, AT, "left_semi"), "several-causes")
    tree = _tree(parents)
    while True:
        # a parent that is the only cause, or has no parent above, stays
        open_ = kept(several.join(tree.nodes.where("parent IS NOT NULL").select(*AT), AT, "left_semi"), "open")
        if open_.isEmpty():
            return tree
        near = _common(tree, open_)
        moved = kept(tree.nodes.join(near, AT).where(~F.col("near").eqNullSafe(F.col("parent"))).select(*AT, "near", F.lit(True).alias("_moved")), "moved")
        if moved.isEmpty():
            return tree
        tree = _tree(tree.nodes.join(moved, AT, "left").select(*AT, F.when(F.col("_moved"), F.col("near")).otherwise(F.col("parent")).alias("parent")))


def unreached(nodes: DataFrame, tree: Tree) -> DataFrame:
    """(graph_id, event_id) of events that no root reaches."""
    return nodes.select(*AT).distinct().join(tree.nodes.select(*AT), AT, "left_anti")


def falls(tree: Tree, pairs: DataFrame) -> DataFrame:
    """``pairs`` (graph_id, cause, effect) with ``falls``, whether the effect falls with the cause: whether climbing by the difference of depths ends at it.

    An effect that no root reaches falls with any cause.
    """
    of = lambda side, depth: tree.nodes.select("graph_id", F.col("event_id").alias(side), F.col("depth").alias(depth))
    at = pairs.select("graph_id", "cause", "effect").distinct().join(of("effect", "_e"), ["graph_id", "effect"], "left").join(of("cause", "_c"), ["graph_id", "cause"], "left")
    at = at.select("graph_id", "cause", "effect", F.col("effect").alias("_u"), F.col("_e").isNull().alias("_lost"), (F.col("_e") - F.col("_c")).alias("_climb"))
    settled = F.coalesce(F.col("_climb") < 0, F.lit(True)) | F.col("_lost")
    done = at.where(settled).select("graph_id", "cause", "effect", F.col("_lost").alias("falls"))
    at = _climbed(tree, kept(at.where(~settled), "climb"), ["graph_id", "cause", "effect"])
    return done.unionByName(at.select("graph_id", "cause", "effect", F.col("_u").eqNullSafe(F.col("cause")).alias("falls")))


def sizes(nodes: DataFrame, tree: Tree) -> DataFrame:
    """(graph_id, cause, n_dead, first_dead): how many events fall with each event, itself among them, and the least of their ids.

    Of each event, what lies fewer than 2^j steps below is summed for j = 0, 1, 2, …; what falls with every event is added at the end.
    """
    own = tree.nodes.select(*AT, F.lit(1).cast("long").alias("n"), F.col("event_id").alias("first"))
    for up in tree.ups:
        lower = own.join(up, AT).select("graph_id", F.col("up").alias("event_id"), "n", "first")
        own = kept(own.unionByName(lower).groupBy(*AT).agg(F.sum("n").alias("n"), F.min("first").alias("first")), "subtrees")
    known = nodes.select(*AT).distinct()
    lost = kept(unreached(nodes, tree), "lost").groupBy("graph_id").agg(F.count("*").alias("_lost"), F.min("event_id").alias("_first"))
    every = known.join(own, AT, "left").join(lost, "graph_id", "left")
    return every.select("graph_id", F.col("event_id").alias("cause"), (F.coalesce("n", F.lit(0)) + F.coalesce("_lost", F.lit(0))).alias("n_dead"), F.least("first", "_first").alias("first_dead"))


def fallen(nodes: DataFrame, edges: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(graph_id, cause, event_id) of all that falls with each event; as many rows as that is, so ask ``falls`` or ``sizes`` where they do."""
    tree = tree or dominators(nodes, edges)
    own = nodes.select(*AT).distinct()
    pairs = tree.nodes.select(*AT, F.col("event_id").alias("cause"))
    for up in tree.ups:
        far = pairs.withColumnRenamed("event_id", "up").join(up, ["graph_id", "up"]).select(*AT, "cause")
        pairs = kept(pairs.unionByName(far), "fallen")
    lost = unreached(nodes, tree).join(own.select("graph_id", F.col("event_id").alias("cause")), "graph_id")
    return pairs.select("graph_id", "cause", "event_id").unionByName(lost.select("graph_id", "cause", "event_id"))
