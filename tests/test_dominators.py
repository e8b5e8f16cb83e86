"""Dominator trees against deletion, event by event, and on long chains and loops."""

from __future__ import annotations

import random

import pytest

from eventloom.operators import dominators as dm
from eventloom.operators import graph, intervene
from helpers import alive
from helpers import graph as made


def falling(names, edges):
    """{(cause, event)} that a deletion of each cause kills."""
    return {(c, n) for c in names for n in set(names) - alive(names, edges, c)}


def many(spark, graphs):
    nodes, edges = None, None
    for g, (names, es) in graphs.items():
        n, e = made(spark, es or [("R", "none1", "none2", 0.5)], names, g)
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return nodes, edges


@pytest.fixture(scope="module")
def graphs():
    rng, out = random.Random(5), {}
    for i in range(24):
        n = rng.randrange(2, 12)
        names = [f"n{j}" for j in range(n)]
        pairs = {(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(n, 3 * n))}
        if i % 2:
            pairs = {(a, b) for a, b in pairs if int(a[1:]) < int(b[1:])}
        out[f"g{i}"] = (names, [(f"R{k}", a, b, 0.5) for k, (a, b) in enumerate(sorted(pairs))])
    out["ladder"] = ([f"n{j}" for j in range(13)], [(f"R{j}.{d}", f"n{j}", f"n{j + d}", 0.5) for j in range(13) for d in (1, 2) if j + d < 13])
    diamonds = [("R", f"n{3 * j}", f"n{3 * j + d}", 0.5) for j in range(4) for d in (1, 2)] + [("R", f"n{3 * j + d}", f"n{3 * j + 3}", 0.5) for j in range(4) for d in (1, 2)]
    out["diamonds"] = ([f"n{j}" for j in range(13)], diamonds)
    out["loops"] = (["a", "b", "c", "d", "e", "f"], [("1", "a", "b", 0.5), ("2", "b", "c", 0.5), ("3", "c", "b", 0.5), ("4", "c", "d", 0.5), ("5", "e", "f", 0.5), ("6", "f", "e", 0.5), ("7", "e", "d", 0.5)])
    return out


def test_trees_equal_deletion(spark, graphs):
    nodes, edges = many(spark, graphs)
    want = {(g, c, e) for g, (names, es) in graphs.items() for c, e in falling(names, es)}
    tree = dm.dominators(nodes, edges)
    rows = [tuple(r) for r in dm.fallen(nodes, edges, tree).select("graph_id", "cause", "event_id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    per = {}
    for g, c, e in want:
        per.setdefault((g, c), set()).add(e)
    got = {(r["graph_id"], r["cause"]): (r["n_dead"], r["first_dead"]) for r in dm.sizes(nodes, tree).collect()}
    assert got == {k: (len(v), min(v)) for k, v in per.items()}
    pairs = [(g, c, e) for g, (names, _) in graphs.items() for c in names for e in names]
    asked = spark.createDataFrame(pairs, "graph_id string, cause string, effect string")
    assert {(r["graph_id"], r["cause"], r["effect"]) for r in dm.falls(tree, asked).where("falls").collect()} == want and dm.falls(tree, asked).count() == len(pairs)


def test_a_chain_of_a_hundred_thousand_events(spark):
    from pyspark.sql import functions as F

    n = 100_000
    ids = spark.range(n)
    nodes = ids.select(F.lit("g").alias("graph_id"), F.col("id").alias("event_id"), F.col("id").alias("node_ord"))
    edges = spark.range(n - 1).select(F.lit("g").alias("graph_id"), F.col("id").alias("cause_event_id"), (F.col("id") + 1).alias("effect_event_id"))
    tree = dm.dominators(nodes, edges)
    assert len(tree.ups) == 17
    wrong = dm.sizes(nodes, tree).where(F.col("n_dead") != n - F.col("cause")).count() + tree.nodes.where("depth <> event_id").count()
    pairs = spark.createDataFrame([("g", 5, 99_000, True), ("g", 99_000, 5, False), ("g", 7, 7, True)], "graph_id string, cause long, effect long, want boolean")
    got = {(r["cause"], r["effect"]): r["falls"] for r in dm.falls(tree, pairs).collect()}
    assert not wrong and got == {(5, 99_000): True, (99_000, 5): False, (7, 7): True}


def test_measures_by_the_tree(spark, graphs):
    nodes, edges = many(spark, {g: v for g, v in graphs.items() if g in ("g1", "g2", "g3", "loops")})
    pairs = edges.select("graph_id", "cause_event_id", "effect_event_id").toDF("graph_id", "cause", "effect")
    causes = pairs.select("graph_id", "cause")
    by_tree = {tuple(r)[:6] + (r["effect_dead"],) for r in intervene.measures(nodes, edges, pairs, 3).select("graph_id", "cause", "effect", "pn", "ps", "pns", "effect_dead").collect()}
    by_reach = {tuple(r)[:6] + (r["effect_dead"],) for r in intervene.measures(nodes, edges, pairs, 3, alive_=intervene.alive(nodes, edges, causes)).select("graph_id", "cause", "effect", "pn", "ps", "pns", "effect_dead").collect()}
    assert by_tree == by_reach


def test_no_events(spark, graphs):
    nodes, edges = (df.limit(0) for df in many(spark, {"g1": graphs["g1"]}))
    tree = dm.dominators(nodes, edges)
    assert not tree.nodes.count() and not dm.sizes(nodes, tree).count() and not dm.fallen(nodes, edges).count() and graph.roots(nodes, edges).isEmpty()


def test_events_of_two_roots_leave_no_steps(spark, monkeypatch):
    """Most edges of shallow graphs lead to events with several roots: no round reads them."""
    edges = [(f"R{r}{t}", r, f"T{t}", 0.5) for r in "AB" for t in range(9)] + [("X1", "T0", "U", 0.5), ("X2", "A", "U", 0.5), ("X3", "T1", "V", 0.5), ("X4", "V", "W", 0.5), ("X5", "W", "V", 0.5)]
    names = sorted({x for _, a, b, _ in edges for x in (a, b)})
    nodes, links = many(spark, {"g": (names, edges)})
    seen, whole = [], dm.spanning
    monkeypatch.setattr(dm, "spanning", lambda roots, steps: seen.append(steps.count()) or whole(roots, steps))
    got = {(r.cause, r.event_id) for r in dm.fallen(nodes, links).collect()}
    assert seen == [5] and got == {(c, n) for c in names for n in set(names) - alive(names, edges, c)}
