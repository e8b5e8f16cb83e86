"""Graphs whose edges nearly all end in events without effects: what can't go on doesn't move."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventloom.operators import graph as gr
from eventloom.operators import intervene, paths
from helpers import graph

EDGES = [(f"R{r}{t}", r, f"T{t}", 0.1 * (ord(r) - 64)) for r in "ABC" for t in range(6)] + [("X1", "A", "M", 0.5), ("X2", "M", "T0", 0.9), ("X3", "M", "T7", 0.4), ("X4", "T0", "T0", 1.0), ("X5", "T0", "Z", 1.0)]


@pytest.fixture(scope="module")
def shallow(spark):
    return graph(spark, EDGES)


def test_walks_through_inner_events(spark, shallow):
    nodes, edges = shallow
    adj, roots = gr.adjacency(edges), gr.roots(nodes, edges)
    between = paths.inner(adj)
    assert {r.event_id for r in between.collect()} == {"M", "T0"}
    rows = lambda df: sorted(map(tuple, df.select("src", "dst", F.round("p", 12)).collect()))
    assert rows(paths.best_probability(adj, 3, roots, between)) == rows(paths.best_probability(adj, 3, roots))
    assert rows(paths.all_paths(adj, 3, roots, between=between)) == rows(paths.all_paths(adj, 3, roots))


def test_edges_are_measured_by_their_effects(spark, shallow, monkeypatch):
    """The same as of given pairs, and later levels of chains follow new ones only."""
    nodes, edges = shallow
    seen, kept = [], intervene.kept
    monkeypatch.setattr(intervene, "kept", lambda df, name: seen.append((name, kept(df, name))) or seen[-1][1])
    got = intervene.edge_measures(nodes, edges, 3).select("cause", "effect", "pn", "ps", "pns", "effect_dead", "alt_root").collect()
    assert [df.count() for name, df in seen if name == "inner-edges"] == [3]
    pairs = edges.where("cause_event_id <> effect_event_id").select("graph_id", F.col("cause_event_id").alias("cause"), F.col("effect_event_id").alias("effect"))
    want = intervene.measures(nodes, edges, pairs, 3).withColumn("alt_root", F.try_element_at("alt", F.lit(1))).select("cause", "effect", "pn", "ps", "pns", "effect_dead", "alt_root").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
