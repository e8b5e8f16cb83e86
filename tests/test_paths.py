import random

from helpers import UNIT, alive, best, graph, random_graphs, simple_paths
from pyspark.sql import functions as F

from eventloom.operators import analytics, intervene, paths, scenario
from eventloom.operators import graph as gr
from eventloom.sources.storage import kept


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_unit_graph(spark):
    nodes, edges = graph(spark, UNIT)
    adj = gr.adjacency(edges)
    found = {(r.src, r.dst): r for r in paths.best_paths(adj, 5).collect()}
    assert found["A", "D"].path == ["A", "B", "D"] and abs(found["A", "D"].p - 0.765) < 1e-12 and found["A", "D"].rids == ["R1", "R3"]
    assert sum(1 for s, d in found if d == "D") == 3
    pairs = spark.createDataFrame([("g", "F", "G"), ("g", "B", "D"), ("g", "A", "D"), ("g", "A", "A"), ("g", "A", "Z")], "graph_id string, cause string, effect string")
    m = {(r.cause, r.effect): r for r in intervene.measures(nodes, edges, pairs).collect()}
    assert m["F", "G"].pn == 1.0 and m["F", "G"].alt == []
    assert m["B", "D"].pn == 0.44 and m["B", "D"].alt == ["A", "C", "D"] and m["B", "D"].ps == 0.85 and abs(m["B", "D"].pns - 0.374) < 1e-12
    assert m["A", "D"].pn == 1.0 and m["A", "A"].pn == 0 and m["A", "Z"].pn == 0
    causes = spark.createDataFrame([("g", "A")], "graph_id string, cause string")
    live = intervene.alive(nodes, edges, causes)
    assert rows(live, "event_id") == [("E",), ("F",), ("G",)]
    assert rows(intervene.dead(nodes, causes, live), "event_id") == [("A",), ("B",), ("C",), ("D",)]
    tree = scenario.tree(adj, causes.withColumnRenamed("cause", "event_id"), 3)
    assert tree.where("depth = 1").count() == 2
    text = scenario.rendered(tree, nodes).first().text
    assert text == "A（p=1.00）\n├─ B（p=0.90）\n│  └─ D（p=0.77）\n└─ C（p=0.80）\n   └─ D（p=0.56）"


def test_paths_and_interventions_against_brute_force(spark):
    rng = random.Random(5)
    made = list(random_graphs(rng, 40))
    nodes = edges = None
    for i, (names, links) in enumerate(made):
        n, e = graph(spark, links, names, f"g{i}")
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    nodes, edges = kept(nodes, "nodes"), kept(edges, "edges")
    adj = gr.adjacency(edges)
    got = {(r.graph_id, r.src, r.dst): (r.p, r.path) for r in paths.best_paths(adj, 3).collect()}
    every = {}
    for r in paths.all_paths(adj, 3).collect():
        every.setdefault((r.graph_id, r.src, r.dst), []).append((tuple(r.ords), r.path))
    causes = nodes.select("graph_id", F.col("event_id").alias("cause"))
    live = {}
    for r in intervene.alive(nodes, edges, causes).collect():
        live.setdefault((r.graph_id, r.cause), set()).add(r.event_id)
    for i, (names, links) in enumerate(made):
        for s in names:
            assert live.get((f"g{i}", s), set()) == alive(names, links, s)
            for t in names:
                if s != t:
                    want = best(links, s, t, 3)
                    assert (want is None) == ((f"g{i}", s, t) not in got)
                    if want is not None:
                        assert abs(got[f"g{i}", s, t][0] - want) < 1e-12
                        assert [p for _, p in sorted(every[f"g{i}", s, t])] == [p for p, _ in simple_paths(links, s, t, 3)]


def test_pagerank_of_the_published_graph(spark):
    links = [("R001", "E001", "E002", 0.9), ("R002", "E001", "E003", 0.9), ("R003", "E001", "E005", 0.88), ("R004", "E002", "E004", 0.8), ("R005", "E003", "E004", 0.82), ("R006", "E003", "E006", 0.86), ("R007", "E004", "E006", 0.84)]
    nodes, edges = graph(spark, links)
    top = analytics.most_central(analytics.pagerank(nodes, edges), nodes).orderBy("place").collect()
    assert [(r.event_id, round(r["rank"], 4)) for r in top] == [("E006", 0.3365), ("E004", 0.2331), ("E002", 0.1141)]
    stats = analytics.statistics(nodes, edges).first()
    assert (stats.density, stats.n_roots, stats.n_leaves, stats.max_in, stats.max_out) == (0.2333, 1, 2, 2, 3)
    chains = paths.chains(paths.best_paths(gr.adjacency(edges), 5), nodes, "dst").where("dst = 'E006'").orderBy("rank").collect()
    assert [(r.src, r.rids) for r in chains] == [("E003", ["R006"]), ("E004", ["R007"]), ("E001", ["R002", "R006"]), ("E002", ["R004", "R007"])]


def test_pagerank_that_does_not_converge(spark):
    """Too few steps for the weighted ranks: the ranks without weights, or zeros."""
    star = [("R1", "A", "B", 0.9), ("R2", "B", "A", 0.1), ("R3", "B", "C", 0.9), ("R4", "C", "B", 0.5)]
    nodes, edges = graph(spark, star)
    done = {r.event_id: r["rank"] for r in analytics.pagerank(nodes, edges).collect()}
    assert abs(sum(done.values()) - 1) < 1e-9 and done["B"] > done["C"] > done["A"]
    assert {r["rank"] for r in analytics.pagerank(nodes, edges, most=2).collect()} == {0.0}
    even = [("R1", "A", "B", 0.9), ("R2", "B", "C", 0.5), ("R3", "C", "A", 0.5), ("R4", "A", "C", 0.0), ("R5", "C", "B", 0.0), ("R6", "B", "A", 0.0)]
    n2, e2 = graph(spark, even)
    assert {round(r["rank"], 9) for r in analytics.pagerank(n2, e2, most=2).collect()} == {round(1 / 3, 9)}


def test_probabilities_without_paths(spark):
    rng = random.Random(8)
    for i, (names, links) in enumerate(random_graphs(rng, 6)):
        nodes, edges = graph(spark, links, names, f"g{i}")
        adj = gr.adjacency(edges)
        want = {(r.src, r.dst): r.p for r in paths.best_paths(adj, 4).collect()}
        assert {(r.src, r.dst): r.p for r in paths.best_probability(adj, 4).collect()} == want
        ends = nodes.where("node_ord < 2").select("graph_id", "event_id")
        some = {(r.src, tuple(r.path)) for r in paths.all_paths(adj, 3, None, ends).collect()}
        assert some == {(r.src, tuple(r.path)) for r in paths.all_paths(adj, 3).collect() if r.dst in names[:2]}


def test_trees_unroll_loops_and_keep_five_hundred(spark):
    nodes, edges = graph(spark, [("R1", "A", "B", 1.0), ("R2", "B", "A", 0.5)])
    start = spark.createDataFrame([("g", "A")], "graph_id string, event_id string")
    assert scenario.tree(gr.adjacency(edges), start, 3).count() == 4
    dense = [(f"R{i}{j}", f"x{i}", f"x{j}", 0.5) for i in range(9) for j in range(9) if i != j]
    n2, e2 = graph(spark, dense)
    tree = scenario.tree(gr.adjacency(e2), spark.createDataFrame([("g", "x0")], "graph_id string, event_id string"), 3)
    assert tree.count() == 500


def test_empty_graphs(spark):
    nodes, edges = graph(spark, UNIT)
    none_n, none_e = nodes.limit(0), edges.limit(0)
    adj = gr.adjacency(none_e)
    assert paths.best_paths(adj, 3).count() == 0 and analytics.pagerank(none_n, none_e).count() == 0
    assert gr.roots(nodes, none_e).count() == 7 and analytics.statistics(none_n, none_e).count() == 0
