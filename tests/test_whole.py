"""Queries over whole tables against brute force on the smallest tables."""

import math
import os
import random

import pandas as pd
import pytest

import __spark_entry__ as entry
from eventloom.functions import lexicons as lx
from eventloom.operators import dominators, intervene
from eventloom.plans import catalog
from eventloom.sources.storage import kept
from helpers import alive, best, graph, random_graphs

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def read(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def calibrated(kind, s):
    buckets = lx.CALIBRATION[kind]
    below = [b for b in buckets if b <= s]
    value = buckets.get(round(s, 1), buckets[max(below)] if below else lx.CALIBRATION_BASE[kind])
    return round(min(0.85, max(0.05, value)), 3)


def test_confidence_of_every_order(spark):
    got = {r.o_orderkey: r.confidence for r in entry.queries()["confidence_calibration"](spark, FOLDER).collect()}
    orders = read("orders")
    want = {o.o_orderkey: calibrated(catalog.SCORES[len(o.o_orderpriority) % 10], math.floor(o.o_totalprice / 5000) / 100) for o in orders.itertuples()}
    assert len(got) == len(orders) and got == want


def test_paths_over_every_event(spark):
    got = {(r.graph_id, r.path_id): (r.path, r.p) for r in entry.queries()["path_probability"](spark, FOLDER).collect()}
    sizes, want = read("events").groupby("user_id").size(), {}
    for user, n in sizes.items():
        for i in range(1, max(1, n - 3) + 1):
            steps = min(n, i + 3) - i
            want[str(user), i] = (",".join(f"E{k}" for k in range(i, i + steps + 1)), round(0.75**steps, 6))
    assert got == want
    assert sum(len({e for (g, _), (path, _) in got.items() if g == str(user) for e in path.split(",")}) for user in sizes.index) == sizes.sum()


def test_every_edge_and_cause_against_listed_pairs(spark):
    nodes = edges = None
    made = list(random_graphs(random.Random(7), 25))
    for i, (names, links) in enumerate(made):
        n, e = graph(spark, links, names, f"g{i}")
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    nodes, edges = kept(nodes, "nodes"), kept(edges, "edges")
    causes = nodes.select("graph_id", nodes.event_id.alias("cause"))
    dead = {(r.graph_id, r.cause, r.event_id) for r in intervene.dead(nodes, causes, intervene.alive(nodes, edges, causes)).collect()}
    fallen = [(r.graph_id, r.cause, r.event_id) for r in dominators.fallen(nodes, edges).collect()]
    assert len(fallen) == len(set(fallen)) and set(fallen) == dead
    got = {(r.graph_id, r.cause, r.effect): (round(r.pn, 6), round(r.ps, 6), r.effect_dead) for r in intervene.edge_measures(nodes, edges, 3).collect()}
    want = {}
    for i, (names, links) in enumerate(made):
        for _, a, b, _ in links:
            live = alive(names, links, a)
            within = [x for x in links if x[1] in live and x[2] in live]
            roots = [x for x in live if not any(t == x for _, _, t, _ in links)]
            detour = max((best(within, x, b, 3) or 0 for x in roots if x != b), default=0)
            want[f"g{i}", a, b] = (0 if a == b else 1 if b not in live else round(1 - detour, 6), round(best(links, a, b, 3), 6), b not in live)
    assert want and got == want


def test_geo_queries_cover_all_nodes_and_edges(spark):
    q = entry.queries()
    orders, customers = read("orders"), read("customer")
    bought = read("lineitem").merge(orders, left_on="l_orderkey", right_on="o_orderkey")[["l_suppkey", "o_custkey"]].drop_duplicates()
    whole = q["necessity_sufficiency"](spark, FOLDER).toPandas().set_index(["graph_id", "cause", "effect"])
    assert len(whole) == 25 + len(customers) + len(bought) and whole.index.is_unique
    served = bought.merge(customers, left_on="o_custkey", right_on="c_custkey")[["l_suppkey", "c_nationkey"]].drop_duplicates()
    assert len(q["cascade_geo"](spark, FOLDER).toPandas()) == 50 + len(customers) + len(served)


def test_report_of_every_user_turn(spark):
    got = entry.queries()["answer_report"](spark, FOLDER).first()
    turns = {(t.conv_id, t.turn): t for t in read("conversations").itertuples()}
    gold = [t for t in turns.values() if t.role == "user"]
    pairs = [(t.text, n.text) for t in gold if (n := turns.get((t.conv_id, t.turn + 1))) and n.role == "assistant"]
    same = sum(a.strip() == b.strip() for a, b in pairs)
    f1 = [2 * len(x & y) / (len(x) + len(y)) for a, b in pairs for x, y in [(set(a.split()), set(b.split()))]]
    assert (got.total, got.exact_match) == (len(gold), same) and len(gold) > len({t.conv_id for t in gold})
    assert got.em == pytest.approx(same / len(gold), abs=1e-6) and got.avg_f1 == pytest.approx(sum(f1) / len(gold), abs=1e-6)


@pytest.mark.parametrize(("name", "hops", "k"), [("best_paths_5", 5, 1), ("topk_paths_5", 5, 2), ("geom_paths_7", 7, 6)])
def test_longer_paths(spark, name, hops, k):
    """Steps go one or two places on: a path of b double steps over d places has d - b edges."""
    best = {}
    for d in range(1, 2 * hops + 1):
        ways = [0.75 ** (d - 2 * b) * 0.55**b for b in range(d // 2 + 1) for _ in range(math.comb(d - b, b)) if d - b <= hops]
        if name == "geom_paths_7":
            ways = [(0.75 ** (d - 2 * b) * 0.55**b) ** (1 / (d - b)) for b in range(d // 2 + 1) for _ in range(math.comb(d - b, b)) if d - b <= hops]
        best[d] = sorted(ways, reverse=True)[:k]
    want = {(str(user), f"E{i}", f"E{i + d}"): best[d] for user, n in read("events").groupby("user_id").size().items() for i in range(1, n + 1) for d in best if i + d <= n}
    got = {}
    for r in entry.queries()[name](spark, FOLDER).collect():
        got.setdefault((r.graph_id, r.src, r.dst), []).append(r.score if name == "geom_paths_7" else r.p)
    assert got.keys() == want.keys()
    assert all(sorted(got[x], reverse=True) == pytest.approx(want[x], abs=2e-6) for x in want)
