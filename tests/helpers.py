"""Small graphs for tests, and their brute-force answers."""

from __future__ import annotations

import itertools

from eventloom.sources import schemas as sc

UNIT = [("R1", "A", "B", 0.9), ("R2", "A", "C", 0.8), ("R3", "B", "D", 0.85), ("R4", "C", "D", 0.7), ("R5", "E", "F", 0.9), ("R6", "F", "G", 0.8)]


def graph(spark, edges, nodes=None, graph_id="g", mentions=None):
    names = nodes or sorted({x for _, a, b, _ in edges for x in (a, b)})
    rows = [(graph_id, i, n, "", "", "", (mentions or {}).get(n, n), [], "", "", None, 0.9) for i, n in enumerate(names)]
    links = [(graph_id, i, r, a, b, "causal", [f"{a}-{b}"], c, "") for i, (r, a, b, c) in enumerate(edges)]
    return spark.createDataFrame(rows, sc.NODE_DDL), spark.createDataFrame(links, sc.EDGE_DDL)


def simple_paths(edges, s, t, hops):
    """Depth-first simple paths of up to ``hops`` edges, by edge order."""
    out = []

    def walk(path, p):
        if len(path) - 1 >= hops:
            return
        for r, a, b, c in edges:
            if a == path[-1] and b not in path:
                if b == t:
                    out.append(([*path, b], p * c))
                walk([*path, b], p * c) if b != t else None

    walk([s], 1.0)
    return out


def best(edges, s, t, hops):
    return max((p for _, p in simple_paths(edges, s, t, hops)), default=None)


def alive(nodes, edges, cause):
    roots = [n for n in nodes if n != cause and not any(b == n for _, _, b, _ in edges)]
    seen = set(roots)
    while True:
        more = {b for _, a, b, _ in edges if a in seen and b != cause} - seen
        if not more:
            return seen
        seen |= more


def random_graphs(random, n):
    for _ in range(n):
        names = [f"n{i}" for i in range(random.randrange(2, 7))]
        pairs = [p for p in itertools.permutations(names, 2) if random.random() < 0.35]
        random.shuffle(pairs)
        yield names, [(f"R{i}", a, b, random.choice([0.0, 0.25, 0.5, 0.75, 1.0])) for i, (a, b) in enumerate(pairs)]
