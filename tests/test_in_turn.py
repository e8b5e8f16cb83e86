"""Questions in their turn: each graph is given its own few of them, and no others are made."""

from __future__ import annotations

from eventloom.plans import graphs, reasoned


def test_questions_in_turn(spark):
    rows = [("k0", "a{n}"), ("k1", "b"), ("k2", "c {n} {n}"), ("k3", "d")]
    sizes = spark.createDataFrame([("5", 2), ("6", 12)], "graph_id string, n long")
    asked = graphs.in_turn(sizes, rows, ["kind"], 2)
    assert sorted(map(tuple, asked.collect())) == [("5", 1, "k1", "b"), ("5", 3, "k3", "d"), ("6", 0, "k0", "aD012"), ("6", 2, "k2", "c D012 D012")]
    plan = graphs.in_turn(sizes, [(a, b, c) for _, a, b, c in reasoned.ASKED], ["question_type", "reasoning_type"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == 1
