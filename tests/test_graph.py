from pyspark.sql import functions as F

from eventloom.operators import graph as gr
from eventloom.operators import relate
from eventloom.sources import schemas as sc


def node(spark, *rows):
    made = [("g", i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, sc.NODE_DDL)


def event(id_, kind="", trigger="", mention="", args=0, time="", place="", conf=None):
    return (id_, "d", kind, trigger, mention, [("r", "v")] * args, time, place, None, conf)


def relation(spark, *rows):
    return spark.createDataFrame([("g", i, r, a, b, "causal", [], c, "") for i, (r, a, b, c) in enumerate(rows)], sc.EDGE_DDL)


def test_merge_folds_in_order(spark):
    nodes = node(spark, event("E1", "k", "", "short", 1, "", "X", 0.4), event("E2", mention="m"), event("E1", "", "t", "longer mention", 1, "2020", "", 0.9), event("E1", "z", "u", "x", 0, "2021", "Y", 0.2))
    got = {r.event_id: r for r in gr.merge_nodes(nodes).collect()}
    one = got["E1"]
    assert (one.mention, one.trigger, one.event_type, one.time, one.location, one.confidence, one.node_ord) == ("longer mention", "t", "k", "2020", "X", 0.9, 0)
    assert got["E2"].node_ord == 1


def test_edges_are_cleaned(spark):
    nodes = node(spark, event("A"), event("B"), event("C"))
    edges = relation(spark, ("", "A", "B", 0.5), ("R9", "A", "A", 0.9), ("R3", "A", "B", 0.7), ("R4", "B", "A", 0.6), ("R5", "A", "Z", 0.9), ("R6", "B", "C", 0.5), ("R7", "C", "B", 0.5), ("", "A", "C", None))
    got = [(r.relation_id, r.cause_event_id, r.effect_event_id, r.edge_ord) for r in gr.clean_edges(edges, nodes).orderBy("edge_ord").collect()]
    assert got == [("R3", "A", "B", 0), ("R6", "B", "C", 5), ("R7", "C", "B", 6), ("R004", "A", "C", 7)]


def test_cleaning_again_changes_nothing(spark):
    nodes = node(spark, event("A"), event("B"))
    once = gr.clean_edges(relation(spark, ("R1", "A", "B", 0.5), ("R2", "A", "B", 0.5)), nodes)
    assert sorted(once.collect()) == sorted(gr.clean_edges(once, nodes).collect())


def test_relations_by_order_count_distractors(spark):
    rows = [event("E1", "a", mention="x"), event("E2", "b", mention="邻近地区例行演练"), event("E3", "爆炸", "起火", mention="x"), event("E10", "c", mention="无。由于起火导致停工；完")]
    got = [(r.relation_id, r.cause_event_id, r.effect_event_id, r.confidence, r.relation_type, r.evidence) for r in relate.relations(node(spark, *rows)).orderBy("edge_ord").collect()]
    assert got == [("R001", "E1", "E3", 0.55, "间接传导", ["E1（a） → E3（爆炸）"]), ("R002", "E3", "E10", 0.87, "直接因果", ["由于起火导致停工"])]


def test_ten_stages_take_the_template(spark):
    stages = ["事故发生", "现场救援", "官方部署", "原因调查", "责任追究", "善后处置", "隐患分析", "专项整治", "行业转型", "调查报告", "后续"]
    edges = relate.relations(node(spark, *[event(f"D{i:03d}", s) for i, s in enumerate(stages, 1)])).orderBy("edge_ord").collect()
    assert len(edges) == 13 and edges[0].relation_id == "R001" and edges[-1].effect_event_id == "D011" and edges[-1].evidence == ["D010 → D011"]
    assert [(r.cause_event_id, r.effect_event_id) for r in edges[:3]] == [("D001", "D002"), ("D001", "D003"), ("D002", "D003")]


def test_degrees_and_roots(spark):
    nodes = node(spark, event("A"), event("B"), event("C"))
    edges = relation(spark, ("R1", "A", "B", 0.5))
    assert {r.event_id for r in gr.roots(nodes, edges).collect()} == {"A", "C"}
    assert {(r.event_id, r.in_degree, r.out_degree) for r in gr.degrees(nodes, edges).collect()} == {("A", 0, 1), ("B", 1, 0), ("C", 0, 0)}
    assert gr.metadata(nodes, edges).select(F.struct("node_count", "edge_count")).first()[0] == (3, 1)
