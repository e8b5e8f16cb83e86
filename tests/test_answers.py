import json

from helpers import UNIT, graph
from pyspark.sql import functions as F

from eventloom.operators import anchor, answer, metrics
from eventloom.plans import tiers

NAMES = {"A": "暴雨红色预警", "B": "道路内涝", "C": "学校停课", "D": "出行受阻", "E": "股价下跌", "F": "公司裁员", "G": "员工维权"}


def ask(spark, *rows):
    return spark.createDataFrame([("g", f"q{i}", q, k) for i, (q, k) in enumerate(rows)], "graph_id string, query_id string, question string, question_type string")


def test_kinds_of_answers(spark):
    nodes, edges = graph(spark, UNIT, mentions=NAMES)
    asked = ask(
        spark, ("是什么导致了出行受阻？", "causal_tracing"), ("暴雨红色预警会导致什么？", "causal_tracing"), ("暴雨红色预警可能引发什么？", "situation_deduction"),
        ("假如道路内涝没有发生，出行受阻还会发生吗？", "counterfactual"), ("假如股价下跌没有发生？", "counterfactual"), ("火星", "causal_tracing"), ("员工维权之后？", "situation_deduction"), ("x", "other"), ("假如员工维权没有", "counterfactual"),
        ("暴雨红色预警的原因", "causal_tracing"),
    )
    got = {r.query_id: r for r in answer.answers(nodes, edges, asked).collect()}
    assert len(got) == 10
    assert got["q0"].evidence_chain == ["R3"] and got["q0"].confidence == 0.85 and got["q0"].chain_count == 3
    assert got["q0"].answer_text.split("\n")[1] == "直接原因：道路内涝（强度0.85）、学校停课（强度0.70）"
    assert got["q1"].direction == "forward" and got["q1"].evidence_chain == ["R1"] and "最终后果：出行受阻（强度0.77）" in got["q1"].answer_text
    assert got["q2"].evidence_chain == ["R1", "R3"] and got["q2"].confidence == 0.765
    assert (got["q3"].pn, got["q3"].ps, got["q3"].pns, got["q3"].confidence, got["q3"].evidence_chain) == (0.44, 0.85, 0.374, 0.85, ["R3"])
    assert "替代路径为：暴雨红色预警 -> 学校停课 -> 出行受阻。" in got["q3"].answer_text
    assert got["q4"].cascaded_ids == ["F", "G"] and got["q4"].confidence == 0.9 and got["q4"].evidence_chain == ["R5"]
    assert got["q5"].confidence == 0 and got["q5"].answer_text == "未在图中定位到与问题相关的事件。"
    assert got["q6"].answer_text == "「员工维权」在图中没有下游事件，暂无法推演后续态势。" and got["q7"].answer_text == "暂不支持的问题类型：other"
    assert got["q8"].confidence == 0 and got["q9"].answer_text == "「暴雨红色预警」在图中没有上游原因（可能是根事件）。"


def test_substring_beats_bigrams(spark):
    nodes, _ = graph(spark, [("R", "X1", "X2", 0.5)], mentions={"X1": "发布暴雨预警", "X2": "启动内涝预警响应"})
    asked = ask(spark, ("发布暴雨预警之后会怎样", "causal_tracing"), ("内涝预警响", "causal_tracing"))
    got = sorted((r.query_id, r.event_id) for r in anchor.mentioned(nodes, asked).collect())
    assert got == [("q0", "X1"), ("q1", "X2")]


def test_evidence(spark):
    nodes, edges = graph(spark, [("R", "A", "B", 0.5)])
    chains = spark.createDataFrame([("g", "q", ["B", "R", "zz"]), ("g", "p", [])], "graph_id string, query_id string, ids array<string>")
    assert {r.query_id: r.evidence for r in anchor.evidence(chains, nodes, edges).collect()} == {"q": ["B", "A-B"], "p": []}


def test_metrics(spark):
    pred = spark.createDataFrame([("1", " a b "), ("2", "c"), ("9", "x")], "query_id string, answer_text string")
    gold = spark.createDataFrame([("1", "a b"), ("2", "c d"), ("3", "e")], "query_id string, answer_text string")
    r = metrics.answer_report(pred, gold).first()
    assert (r.total, r.exact_match) == (3, 1) and abs(r.avg_f1 - (1 + 2 / 3) / 3) < 1e-9
    m = metrics.micro(spark.createDataFrame([("d", 1), ("d", 1), ("d", 2)], "d string, k int"), spark.createDataFrame([("d", 1), ("d", 3)], "d string, k int"), ["d", "k"]).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.f1) == (1, 1, 2, 0.5, 0.3333, 0.4)
    assert metrics.answer_report(pred.limit(0), gold.limit(0)).first().em == 0


def test_extraction_report(spark):
    events = "array<struct<event_type:string,trigger:string,trigger_start_index:int,arguments:array<struct<role:string,argument:string,argument_start_index:int>>>>"
    gold = metrics.gold_records(spark.createDataFrame([("d", [("灾害/意外-起火", "起火", 2, [("死亡人数", "3人", 5)]), ("x", "", 0, [])])], f"id string, event_list {events}"))
    docs = spark.createDataFrame([("d", "厂房起火死3人")], "doc_id string, text string")
    found = spark.createDataFrame([("d", "灾害/事故", "起火", "厂房起火死3人", [0, 7], [("object", "3人"), ("time", "今")])], "doc_id string, event_type string, trigger string, mention string, char_offset array<int>, arguments array<struct<role:string,value:string>>")
    got = {r.metric: (r.tp, r.fp, r.fn) for r in metrics.extraction_report(gold, metrics.pred_records(found, docs)).collect()}
    assert got == {"TI": (1, 0, 0), "TC": (1, 0, 0), "AI": (1, 1, 0), "AC": (1, 1, 0), "TC:灾害/事故": (1, 0, 0)}
    assert F is not None


def test_published_bundle(spark, tmp_path):
    """The first published graph with its three questions: chains, confidences, PN and PS as published."""
    links = [("R001", "E001", "E002", 0.9, "causal"), ("R002", "E001", "E003", 0.9, "causal"), ("R003", "E001", "E005", 0.88, "causal"), ("R004", "E002", "E004", 0.8, "causal"), ("R005", "E003", "E004", 0.82, "enables"), ("R006", "E003", "E006", 0.86, "causal"), ("R007", "E004", "E006", 0.84, "causal")]
    confidence = dict(zip(("E001", "E002", "E003", "E004", "E005", "E006"), (0.95, 0.92, 0.9, 0.88, 0.9, 0.85), strict=True))
    names = dict(zip(confidence, ("甲地山洪", "乙桥冲断", "丙镇停电", "丁厂停工", "戊村转移", "己市缺货"), strict=True))
    asked = [("q1", "是什么导致了己市缺货？", "causal_tracing"), ("q2", "甲地山洪之后会怎样？", "situation_deduction"), ("q3", "假如丁厂停工没有发生，己市缺货还会发生吗？", "counterfactual")]
    bundle = {
        "news_id": "n1", "events": [{"event_id": e, "doc_id": "d", "event_type": "社会/舆情", "trigger": names[e], "mention": names[e], "arguments": [], "time": "", "location": "", "char_offset": None, "confidence": c} for e, c in confidence.items()],
        "relations": [{"relation_id": r, "cause_event_id": a, "effect_event_id": b, "relation_type": t, "evidence": [], "confidence": c, "time_lag": ""} for r, a, b, c, t in links],
        "queries": [{"query_id": i, "question": q, "question_type": t, "seed_event_ids": []} for i, q, t in asked],
    }
    for name in ("n1", "n2"):
        (tmp_path / f"{name}.json").write_text(json.dumps(bundle | {"news_id": name}, ensure_ascii=False, indent=1))
    rows = tiers.news_answers(spark, f"{tmp_path}/*.json").collect()
    assert len(rows) == 6
    for r in rows:
        want = {"q1": (["R006"], 0.86), "q2": (["R003"], 0.88), "q3": (["R007"], 0.84)}[r.query_id]
        assert (r.evidence_chain, r.confidence) == want and r.graph_id in ("n1", "n2")
        if r.query_id == "q3":
            assert (round(r.pn, 2), round(r.ps, 2)) == (0.23, 0.84)


def test_paths_are_made_for_what_is_asked_only(spark, monkeypatch):
    """Tracing makes no table of all pairs of a graph: with 30 causes of one event and 30 events that it doesn't lead to, 30 paths; and necessity looks at what leads there."""
    from eventloom.operators import answer, intervene, paths

    sides = [(f"r{i}", f"cause{i}", "flood", 0.5) for i in range(30)] + [(f"s{i}", f"cause{i}", f"other{i}", 0.5) for i in range(30)]
    nodes, edges = graph(spark, sides)
    made, seen = [], []
    best, measures = paths.best_paths, intervene.measures
    monkeypatch.setattr(paths, "best_paths", lambda *a: made.append(best(*a)) or made[-1])
    monkeypatch.setattr(intervene, "measures", lambda n, e, *a: seen.append(e) or measures(n, e, *a))
    asked = spark.createDataFrame([("g", "q", "为什么会发生flood", "causal_tracing")], "graph_id string, query_id string, question string, question_type string")
    got = answer.tracing(nodes, edges, asked, 3).collect()
    assert [r["chain_count"] for r in got] == [30] and got[0]["confidence"] == 0.5
    assert sum(m.count() for m in made) == 30 and [e.count() for e in seen] == [30]
