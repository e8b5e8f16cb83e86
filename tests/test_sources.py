import json

import pytest
from helpers import UNIT, graph

from eventloom.operators import extract
from eventloom.plans import tiers
from eventloom.sources import io
from eventloom.sources import schemas as sc
from eventloom.sources.config import Config, load_config, resolve_path


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("a:\n  b: 3\nd: x\n")
    c = load_config(str(tmp_path / "c.yaml"))
    assert (c.get("a.b"), c.get("a.z", 7), c.get("d.e", "n"), c.section("a").raw, "a" in c, c["d"], c.whole("d", 5)) == (3, 7, "n", {"b": 3}, True, "x", 5)
    assert (resolve_path("/x", "y/../z"), resolve_path("/x", "/q"), resolve_path("/x", None)) == ("/x/z", "/q", None)
    (tmp_path / "e.yaml").write_text("")
    assert load_config(str(tmp_path / "e.yaml")).raw == {}


def test_round_trips(spark, tmp_path):
    nodes, edges = graph(spark, UNIT)
    io.save_graphs(nodes, edges, str(tmp_path / "g"))
    n, e = io.load_graphs(spark, str(tmp_path / "g"))
    assert sorted(n.select(*nodes.columns).collect()) == sorted(nodes.collect()) and sorted(map(str, e.select(*edges.columns).collect())) == sorted(map(str, edges.collect()))
    (tmp_path / "e.jsonl").write_text('{"event_id": "E1", "char_offset": [1, 2], "arguments": [{"role": "r", "value": "v"}]}\n\n{"event_id": "E2"}\n')
    got = io.load_events(spark, str(tmp_path / "e.jsonl")).orderBy("node_ord").collect()
    assert [r.event_id for r in got] == ["E1", "E2"] and got[0].arguments[0].value == "v" and got[0].char_offset == [1, 2]
    (tmp_path / "d.json").write_text(json.dumps([{"doc_id": "a", "text": "x", "metadata": {"k": "v"}}]))
    assert io.load_documents(spark, str(tmp_path / "d.json")).first().metadata == {"k": "v"}
    assert io.load_queries(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "x.jsonl").write_text('{"event_id": "E1", "odd": 1}\n')
    assert io.check_keys(spark, str(tmp_path / "x.jsonl"), sc.EVENT_DDL) == ["odd"]
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="MALFORMED"):
        io.load_events(spark, str(tmp_path / "bad.jsonl")).count()


def test_file_order_and_arrays(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, ids in (("b.jsonl", range(100, 103)), ("a.jsonl", range(2000)), ("c.jsonl", [7])):  # a large file is read last otherwise
        (folder / name).write_text("".join(json.dumps({"doc_id": f"{name}{i}", "text": "x" * 50}) + "\n" for i in ids))
    rows = io.load_documents(spark, str(folder / "*.jsonl")).orderBy("doc_ord").collect()
    assert [r.doc_id for r in rows] == [f"a.jsonl{i}" for i in range(2000)] + [f"b.jsonl{i}" for i in range(100, 103)] + ["c.jsonl7"] and [r.doc_ord for r in rows] == list(range(1, 2005))
    io.save_array(spark.createDataFrame([(2, "b"), (1, None)], "n int, t string"), f"{tmp_path}/rows.json", ["n"])
    assert json.loads((tmp_path / "rows.json").read_text()) == [{"n": 1, "t": None}, {"n": 2, "t": "b"}]
    io.save_array(spark.createDataFrame([], "n int"), f"{tmp_path}/rows.json", ["n"])
    assert json.loads((tmp_path / "rows.json").read_text()) == []


def test_saved_graphs_one_a_line(spark, tmp_path):
    n, e = graph(spark, UNIT)
    m, f = graph(spark, UNIT[:2], graph_id="h")
    io.save_graphs(n.unionByName(m), e.unionByName(f), str(tmp_path / "g"))
    nodes, edges = io.load_graphs(spark, str(tmp_path / "g"))
    assert {r.graph_id: r["count"] for r in nodes.groupBy("graph_id").count().collect()} == {"g": 7, "h": 3} and edges.count() == 8


def test_labelled_rows_to_samples(spark, tmp_path):
    row = {"id": "1", "text": "厂房起火死3人", "event_list": [{"event_type": "灾害/意外-起火", "trigger": "起火", "trigger_start_index": 2, "arguments": [{"role": "死亡人数", "argument": "3人", "argument_start_index": 5}]}]}
    for text in (json.dumps([row]), json.dumps(row)):
        (tmp_path / "d.json").write_text(text)
        rows = io.convert_labelled(io.load_labelled(spark, str(tmp_path / "d.json")))
        samples = extract.training_samples(rows).collect()
        assert len(samples) == 8 and sum(s.label for s in samples) == 2 and {(s.role, s.start, s.end) for s in samples if s.label} == {("trigger", 2, 4), ("object", 5, 7)}


def test_tiers(spark, tmp_path):
    (tmp_path / "docs.json").write_text(json.dumps([{"doc_id": "a", "title": "", "text": "2024年7月3日开封市发生内涝。受此影响，内涝导致公交瘫痪。学校宣布停课。", "publish_time": "2024-07-03"}]))
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "q1", "question": "为什么内涝？", "question_type": "causal_tracing"}, {"query_id": "q2", "question": "假如发生内涝没有", "question_type": "counterfactual"}]))
    config = Config({"mode": "challenge", "output_dir": "out", "input": {"documents": "docs.json", "queries": "q.json"}})
    got = {r.query_id: r for r in tiers.run(spark, config, str(tmp_path)).collect()}
    assert got["q1"].confidence > 0 and got["q1"].evidence_chain == ["R001"]
    io.save_graphs(*[spark.read.parquet(str(tmp_path / "out" / t)) for t in ("nodes", "edges")], str(tmp_path / "graph.json"))
    basic = Config({"mode": "basic", "output_dir": "out2", "input": {"graph": "graph.json", "queries": "q.json"}})
    again = {r.query_id: r for r in tiers.run(spark, basic, str(tmp_path)).collect()}
    assert {q: r.answer_text for q, r in again.items()} == {q: r.answer_text for q, r in got.items()}
    with pytest.raises(ValueError):
        tiers.run(spark, Config({"mode": "x"}), str(tmp_path))
