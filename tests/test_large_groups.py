"""Large graphs, numbered by ranges and looked ahead in by blocks, against small ones; and the tier that is given events."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.operators import graph, numbering, relate
from eventloom.plans import tiers
from eventloom.sources import io, storage
from eventloom.sources import schemas as sc
from eventloom.sources.config import Config

EVENTS = ["起火", "停工", "救援", "例行演练", "调查"]


def events(rng, sizes):
    rows = []
    for g, n in sizes.items():
        for i in rng.sample(range(n), n):
            kind = lx.STAGES[i] if g == "staged" and i < 10 else rng.choice(EVENTS)
            rows.append((g, len(rows), f"E{i // 2 if g == 'ties' else i}", "", kind, kind, rng.choice(["无。", f"由于{rng.choice(EVENTS)}导致停工；"]), [], "", "", None, 0.9))
    return rows


def everything(df):
    return sorted(map(str, df.collect()))


def test_relations_of_large_graphs_equal_those_by_window(spark, monkeypatch):
    nodes = spark.createDataFrame(events(random.Random(2), {"a": 23, "b": 4, "ties": 17, "staged": 25, "one": 1}), sc.NODE_DDL)
    plain = everything(relate.relations(nodes)), everything(relate.narrative(nodes).select("graph_id", "event_id", "node_ord", "pos"))
    bare = relate.relations(nodes).withColumn("relation_id", F.lit(""))
    built = everything(graph.clean_edges(bare, nodes))
    monkeypatch.setattr(numbering, "MOST", 5)
    large = numbering.large(nodes, "graph_id")
    assert {r[0] for r in large.collect()} == {"a", "ties", "staged"} and numbering.large(nodes.where("graph_id = 'b'"), "graph_id") is None
    assert (everything(relate.relations(nodes)), everything(relate.narrative(nodes, large).select("graph_id", "event_id", "node_ord", "pos"))) == plain
    assert everything(graph.clean_edges(bare, nodes)) == built and len(plain[0]) > 50
    assert not relate.relations(nodes.limit(0)).count()


def test_look_ahead_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "MOST", 4)
    df = spark.createDataFrame([(g, i) for g, n in (("x", 14), ("y", 3)) for i in range(1, n + 1)], "g string, at int")
    got = {(r["g"], r["at"]): [(x["distance"], x["b"]) for x in r["ahead"]] for r in numbering.ahead(df, "g", "at", F.col("at"), 3).collect()}
    assert got == {(g, i): [(d, i + d if i + d <= n else None) for d in (1, 2, 3)] for g, n in (("x", 14), ("y", 3)) for i in range(1, n + 1)}


def test_events_given_by_command_line(spark, tmp_path, monkeypatch):
    rows = [{"event_id": f"E{i:02d}", "event_type": "", "trigger": f"event{i:02d}", "mention": f"event{i:02d}", "confidence": 0.9} for i in range(1, 13)]
    (tmp_path / "events.jsonl").write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
    (tmp_path / "queries.json").write_text(json.dumps([{"query_id": "Q1", "question": "为什么出现event12", "question_type": "causal_tracing", "seed_event_ids": []}, {"query_id": "Q2", "question": "假如没有event01", "question_type": "counterfactual", "seed_event_ids": []}]))
    (tmp_path / "c.yaml").write_text("mode: basic\ninput:\n  events: events.jsonl\n  queries: queries.json\noutput_dir: out\n")
    tiers.main([str(tmp_path / "c.yaml"), "--mode", "reasoning"])
    said = json.loads((tmp_path / "out" / "answers.json").read_text())
    loaded = io.load_events(spark, str(tmp_path / "events.jsonl"))
    want = tiers.answers(*graph.build(loaded, relate.relations(loaded)), io.load_queries(spark, str(tmp_path / "queries.json")))
    assert {a["query_id"]: (a["answer_text"], a["evidence_chain"]) for a in said} == {r["query_id"]: (r["answer_text"], list(r["evidence_chain"])) for r in want.collect()}
    assert len(said) == 2 and all(a["answer_text"] for a in said)
    monkeypatch.setattr(numbering, "MOST", 4)
    again = tiers.run(spark, Config({"mode": "reasoning", "input": {"events": "events.jsonl", "queries": "queries.json"}, "output_dir": "again"}), str(tmp_path))
    assert {r["query_id"]: (r["answer_text"], list(r["evidence_chain"])) for r in again.collect()} == {a["query_id"]: (a["answer_text"], a["evidence_chain"]) for a in said}


def test_small_and_large_graphs_meet_in_other_numbers_of_partitions(spark, monkeypatch):
    """After a large table was read, shuffles start with more partitions, and each side of a union has as many as its rows need."""
    nodes = spark.createDataFrame(events(random.Random(2), {"a": 23, "b": 4, "ties": 17, "staged": 25, "one": 1}), sc.NODE_DDL)
    plain = everything(relate.relations(nodes))
    monkeypatch.setattr(numbering, "MOST", 5)
    settings = {"adaptive.coalescePartitions.initialPartitionNum": "30", "adaptive.advisoryPartitionSizeInBytes": str(4 << 20)}
    before = {f"spark.sql.{name}": spark.conf.get(f"spark.sql.{name}", None) for name in (*settings, "autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold", "unionOutputPartitioning")}
    try:
        for name, value in settings.items():
            spark.conf.set(f"spark.sql.{name}", value)
        storage.joined_by_measure(spark)
        assert everything(relate.relations(nodes)) == plain
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
