"""The other nine published graphs, with texts of our own: chains, confidences, PN and PS as published."""

from __future__ import annotations

import json

from eventloom.plans import tiers

NAMES = ("甲地山洪", "乙桥冲断", "丙镇停电", "丁厂停工", "戊村转移", "己市缺货", "庚路封闭")
LINE = [(1, 2, 0.9), (2, 3, 0.88), (3, 4, 0.85), (4, 5, 0.82)]
#: Fixed values of the published graphs: edges (cause, effect, confidence) in the order of their ids R001, R002, …
EDGES = {
    2: [(1, 2, 0.9), (2, 3, 0.85), (3, 5, 0.9), (1, 4, 0.88)],
    3: [(1, 2, 0.85), (1, 3, 0.9), (2, 5, 0.78), (3, 4, 0.9), (4, 5, 0.8)],
    4: [(1, 2, 0.9), (2, 3, 0.88), (3, 4, 0.85), (3, 6, 0.8), (4, 5, 0.82), (5, 7, 0.8)],
    5: [(1, 2, 0.9), (1, 3, 0.85), (2, 3, 0.8), (3, 4, 0.85), (3, 5, 0.82)],
    6: [(1, 2, 0.9), (2, 3, 0.85), (3, 4, 0.82), (3, 5, 0.78)],
    7: LINE, 8: LINE, 9: LINE, 10: [(1, 2, 0.88), (2, 3, 0.85), (3, 4, 0.8)],
}
#: Fixed values of the published answers: what is traced, its chain, confidence and number of chains; the outlook's chain and confidence;
#: what is assumed away, its effect, chain, confidence, PN, PS.
ANSWERS = {
    2: ((3, [2], 0.85, 2), ([4], 0.88), (2, 5, [2, 3], 0.99, 1.0, 0.77)),
    3: ((5, [5], 0.8, 4), ([1, 3], 0.663), (3, 5, [4, 5], 0.72, 0.34, 0.72)),
    4: ((5, [5], 0.82, 4), ([1, 2, 3], 0.6732), (4, 7, [5, 6], 0.99, 1.0, 0.66)),
    5: ((4, [4], 0.85, 3), ([2, 4], 0.7225), (3, 5, [5], 0.99, 1.0, 0.82)),
    6: ((4, [3], 0.82, 3), ([1, 2, 3], 0.6273), (3, 5, [4], 0.99, 1.0, 0.78)),
    7: ((4, [3], 0.85, 3), ([1, 2, 3], 0.6732), (2, 5, [2, 3, 4], 0.99, 1.0, 0.61)),
    8: ((4, [3], 0.85, 3), ([1, 2, 3], 0.6732), (2, 5, [2, 3, 4], 0.99, 1.0, 0.61)),
    9: ((5, [4], 0.82, 4), ([1, 2, 3], 0.6732), (3, 5, [3, 4], 0.99, 1.0, 0.7)),
    10: ((3, [2], 0.85, 2), ([1, 2, 3], 0.5984), (2, 4, [2, 3], 0.99, 1.0, 0.68)),
}


def test_published_graphs(spark, tmp_path):
    rid = lambda i: f"R{i:03d}"
    for g, edges in EDGES.items():
        (traced, *_), _, (cause, effect, *_) = ANSWERS[g]
        n = max(max(a, b) for a, b, _ in edges)
        asked = [("q1", f"是什么导致了{NAMES[traced - 1]}？", "causal_tracing"), ("q2", f"{NAMES[0]}之后会怎样？", "situation_deduction"), ("q3", f"假如{NAMES[cause - 1]}没有发生，{NAMES[effect - 1]}还会发生吗？", "counterfactual")]
        bundle = {
            "news_id": f"n{g}", "events": [{"event_id": f"E{i:03d}", "doc_id": "d", "event_type": "", "trigger": NAMES[i - 1], "mention": NAMES[i - 1], "arguments": [], "time": "", "location": "", "char_offset": None, "confidence": 0.9} for i in range(1, n + 1)],
            "relations": [{"relation_id": rid(i), "cause_event_id": f"E{a:03d}", "effect_event_id": f"E{b:03d}", "relation_type": "causal", "evidence": [], "confidence": c, "time_lag": ""} for i, (a, b, c) in enumerate(edges, 1)],
            "queries": [{"query_id": i, "question": q, "question_type": t, "seed_event_ids": []} for i, q, t in asked],
        }
        (tmp_path / f"n{g}.json").write_text(json.dumps(bundle, ensure_ascii=False))
    rows = {(r["graph_id"], r["query_id"]): r for r in tiers.news_answers(spark, f"{tmp_path}/*.json").collect()}
    assert len(rows) == 27
    for g, (q1, q2, q3) in ANSWERS.items():
        back, outlook, what_if = (rows[f"n{g}", q] for q in ("q1", "q2", "q3"))
        assert (back["evidence_chain"], back["confidence"], back["chain_count"], back["target_event_id"]) == ([rid(i) for i in q1[1]], q1[2], q1[3], f"E{q1[0]:03d}"), g
        assert (outlook["evidence_chain"], outlook["confidence"]) == ([rid(i) for i in q2[0]], q2[1]), g
        assert (what_if["evidence_chain"], what_if["confidence"], round(what_if["pn"], 2), round(what_if["ps"], 2)) == ([rid(i) for i in q3[2]], q3[3], q3[4], q3[5]), g
