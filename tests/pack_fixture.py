"""Small packs of tasks A, B and C, written to a folder."""

from __future__ import annotations

import json
import os

STAGES = ["事故发生", "现场救援", "官方部署", "原因调查", "责任追究", "善后处置", "隐患分析", "专项整治", "行业转型", "调查报告"]


def _write(path: str, value) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def _question(n: int, rtype: str, text: str, qtype: str = "retrospective") -> dict:
    return {"sample_id": f"s{n}", "pack_id": "p", "question_type": qtype, "reasoning_type": rtype, "question": text}


def pack_a(folder: str) -> None:
    os.makedirs(folder)
    texts = {1: "化工厂爆炸\n2020年3月4日，甲市化工厂发生爆炸，造成12人遇难。", 2: "救援展开\n爆炸导致事故发生后消防队展开救援工作。", 3: "部署\n指挥部召开紧急会议部署工作。", 4: "演练\n邻近辖区例行演练。"}
    for n, t in texts.items():
        _write(f"{folder}/D{n:03d}.txt", t)
    _write(
        f"{folder}/事件列表.json",
        [
            {"event_id": "D001", "doc_id": "D001", "event_type": "事故发生", "trigger_word": "爆炸", "occur_time": "2020-03-04", "start": 0, "end": 5, "argument": {"主体": "化工厂", "地点": "甲市", "影响": "12 人遇难", "空": ""}},
            {"event_id": "D002", "doc_id": "D002", "event_type": "现场救援", "trigger_word": "救援", "occur_time": "", "argument": {"内容": "消防队展开救援工作"}},
            {"event_id": "D003", "doc_id": "D003", "event_type": "官方部署", "trigger_word": "部署", "argument": None},
            {"event_id": "D004", "doc_id": "D004", "event_type": "常规演练", "trigger_word": "演练", "argument": {}},
        ],
    )
    _write(
        f"{folder}/事件因果关系列表.json",
        [
            {"cause_event_id": "D001", "result_event_id": "D002", "causal_type": "直接因果", "confidence_level": "certain"},
            {"cause_event_id": "D002", "effect_event_id": "D003", "relation_type": "间接传导", "confidence_level": "Probable", "description": "推进"},
            {"cause_event_id": "D009", "result_event_id": "D003"},
            {"cause_event_id": "D001", "result_event_id": "D003"},
        ],
    )
    _write(
        f"{folder}/问题.json",
        [
            _question(1, "multi_hop_causal", "从D001（事故发生）到D003的完整因果链是什么？"),
            _question(2, "single_hop", "D001的主体、地点是什么？"),
            _question(3, "temporal_causal", "D001先于D002，能否认定因果？"),
            _question(4, "grounded_pred", "已知信息止于（D001；D002），请基于因果趋势预测。"),
            _question(5, "counterfactual", "如果阻断D001，D002还会发生吗？"),
            _question(6, "distractor_robustness", "D004与主线是否有关？", "unanswerable"),
            _question(7, "conflicting_sources", "D002的说法应如何认定？"),
            _question(8, "missing_information", "D003缺少哪些信息？若不能，请说明理由。"),
            _question(9, "unanswerable", "D001造成的未来五年损失具体是多少？", "unanswerable"),
            _question(10, "multi_hop_causal", "D001引发了什么连锁反应？"),
            _question(11, "multi_hop_causal", "D003为什么发生？"),
            _question(12, "counterfactual", "如果D001没有发生会怎样？"),
            _question(13, "temporal_causal", "请把D003、D001、D002按时间顺序排列。"),
            _question(14, "grounded_pred", "只掌握D001，请推演后续。"),
            _question(15, "single_hop", "D001的直接下游是什么？"),
            _question(16, "single_hop", "消防队展开救援工作的情况如何？"),
            _question(17, "temporal_causal", "D002先于D001，能否认定因果？"),
            _question(18, "counterfactual", "如果D002没有发生，D003还会发生吗？"),
        ],
    )


def pack_c(folder: str) -> None:
    """Bare documents: two labels named by questions, a digest, a conflict, the rest in stage order."""
    os.makedirs(folder)
    for n in range(1, 13):
        _write(f"{folder}/d{n:03d}.TXT" if n == 12 else f"{folder}/D{n:03d}.txt", f"标题{n}\n这是第{n}篇文档的正文内容。2021年1月{n}日造成影响较大。")
    _write(f"{folder}/D013.txt", "综合报道\n【D002·救援】甲【D003·部署】乙【D004·调查】丙")
    _write(f"{folder}/D014.txt", "两种说法\n双方数据不一致，有待核实。")
    _write(f"{folder}/问题.json", [_question(1, "multi_hop_causal", "D001（爆炸）如何一步步引发D003？"), _question(2, "grounded_pred", "未来的整改与长效机制将怎样发展？")])
