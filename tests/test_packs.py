import json

import pack_fixture
import pytest
from pyspark.sql import functions as F

from eventloom.operators import pack_anchor
from eventloom.plans import packs


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("数据")
    pack_fixture.pack_a(f"{folder}/包A")
    pack_fixture.pack_c(f"{folder}/包C")
    records, submission, summary = packs.run_packs(spark, str(folder), f"{folder}/out")
    got = {(r.graph_id, r.sample_id): r for r in records.collect()}
    return got, {(r.graph_id, r.sample_id): r for r in submission.collect()}, {r.graph_id: r for r in summary.collect()}, folder


WANT = {
    1: ("probable", 0.7649, [["D001", "D002", "D003"], ["D001", "D003"]]), 2: ("certain", 0.95, [["D001"]]), 3: ("high", 0.9, [["D001", "D002"]]), 4: ("probable", 0.6, [["D001", "D002"]]),
    5: ("probable", 0.7, [["D001", "D002"]]), 6: ("possible", 0.5, [["D004"]]), 7: ("possible", 0.42, [["D002"]]), 8: ("possible", 0.42, [["D003"]]), 9: ("possible", 0.38, [["D001", "D002"]]),
    10: ("high", 0.9, [["D001", "D002"], ["D001", "D003"]]), 11: ("probable", 0.65, [["D002", "D003"], ["D001", "D003"]]), 12: ("probable", 0.8, [["D001", "D002"], ["D001", "D003"]]),
    13: ("probable", 0.65, [["D001", "D002", "D003"]]), 14: ("probable", 0.65, [["D001", "D002", "D003"]]), 15: ("high", 0.9, [["D001", "D002"], ["D001", "D003"]]), 16: ("certain", 0.6, [["D001", "D002"]]),
    17: ("possible", 0.36, [["D002", "D001"]]), 18: ("probable", 0.6, [["D001", "D003"]]),
}


def test_given_pack(ran):
    got, submitted, summary, _ = ran
    for n, (level, score, chains) in WANT.items():
        r = got["包A", f"s{n}"]
        assert (r.confidence_level, r.confidence, r.evidence_chains) == (level, score, chains), n
    assert got["包A", "s1"].answers == "完整因果链：D001（事故发生） → D002（现场救援） → D003（官方部署）。其中，事故发生为起点，经逐级传导，最终导致官方部署；12人遇难。"
    assert got["包A", "s2"].answers == "据材料，D001（事故发生）的主体为化工厂，发生地为甲市，发生时间为2020-03-04；化工厂爆炸。其影响：12人遇难。"
    assert submitted["包A", "s1"].confidence == 0.45 and submitted["包A", "s9"].answer == "无法确定" and submitted["包A", "s9"].evidence_chain == []
    assert (summary["包A"].task, summary["包A"].node_count, summary["包A"].edge_count, summary["包A"].question_types) == ("A", 4, 3, {"retrospective": 16, "unanswerable": 2})


def test_bare_documents(ran, spark):
    _, _, summary, folder = ran
    assert summary["包C"].task == "C" and summary["包C"].node_count == 14
    g = packs.pack_graphs(spark, str(folder))
    kinds = [r.event_type for r in g["nodes"].where("graph_id = '包C'").orderBy("node_ord").collect()]
    assert kinds == ["爆炸", "救援", "部署", "调查", "事故发生", "现场救援", "官方部署", "原因调查", "责任追究", "善后处置", "隐患分析", "专项整治", "综合汇编", "矛盾来源"]


def test_files_of_results_and_packs_of_one_name(spark, tmp_path):
    for side in ("x", "y"):
        (tmp_path / side).mkdir()
        pack_fixture.pack_a(f"{tmp_path}/{side}/包A")
    packs.main([str(tmp_path), f"{tmp_path}/out"])
    for side in ("x", "y"):
        rows = json.loads((tmp_path / f"out/packs/{side}/包A.json").read_text())
        assert [r["sample_id"] for r in rows] == [f"s{n}" for n in range(1, 19)] and rows[0]["evidence_chains"] == WANT[1][2] and rows[0]["task"] == "A"
    sent = json.loads((tmp_path / "out/submit_answers.json").read_text())
    assert len(sent) == 36 and sent[0]["sample_id"] == "s1" and {r["graph_id"]: r["node_count"] for r in json.loads((tmp_path / "out/run_summary.json").read_text())} == {"x/包A": 4, "y/包A": 4}


def test_no_packs(spark, tmp_path):
    (tmp_path / "x.json").write_text("[]")
    with pytest.raises(FileNotFoundError):
        packs.pack_graphs(spark, str(tmp_path))


def test_enumerations(spark):
    rows = [("截至D006，（D004甲；D005乙；D001）",), ("材料仅显示：D002与D003，以及D002",), ("D007之后",)]
    got = [r[0] for r in spark.createDataFrame(rows, "question string").select(pack_anchor.enumerated(F.col("question"))).collect()]
    assert got == [["D004", "D005", "D001"], ["D002", "D003"], ["D007"]]


def test_phrases(spark):
    short, long = F.array(F.lit("现场救援")), F.array(F.lit("航班MH370失联后各方搜寻"))
    rows = [("MH370怎么了",), ("关于现场救援的安排",), ("车站疏散人群",), ("各方搜寻飞机的持续行动",), ("今天天气不错",)]
    got = [r[0] for r in spark.createDataFrame(rows, "question string").select(pack_anchor.phrase_hit(F.col("question"), short, long)).collect()]
    assert [(h.strength if h else None) for h in got] == [3, 2, None, 1, None]
