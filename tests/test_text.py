import re
from decimal import Decimal

from pyspark.sql import functions as F

from eventloom.functions import numbers as nu
from eventloom.functions import text as tx
from eventloom.operators import calibrate, extract, mapping


def values(spark, data, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, ddl).select(*columns).collect()]


def test_rounding_is_that_of_the_binary_value(spark):
    xs = [0.25, 0.35, 0.45, 0.125, 0.615, 1.005, 0.5, 2.675, 0.0, 1.0, 0.7649999, 0.285, 123456.785]
    for digits in (1, 2, 4):
        got = values(spark, [(x,) for x in xs], "x double", nu.exact_round(F.col("x"), digits))
        assert [g[0] for g in got] == [round(x, digits) for x in xs]
    assert [g[0] for g in values(spark, [(x,) for x in xs], "x double", nu.fixed(F.col("x")))] == [f"{x:.2f}" for x in xs]
    assert Decimal(0.615) < Decimal("0.615")


def test_edge_confidence(spark):
    got = values(spark, [("1.5",), (None,), ("x",), ("-1",), ("0.4",), ("NaN",)], "x string", nu.edge_confidence(F.col("x")))
    assert [g[0] for g in got] == [1.0, 1.0, 1.0, 0.0, 0.4, 1.0]


def test_sentences_have_offsets(spark):
    texts = ["甲。乙！\n丙", "", None, "x", "。。", " a ;b"]
    got = values(spark, [(t,) for t in texts], "t string", tx.sentences(F.col("t")))
    for t, (s,) in zip(texts, got, strict=True):
        want = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^。！？；!?;\n]+", t or "")]
        assert [tuple(x) for x in s] == want


def test_triggers_times_and_places(spark):
    rows = [("2024年7月3日，据美国宣布后发生事故", "2020-01-01"), ("7月3日引发", "x2021y"), ("2024-7-3 a", ""), ("2024/07/03 b", ""), ("7月3日", ""), ("无", None)]
    got = values(spark, rows, "t string, p string", tx.time_in(F.col("t"), F.col("p")), tx.location_in(F.col("t")), tx.first_trigger(F.col("t")))
    assert [g[0] for g in got] == ["2024-07-03", "2021-07-03", "2024-7-3", "2024/07/03", "7月3日", ""]
    assert got[0][1] == "美国" and got[0][2].trigger == "宣布" and got[0][2].kind == "政策/发布" and got[0][2].position == 13 and got[5][2] is None


def test_overlap_and_ids(spark):
    got = values(spark, [("暴雨预警", "开封暴雨"), ("a", "ba"), ("a", "b"), ("", "x"), (None, "x")], "a string, b string", tx.gram_overlap(F.col("a"), F.col("b")))
    assert [round(g[0], 6) for g in got] == [0.333333, 1.0, 0.0, 0.0, 0.0]
    got = values(spark, [("D001、D002与D001，D12",), ("",)], "t string", tx.ids_in(F.col("t")), tx.id_number(F.col("t")), tx.trailing_number(F.col("t")))
    assert got[0] == (["D001", "D002"], 1, 12) and got[1] == ([], 10**9, 10**9)


def test_mapping(spark):
    got = values(spark, [("灾害/意外-爆炸",), ("公司裁员潮",), ("xyz",), (None,), ("外交会谈",)], "t string", mapping.event_type(F.col("t")), mapping.type_covered(F.col("t")))
    assert got == [("灾害/事故", True), ("经济/涨跌", True), ("社会/舆情", False), ("社会/舆情", False), ("政策/发布", True)]
    got = values(spark, [("死亡人数",), ("发布方",), ("",), ("怪",), ("救援手段",)], "t string", mapping.role(F.col("t")))
    assert [g[0] for g in got] == ["object", "subject", "object", "怪", "instrument"]


def test_rule_extraction(spark):
    docs = spark.createDataFrame([("d1", "2024年7月3日，开封市发生内涝。无事。7月4日使用水泵排水，爆发抗议！", "2024-07-05"), ("d2", "宣布以强硬的方式出台", "")], "doc_id string, text string, publish_time string")
    got = extract.events(docs).orderBy("node_ord").collect()
    assert [(r.event_id, r.event_type, r.trigger, r.time, r.location, r.confidence) for r in got] == [("E001", "灾害/事故", "发生", "2024-07-03", "开封市", 0.9), ("E002", "灾害/事故", "爆发", "2024-07-04", "", 0.8), ("E003", "政策/发布", "宣布", "", "", 0.7)]
    assert [(a.role, a.value) for a in got[1].arguments] == [("time", "2024-07-04"), ("instrument", "水泵排水")] and [(a.role, a.value) for a in got[2].arguments] == [("manner", "强硬")]
    broken = extract.contract(extract.events(docs), docs).first()
    assert tuple(broken) == (0, 0, 0, 0, 0)


def test_noun_picks(spark):
    words = [("消防队", "n", 0, 3), ("在", "p", 3, 4), ("昨天", "t", 4, 6), ("扑灭", "v", 6, 8), ("了", "u", 8, 9), ("一些", "n", 9, 11), ("大火", "n", 11, 13)]
    df = spark.createDataFrame([(words,)], f"w {extract.TOKENS}").withColumn("i", extract.trigger_index(F.col("w"), F.lit(7)))
    assert tuple(df.select("i", extract.noun_before(F.col("w"), F.col("i")), extract.noun_after(F.col("w"), F.col("i"))).first()) == (3, "消防队", "大火")


def test_model_scores_decode(spark):
    rows = [("d", 0, 0, "厂房爆炸", "灾害/事故", 0.9, "trigger", 2, 4), ("d", 0, 0, "厂房爆炸", "灾害/事故", 0.9, "subject", 0, 2), ("d", 0, 0, "厂房爆炸", "社会/舆情", 0.8, "subject", 0, 2), ("d", 0, 5, "停产", "经济/涨跌", 0.4, "trigger", 0, 2)]
    got = extract.decoded(spark.createDataFrame(rows, "doc_id string, doc_ord int, sent_start int, sentence string, event_type string, type_prob double, role string, start int, end int")).collect()
    assert [(r.event_id, r.trigger, r.confidence, [(a.role, a.value) for a in r.arguments]) for r in got] == [("E001", "爆炸", 0.9, [("subject", "厂房")])]


def test_missing_model(spark):
    import pytest

    with pytest.raises(FileNotFoundError):
        extract.events(spark.createDataFrame([], "doc_id string, text string, publish_time string"), model="pai")


def test_calibration(spark):
    rows = [("multi_hop_causal", 0.9), ("multi_hop_causal", 0.55), ("single_hop", 0.05), ("x", 0.7), ("counterfactual", 0.1), ("grounded_pred", None), ("temporal_causal", 0.45)]
    got = values(spark, rows, "k string, s double", calibrate.confidence(F.col("k"), F.col("s")), calibrate.level_for(F.col("k"), F.col("s")))
    assert got == [(0.42, "high"), (0.05, "possible"), (0.25, None), (0.6, "probable"), (0.2, "low"), (None, None), (0.26, "possible")]


def test_numbers_over_a_whole_table(spark):
    from eventloom.operators.numbering import numbered

    df = spark.range(1000).repartition(7).withColumn("x", -F.col("id"))
    got = numbered(df, ["x"], "n").collect()
    assert {(r.id, r.n) for r in got} == {(i, 1000 - i) for i in range(1000)}
    assert numbered(df.limit(0), ["x"], "n").count() == 0


def test_sentences_of_long_texts(spark):
    for n in (0, 1, 63, 64, 65, 129, 700):
        pieces = ["" if i % 7 == 3 else "é" * (i % 5 + 1) for i in range(n)]
        text = "。".join(pieces)
        want, at = [], 0
        for p in pieces:
            if p:
                want.append((p, at, at + len(p)))
            at += len(p) + 1
        got = spark.createDataFrame([(text,)], "t string").select(tx.sentences(F.col("t")).alias("s")).first().s
        assert [tuple(s) for s in got] == want
