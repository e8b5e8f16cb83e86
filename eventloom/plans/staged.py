"""Registered queries of packs whose events bear stages and arguments: questions without ids, outlooks, summaries, digests, with SQL.

A pack for each order: its lines are events that follow each other, of stages in turn, some with casualties.
The edges' confidences rise along odd orders and fall along even ones, so every ranking has a closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.operators import pack_answer, pack_extract
from eventloom.plans import graphs
from eventloom.plans.graphs import table
from eventloom.plans.lexical import _REPORTS
from eventloom.sources.storage import kept

KINDS = ["事故发生", "现场救援", "善后处置", "责任追究", "专项整治", "长效机制"]
DAY = "2024-01-02"


def stage_packs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every order's pack."""
    own = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    order = Window.partitionBy("l_orderkey").orderBy(*own)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *own).select(
        "l_orderkey", "l_partkey", "l_suppkey", F.floor("l_quantity").cast("string").alias("q"), F.row_number().over(order).cast("long").alias("o"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"),
    )
    lines = kept(lines, "stage-lines")
    g, id_ = F.col("l_orderkey").cast("string").alias("graph_id"), lambda o: F.format_string("D%03d", o)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("o") + F.col("l_orderkey")) % len(KINDS) + 1).cast("int"))
    said = lambda role, value: F.struct(F.lit(role).alias("role"), value.alias("value"))
    hurt = F.when(F.col("l_partkey") % 3 == 0, said("影响", F.concat("q", F.lit("人受伤"))))
    note = F.when(F.col("l_partkey") % 2 == 0, said("内容", F.concat(F.lit("note "), F.col("l_partkey").cast("string"))))
    facts = F.array_compact(F.array(said("主体", F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))), hurt, note))
    nodes = lines.select(
        g, F.col("o").alias("node_ord"), id_(F.col("o")).alias("event_id"), F.lit("").alias("doc_id"), kind.alias("event_type"), kind.alias("trigger"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("mention"),
        facts.alias("arguments"), F.lit(DAY).alias("time"), F.lit("").alias("location"), F.lit(0.9).alias("confidence"),
    )
    share = F.lit(0.5) * F.col("o") / F.col("n")
    edges = lines.where("o < n").select(
        g, F.col("o").alias("edge_ord"), F.format_string("R%03d", F.col("o")).alias("relation_id"), id_(F.col("o")).alias("cause_event_id"), id_(F.col("o") + 1).alias("effect_event_id"),
        F.lit(lx.DIRECT).alias("relation_type"), F.when(F.col("l_orderkey") % 2 == 1, F.lit(0.4) + share).otherwise(F.lit(0.9) - share).alias("confidence"),
    )
    return kept(nodes, "stage-nodes"), kept(edges, "stage-edges")


#: (name, kind of reasoning, question); {n} is the last event's id.
ASKED = [
    ("aftercare", "single_hop", "善后工作如何开展"), ("rescue", "single_hop", "现场是如何组织救援的"), ("outlook", "grounded_pred", "将如何推动责任追究与制度完善"), ("open", "grounded_pred", "未来走势会怎样"),
    ("back", "multi_hop_causal", "{n}因何而起"), ("full", "multi_hop_causal", "请按因果顺序还原{n}的经过"), ("push", "multi_hop_causal", "哪些事件依次推动{n}发生"), ("ahead", "multi_hop_causal", "D001引发了哪些连锁反应"), ("fact", "single_hop", "请概述D001的关键事实"),
]
BROAD = [("late", "请概括长期影响"), ("steps", "梳理关键环节"), ("between", "善后处置到责任追究的关键环节"), ("compared", "善后处置与责任追究有什么不同")]


def _asked(nodes: DataFrame, rows: list[tuple[str, str]], each: int) -> DataFrame:
    """``each`` of the questions (kind of reasoning, question) about every pack, in their turn."""
    sizes = nodes.groupBy("graph_id").agg(F.max("node_ord").alias("n"))
    asked = graphs.in_turn(sizes, rows, ["reasoning_type"], each)
    return kept(asked.withColumns({"question_type": F.lit("retrospective"), "sample_id": F.lit("s"), "pack_id": F.lit("p"), "task": F.lit("B")}), "stage-questions")


def _chains(c: str):
    return F.array_join(F.transform(c, lambda x: F.array_join(x, ",")), ";").alias("chains")


def pack_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions about every order: stages without an id, outlooks from the root, chains back to it with casualties, facts with arguments."""
    nodes, edges = stage_packs(spark, sf_dir)
    found = pack_answer.records(nodes, edges, _asked(nodes, [(kind, q) for _, kind, q in ASKED], 3))
    return found.select("graph_id", "q_ord", F.md5("answers").alias("text_md5"), _chains("evidence_chains"), F.coalesce("confidence_level", F.lit("")).alias("level"), F.round("confidence", 4).alias("confidence"), F.coalesce("hops", F.lit(0)).cast("long").alias("hops"))


def pack_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two broad questions about every order: late effects, steps of all or between two stages, stages compared."""
    nodes, edges = stage_packs(spark, sf_dir)
    found = pack_answer.summaries(nodes, edges, _asked(nodes, [("multi_hop_causal", q) for _, q in BROAD], 2))
    return found.select("graph_id", "q_ord", F.md5("answers").alias("text_md5"), _chains("evidence_chains"), "score", F.col("hops").cast("long").alias("hops"))


def digest_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for each user, with a digest for each purchase that names the stages of the next three reports, and a hint for every tenth event."""
    said = F.create_map(*[F.lit(x) for kv in _REPORTS.items() for x in kv])
    nodes = graphs.user_nodes(spark, sf_dir)
    title = F.concat(F.lit("T"), F.col("source_id").cast("string"))
    o = F.col("node_ord")
    heads = F.format_string("【D%03d·第%d环】甲。【 D %03d ： 第%d环】乙。【D%03d•第%d环】丙。", o + 1, o, o + 2, o, o + 3, o)
    body = F.when(F.col("event_type") == "purchase", heads).otherwise(said[F.col("event_type")])
    id_ = F.format_string("D%03d", o)
    docs = kept(nodes.select("graph_id", "source_id", id_.alias("doc_id"), o.alias("doc_ord"), title.alias("title"), F.concat(title, F.lit("\n"), body).alias("text")), "digests")
    hints = docs.where("source_id % 10 = 0").select("graph_id", F.col("doc_id").alias("event_id"), F.lit("提示环节").alias("label"))
    return pack_extract.events(docs.drop("source_id"), hints).select("graph_id", "event_id", "event_type", "confidence")


QUERIES = {f.__name__: f for f in (pack_stages, pack_summaries, digest_extraction)}

# --- SQL -----------------------------------------------------------------------------------------------------

_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_PACKS = f"""WITH l AS (SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, floor(l_quantity)::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o FROM lineitem),
e AS (SELECT *, {_LIST}[(o + ok) % {len(KINDS)} + 1] AS kind, printf('D%03d', o) AS id, CASE WHEN pk % 3 = 0 THEN q || '人受伤' ELSE '' END AS hurt, 'part ' || pk AS m, CASE WHEN pk % 2 = 0 THEN 'note ' || pk END AS note FROM l),
p AS (SELECT ok, count(*) AS n, list(id ORDER BY o) AS d, list(id || '（' || kind || '）' ORDER BY o) AS lb, list(kind ORDER BY o) AS ks, list(hurt ORDER BY o) AS hs, list(m ORDER BY o) AS ms, max(sk) FILTER (o = 1) AS s1, max(note) FILTER (o = 1) AS n1 FROM e GROUP BY ok),
r AS (SELECT *, ok % 2 = 1 AS up, least(n - 1, 7) AS m, greatest(1, n - 7) AS far, [CASE WHEN ok % 2 = 1 THEN 0.4::DOUBLE + 0.5::DOUBLE * i / n ELSE 0.9::DOUBLE - 0.5::DOUBLE * i / n END FOR i IN range(1, n)] AS cs,
  coalesce(list_position(ks, '善后处置'), 0) AS t1, coalesce(list_position(ks, '现场救援'), 0) AS t2, [i FOR i IN range(n, 1, -1) IF ks[i] IN ('责任追究', '长效机制')][1:2] AS late FROM p),
f AS (SELECT *, CASE WHEN up THEN n - 1 ELSE far END AS i0, CASE WHEN n <= 8 THEN 1 WHEN up THEN n - 1 ELSE far END AS i1 FROM r)"""


def _said(a: str, b: str) -> str:
    return f"array_to_string(lb[{a}:{b}], ' → ')"


def _hurt(a: str, b: str, before: str = "", after: str = "") -> str:
    return f"coalesce('{before}' || [h FOR h IN hs[{a}:{b}] IF h <> ''][1] || '{after}', '')"


def _mean(a: str, b: str) -> str:
    return f"pow(list_product(cs[{a}:{b}]), 1.0::DOUBLE / ({b} - ({a}) + 1))"


_CAREFUL = "'依据现有材料可作如下审慎判断：' || lb[1] || '：' || ms[1] || '。受材料信息完整度限制，该结论置信度有限，如后续有官方调查结论或更完整记录，应以其为准。'"
_MISSED = f"'问题所询问的具体事件在材料中未直接定位，但该包最早记载事件为' || lb[1] || '——主体：supplier ' || s1 || CASE WHEN hs[1] <> '' THEN '；影响：' || hs[1] ELSE '' END || coalesce('；内容：' || n1, '') || '；时间：{DAY}。可能因事件命名或编号差异导致未能精确匹配。'"
_ALONG = "'基于因果走势，预计' || lb[1] || '后续将推动：' || array_to_string(lb[2:least(n, 7)], '、') || '。该展望严格沿图中因果边推导，不引入材料外信息。'"
_EFFECTS = "CASE WHEN up THEN [d[1:h + 1] FOR h IN range(m, greatest(1, m - 5) - 1, -1)] ELSE [d[1:h + 1] FOR h IN range(1, least(m, 6) + 1)] END"
_CAUSES = "CASE WHEN up THEN [d[i:n] FOR i IN range(n - 1, greatest(1, n - 6) - 1, -1)] ELSE [d[i:n] FOR i IN range(far, least(n - 1, far + 5) + 1)] END"
_ALONG_SCORE, _ALONG_HOPS = f"CASE WHEN up THEN {_mean('1', 'm')} ELSE cs[1] END", "CASE WHEN up THEN m ELSE least(m, 6) END"
_FULL = f"CASE WHEN n <= 8 THEN [d] ELSE {_CAUSES} END"
_TO_LAST = _mean("i1", "(n - 1)")


def _stage(t: str) -> tuple[str, str, str, str]:
    return (
        f"CASE WHEN {t} > 0 THEN lb[{t}] || '：' || ms[{t}] || '。' ELSE {_MISSED} END", f"CASE WHEN {t} > 1 THEN [[d[1], d[{t}]]] ELSE [[d[1]]] END",
        f"CASE WHEN {t} > 0 THEN 0.6::DOUBLE ELSE 0.25 END", f"CASE WHEN {t} > 1 THEN 1 ELSE 0 END",
    )


#: name: text, chains, score, hops
_WANT = {
    "aftercare": _stage("t1"), "rescue": _stage("t2"),
    "outlook": (
        f"CASE WHEN len(late) > 0 THEN '基于因果走势，预计' || lb[1] || '后续将推动' || array_to_string([lb[i] FOR i IN late], '、') || '等治理层面的深远变化。该展望严格沿图中因果链推导，不引入材料外信息。' ELSE {_ALONG} END",
        f"CASE WHEN len(late) > 0 THEN [[d[1], d[i]] FOR i IN late] ELSE {_EFFECTS} END", f"CASE WHEN len(late) > 0 THEN 0.6::DOUBLE ELSE {_ALONG_SCORE} END", f"CASE WHEN len(late) > 0 THEN 1 ELSE {_ALONG_HOPS} END",
    ),
    "open": (_ALONG, _EFFECTS, _ALONG_SCORE, _ALONG_HOPS),
    "back": (f"'导致' || lb[n] || '的主要因果链：' || {_said('i0', 'n')} || '。直接原因：' || lb[n - 1] || '。' || {_hurt('i0', 'n', after='。')}", _CAUSES, _mean("i0", "(n - 1)"), "n - i0"),
    "full": (f"'完整因果链：' || {_said('i1', 'n')} || '。其中，' || ks[i1] || '为起点，经逐级传导，最终导致' || ks[n] || {_hurt('i1', 'n', before='；')} || '。'", _FULL, _TO_LAST, "n - i1"),
    "push": (f"'该结果由一条有向因果链推动：' || {_said('i1', 'n')} || '。起点为' || ks[i1] || '，终点为' || ks[n] || {_hurt('i1', 'n', before='；')} || '。'", _FULL, _TO_LAST, "n - i1"),
    "ahead": (f"lb[1] || '直接引发：' || lb[2] || {_hurt('1', '2', before='；')} || '。主要连锁影响链：' || {_said('1', '2')} || '。'", "[d[1:h + 1] FOR h IN range(1, least(m, 6) + 1)]", "cs[1]", "1"),
    "fact": (f"'据材料，' || lb[1] || '的主体为supplier ' || s1 || '，发生时间为{DAY}；' || coalesce(n1, ms[1]) || '。' || {_hurt('1', 'n', before='其影响：', after='。')}", "[[d[1]]]", "0.9::DOUBLE", "0"),
}
_LONE = ("outlook", "open", "back", "full", "push", "ahead")


def _pick(i: int) -> str:
    lone = (_CAREFUL, "[[d[1]]]", "0.36::DOUBLE", "1")[i]
    return "CASE k " + " ".join(f"WHEN '{k}' THEN " + (f"CASE WHEN n = 1 THEN {lone} ELSE {v[i]} END" if k in _LONE else v[i]) for k, v in _WANT.items()) + " END"


_MAIN = "array_to_string([lb[i] || '：' || ms[i] FOR i IN {0}[1:8]], '；')"
_BROAD_SQL = f"""z AS (SELECT *, [i FOR i IN range(1, n + 1) IF ks[i] IN ('善后处置', '责任追究')][1:8] AS named, [i FOR i IN range(1, n + 1)] AS every FROM f),
b(q, k) AS (VALUES {', '.join(f"({i}, '{k}')" for i, (k, _) in enumerate(BROAD))}),
x AS (SELECT *, CASE WHEN k = 'compared' AND len(named) > 0 THEN named WHEN k = 'between' AND len(named) > 1 THEN every[named[1]:named[-1]] WHEN k IN ('steps', 'between') THEN every ELSE every[greatest(n - greatest(2, (n + 2) // 3) + 1, 1):] END AS ids,
  CASE WHEN k IN ('steps', 'between') THEN '按因果顺序梳理的关键环节：' WHEN k = 'compared' AND len(named) > 0 THEN '可从以下材料要点展开比较：' ELSE '综合材料，主要影响与后续进展包括：' END AS said FROM z JOIN b ON b.q IN (ok % 4, (ok + 2) % 4))"""

ORACLE = {
    "pack_stages": f"""{_PACKS},
a(q, k, rt) AS (VALUES {', '.join(f"({i}, '{k}', '{kind}')" for i, (k, kind, _) in enumerate(ASKED))}),
x AS (SELECT f.*, a.* FROM f JOIN a ON a.q IN (ok % 9, (ok + 3) % 9, (ok + 6) % 9)),
y AS (SELECT *, {_pick(0)} AS text, {_pick(1)} AS ch, {_pick(2)} AS score, {_pick(3)} AS hops FROM x)
SELECT ok::VARCHAR AS graph_id, q::BIGINT AS q_ord, md5(text) AS text_md5, array_to_string([array_to_string(c, ',') FOR c IN ch], ';') AS chains,
  CASE WHEN rt = 'single_hop' THEN CASE WHEN score >= 0.6 THEN 'certain' WHEN score >= 0.4 THEN 'probable' WHEN score >= 0.25 THEN 'possible' ELSE '' END
    WHEN rt = 'multi_hop_causal' AND score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'probable' WHEN score >= 0.35 THEN 'possible' ELSE 'low' END AS level,
  printf('%.4f', score)::DOUBLE AS confidence, hops::BIGINT AS hops FROM y""",
    "pack_summaries": f"""{_PACKS}, {_BROAD_SQL}
SELECT ok::VARCHAR AS graph_id, q::BIGINT AS q_ord, md5(said || {_MAIN.format('ids')} || '。') AS text_md5, array_to_string([d[i] FOR i IN ids], ',') AS chains, CASE WHEN said[1:3] = '可从以' THEN 0.5 ELSE 0.55 END::DOUBLE AS score, greatest(len(ids) - 1, 1)::BIGINT AS hops FROM x""",
    "digest_extraction": f"""WITH e AS (SELECT user_id::VARCHAR AS g, row_number() OVER w AS o, event_type AS k, event_id, lag(event_type, 1) OVER w AS k1, lag(event_type, 2) OVER w AS k2, lag(event_type, 3) OVER w AS k3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN '提示环节' WHEN k3 = 'purchase' THEN '第' || (o - 3) || '环' WHEN k2 = 'purchase' THEN '第' || (o - 2) || '环' WHEN k1 = 'purchase' THEN '第' || (o - 1) || '环' END AS hint,
  CASE k WHEN 'purchase' THEN '综合汇编' WHEN 'error' THEN '矛盾来源' WHEN 'signup' THEN '背景信息' END AS special FROM e),
p AS (SELECT *, coalesce(special, hint) AS fixed, count(*) FILTER (special IS NULL AND hint IS NULL) OVER (PARTITION BY g ORDER BY o) AS place FROM h)
SELECT g AS graph_id, printf('D%03d', o) AS event_id, CASE WHEN fixed IS NOT NULL THEN fixed WHEN place <= 10 THEN {"[" + ", ".join(f"'{w}'" for w in lx.STAGES) + "]"}[place] WHEN k = 'click' THEN '后续事件' || (place - 10) ELSE 'T' || event_id END AS event_type,
  CASE WHEN special IS NOT NULL THEN 0.35 WHEN hint IS NOT NULL THEN 0.7 ELSE 0.55 END::DOUBLE AS confidence FROM p""",
}
