"""Registered queries of answers: causal questions over the lines of orders, and pack questions of every branch, with SQL.

A graph for each order: its lines lead from one to the next by their discounts, and an outside event
leads to the last. Its paths, interventions and answers have closed forms that SQL can write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators import answer, pack_answer
from eventloom.plans import graphs
from eventloom.plans.graphs import table
from eventloom.sources.storage import kept

OUTSIDE = 1000  # the outside event's place in its graph


def line_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every order's graph."""
    own = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"]
    order = Window.partitionBy("l_orderkey").orderBy(*own)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *own).select(
        F.col("l_orderkey").cast("string").alias("graph_id"), F.row_number().over(order).cast("long").alias("o"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"),
        ((F.lit(50) + 4 * F.round(F.col("l_discount") * 100)) / 100.0).alias("c"),
    )
    lines = kept(lines, "order-lines")
    name = lambda o: F.format_string("line%03dx", o)
    line = lines.select("graph_id", F.concat(F.lit("L"), "o").alias("event_id"), F.col("o").alias("node_ord"), name(F.col("o")).alias("mention"))
    last = lines.where("o = n")
    nodes = line.unionByName(last.select("graph_id", F.lit("X").alias("event_id"), F.lit(OUTSIDE).cast("long").alias("node_ord"), F.lit("outsidex").alias("mention")))
    edges = lines.where("o < n").select("graph_id", F.col("o").alias("edge_ord"), F.concat(F.lit("R"), "o").alias("relation_id"), F.concat(F.lit("L"), "o").alias("cause_event_id"), F.concat(F.lit("L"), F.col("o") + 1).alias("effect_event_id"), F.col("c").alias("confidence"))
    edges = edges.unionByName(last.select("graph_id", F.lit(OUTSIDE).cast("long").alias("edge_ord"), F.lit("RX").alias("relation_id"), F.lit("X").alias("cause_event_id"), F.concat(F.lit("L"), "n").alias("effect_event_id"), F.lit(0.6).alias("confidence")))
    return nodes.withColumns({"trigger": F.col("mention"), "event_type": F.lit("")}), edges.withColumn("evidence", F.array("relation_id"))


def line_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four questions about every order: what led to its last line and what its first leads to; what may follow the
    first; and what if the first hadn't been, in itself and for the last."""
    nodes, edges = (kept(df, "line-graph") for df in line_graph(spark, sf_dir))
    last = nodes.where("event_id <> 'X'").groupBy("graph_id").agg(F.max("node_ord").alias("n"))
    end = F.format_string("line%03dx", F.col("n"))
    asked = F.array(*[
        F.struct(F.lit(k).alias("query_id"), F.lit(kind).alias("question_type"), q.alias("question"))
        for k, kind, q in (
            ("back", answer.KINDS[0], F.concat(F.lit("为什么出现"), end)), ("ahead", answer.KINDS[0], F.lit("line001x会引发什么")), ("tree", answer.KINDS[1], F.lit("line001x之后")),
            ("alone", answer.KINDS[2], F.lit("假如没有line001x")), ("pair", answer.KINDS[2], F.concat(F.lit("假如没有line001x，还有"), end)), ("none", answer.KINDS[0], F.lit("天气")), ("odd", "其他", F.lit("line001x")),
        )
    ])
    queries = kept(last.select("graph_id", F.explode(asked).alias("q")).select("graph_id", "q.*"), "line-questions")
    found = answer.answers(nodes, edges, queries)
    list_ = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.round(c, 4), F.lit(-1.0)).alias(c)
    return found.select(
        "graph_id", "query_id", F.md5("answer_text").alias("text_md5"), list_("evidence_chain"), F.round("confidence", 4).alias("confidence"), F.coalesce("direction", F.lit("")).alias("direction"),
        F.coalesce("target_event_id", F.lit("")).alias("target"), F.coalesce("chain_count", F.lit(-1)).cast("long").alias("n_chains"), number("pn"), number("ps"), number("pns"), list_("cascaded_ids"), list_("alive_ids"),
    )


def branching_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What led to, follows from and may come of each event type of each user: graphs with branches, loops, ties and dangling types.
    Tags of necessary causes are left out of the texts; ``necessity_sufficiency`` has their numbers."""
    nodes, edges = graphs.type_graph(spark, sf_dir)
    nodes = kept(nodes.select("graph_id", "event_id", "node_ord", F.col("event_id").alias("mention"), F.col("event_id").alias("trigger"), F.lit("").alias("event_type")), "branching-nodes")
    edges = kept(edges.withColumn("evidence", F.array().cast("array<string>")), "branching-edges")
    asked = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(kind).alias("question_type"), F.concat(F.lit(a), F.col("event_id"), F.lit(b)).alias("question"))
        for k, kind, a, b in (("back", answer.KINDS[0], "为什么出现", ""), ("ahead", answer.KINDS[0], "", "会引发什么"), ("tree", answer.KINDS[1], "", "之后"))
    ])).alias("q")
    queries = nodes.select("graph_id", "event_id", asked).select("graph_id", F.concat_ws("-", "q.k", "event_id").alias("query_id"), "q.question_type", "q.question")
    found = answer.answers(nodes, edges, kept(queries, "branching-questions"))
    text = F.regexp_replace("answer_text", "，且为其必要原因", "")
    return found.select("graph_id", "query_id", F.md5(text).alias("text_md5"), F.coalesce(F.array_join("evidence_chain", ","), F.lit("")).alias("evidence_chain"), F.round("confidence", 4).alias("confidence"), F.coalesce("chain_count", F.lit(0)).cast("long").alias("n_chains"))


#: (name, kind of question, kind of reasoning, question); {n} is the last event's id.
ASKED = [
    ("two", "retrospective", "multi_hop_causal", "D001到D002的因果链如何？"), ("next", "retrospective", "multi_hop_causal", "D001的直接下游是什么"), ("ahead", "retrospective", "multi_hop_causal", "D001引发了哪些连锁反应"),
    ("cause", "retrospective", "multi_hop_causal", "{n}的直接原因是什么"), ("lost", "retrospective", "multi_hop_causal", "这次供应为何中断"), ("fact", "retrospective", "single_hop", "请概述D001的关键事实"),
    ("missed", "retrospective", "single_hop", "记载了哪些善后信息"), ("order", "retrospective", "temporal_causal", "把D002、D001按时间顺序排列"), ("soon", "predictive", "grounded_pred", "已知D001，预测后续"),
    ("long", "predictive", "grounded_pred", "材料仅显示D001，预测后续"), ("alone", "retrospective", "counterfactual", "如果D001没有发生会怎样"), ("general", "retrospective", "counterfactual", "如果关键条件没有发生会怎样"),
    ("amount", "unanswerable", "unanswerable", "D001的精确量化结果"), ("absent", "unanswerable", "unanswerable", "D001是否记载联系方式"), ("premise", "unanswerable", "unanswerable", "既然D001并未出现，怎么办"),
    ("sources", "unanswerable", "unanswerable", "关于D001各方说法矛盾吗"), ("unknown", "unanswerable", "unanswerable", "D001怎么样"), ("missing", "retrospective", "missing_information", "D001缺失了哪些信息"),
    ("apart", "retrospective", "distractor_robustness", "D001与主线有关吗"), ("conflict", "retrospective", "conflicting_sources", "D001以哪个说法为准"), ("turned", "retrospective", "multi_hop_causal", "D002到D001的因果链如何？"),
]


def pack_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions about every order that has lines, the kinds in their turn; an order of one line has no relation to answer from."""
    g = graphs.order_packs(spark, sf_dir)
    sizes = g["nodes"].groupBy("graph_id").agg(F.max("node_ord").alias("n"))
    asked = graphs.in_turn(sizes, [(kind, reason, q) for _, kind, reason, q in ASKED], ["question_type", "reasoning_type"], 3)
    questions = asked.withColumns({"sample_id": F.lit("s"), "pack_id": F.lit("p"), "task": F.lit("B")})
    found = kept(pack_answer.records(g["nodes"], g["edges"], kept(questions, "branch-questions")), "branch-records")
    sent = pack_answer.submission(found).select("graph_id", "q_ord", F.md5("answer").alias("sent_md5"), F.array_join("evidence_chain", ",").alias("sent_chain"), F.coalesce("confidence", F.lit(-1.0)).alias("sent_confidence"))
    chains = F.array_join(F.transform("evidence_chains", lambda c: F.array_join(c, ",")), ";")
    own = found.select("graph_id", "q_ord", F.md5("answers").alias("text_md5"), chains.alias("chains"), F.coalesce("confidence_level", F.lit("")).alias("level"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), F.coalesce("hops", F.lit(0)).cast("long").alias("hops"))
    return own.join(sent, ["graph_id", "q_ord"])


QUERIES = {f.__name__: f for f in (line_answers, branching_answers, pack_branches)}

# --- SQL -----------------------------------------------------------------------------------------------------

# Rounded by printf, which rounds the exact binary value, as the operators do.
_SPAN = "[printf('line%03dx', i) FOR i IN range({0}, {1} + 1)]"


def _said(a: str, b: str) -> str:
    return f"array_to_string({_SPAN.format(a, b)}, ' -> ')"


_LINES = """
li AS (SELECT l_orderkey::VARCHAR AS g, row_number() OVER w AS o, count(*) OVER (PARTITION BY l_orderkey) AS n, (50 + 4 * round(l_discount * 100)) / 100.0::DOUBLE AS c
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount)),
gr AS (SELECT g, any_value(n) AS n, list(c ORDER BY o) AS cs FROM li GROUP BY g),
st AS (SELECT g, n, cs, unnest(range(1, n)) AS i FROM gr),
pr AS (SELECT g, n, i, n - i AS d, list_product(cs[i:n - 1]) AS p, list_product(cs[1:i]) AS q, cs[i] AS c FROM st)"""
_BACK = f"""
bc AS (SELECT g, n, 'L' || i AS id, i AS ord, d AS hops, p, {_said('i', 'n')} AS said, printf('line%03dx', i) AS m, array_to_string(['R' || k FOR k IN range(i, n)], ',') AS rids, i = 1 AS root, d = 1 AS near FROM pr WHERE d <= 5
  UNION ALL SELECT g, n, 'X', {OUTSIDE}, 1, 0.6, 'outsidex -> ' || printf('line%03dx', n), 'outsidex', 'RX', true, true FROM gr),
br AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p DESC, hops, ord) AS r,
  near AND (CASE WHEN id = 'X' THEN CASE WHEN n = 1 OR n > 6 THEN 1 ELSE round(1 - (SELECT p FROM pr WHERE pr.g = bc.g AND pr.i = 1), 6) END ELSE 0.4 END >= 0.5) AS tag FROM bc),
bk AS (SELECT g, 'back' AS query_id, '「' || printf('line%03dx', n) || '」的因果追溯如下：' || chr(10) || '直接原因：' || string_agg(m || '（强度' || printf('%.2f', p) || CASE WHEN tag THEN '，且为其必要原因' ELSE '' END || '）', '、' ORDER BY ord) FILTER (near) || chr(10)
    || '多条因果链（按强度排序）：' || chr(10) || string_agg('  · ' || said || '（联合置信度 ' || printf('%.2f', p) || '）', chr(10) ORDER BY r) || chr(10) || '根本原因（根事件）：' || string_agg(m, '、' ORDER BY p DESC, ord) FILTER (root) AS text,
  min_by(rids, r) AS evidence_chain, printf('%.4f', least(min_by(p, r), 0.99))::DOUBLE AS confidence, 'backward' AS direction, 'L' || n AS target, count(*) AS n_chains, -1.0 AS pn, -1.0 AS ps, -1.0 AS pns, '' AS cascaded_ids, '' AS alive_ids FROM br GROUP BY g, n)"""
_AHEAD = f"""
ac AS (SELECT g, n, i + 1 AS ord, i AS hops, q AS p, {_said('1', '(i + 1)')} AS said, printf('line%03dx', i + 1) AS m, i + 1 = n AS fin FROM pr WHERE i <= 5),
ah AS (SELECT g, 'ahead' AS query_id, '「line001x」可能引发的后续如下：' || chr(10) || '直接后果：' || string_agg(m || '（强度' || printf('%.2f', p) || '）', '、') FILTER (hops = 1) || chr(10) || '多条影响链（按强度排序）：' || chr(10)
    || string_agg('  · ' || said || '（联合置信度 ' || printf('%.2f', p) || '）', chr(10) ORDER BY hops) || coalesce(chr(10) || '最终后果：' || string_agg(m || '（强度' || printf('%.2f', p) || '）', '、') FILTER (fin), '') AS text,
  'R1' AS evidence_chain, printf('%.4f', least(max(p), 0.99))::DOUBLE AS confidence, 'forward' AS direction, 'L1' AS target, count(*) AS n_chains, -1.0 AS pn, -1.0 AS ps, -1.0 AS pns, '' AS cascaded_ids, '' AS alive_ids FROM ac GROUP BY g, n)"""
_TREE = f"""
tn AS (SELECT g, n, i, q, printf('%.4f', q)::DOUBLE AS r, least(n - 1, 3) AS last FROM pr WHERE i <= 3),
tr AS (SELECT g, 'tree' AS query_id, '从「line001x」出发的可能性树（每层概率 = 上层概率 × 边置信度）：' || chr(10) || 'line001x（p=1.00）' || chr(10) || string_agg(repeat('   ', i - 1) || '└─ ' || printf('line%03dx', i + 1) || '（p=' || printf('%.2f', r) || '）', chr(10) ORDER BY i) || chr(10)
    || '最可能的最终态势：「' || printf('line%03dx', last + 1) || '」（概率 ' || printf('%.2f', max_by(r, i)) || '）' AS text,
  array_to_string(['R' || k FOR k IN range(1, last + 1)], ',') AS evidence_chain, printf('%.4f', least(max_by(r, i), 0.99))::DOUBLE AS confidence, '' AS direction, 'L1' AS target, -1 AS n_chains, -1.0 AS pn, -1.0 AS ps, -1.0 AS pns, '' AS cascaded_ids, '' AS alive_ids FROM tn GROUP BY g, n, last)"""
_WHATIF = f"""
md AS (SELECT g, n, array_to_string({_SPAN.format('2', '(n - 1)')}, '、') AS lost, array_to_string(['L' || i FOR i IN range(2, n)], ',') AS ids, printf('line%03dx', n) AS m, (SELECT p FROM pr WHERE pr.g = gr.g AND pr.i = 1 AND gr.n <= 6) AS ps,
  array_to_string(['R' || k FOR k IN range(1, n)], ',') AS rids FROM gr),
al AS (SELECT g, 'alone' AS query_id, CASE WHEN n > 2 THEN '若「line001x」没有发生，将**连带消失**的事件为：' || lost || '。' || chr(10) || '仍有其它起因、不受影响的最终结果：「' || m || '」。' ELSE '「line001x」在图中没有只依赖它的下游事件，删除它不影响其它事件。' END AS text,
  CASE WHEN n > 2 THEN 'R1' ELSE '' END AS evidence_chain, CASE WHEN n > 2 THEN 0.9 ELSE 0 END AS confidence, '' AS direction, CASE WHEN n > 2 THEN 'L1' ELSE '' END AS target, -1 AS n_chains, -1.0 AS pn, -1.0 AS ps, -1.0 AS pns, CASE WHEN n > 2 THEN ids ELSE '' END AS cascaded_ids, CASE WHEN n > 2 THEN 'L' || n || ',X' ELSE '' END AS alive_ids FROM md),
pa AS (SELECT g, 'pair' AS query_id, '反事实「若 line001x 未发生」：' || CASE WHEN ps IS NOT NULL THEN '图中「line001x」→「' || m || '」存在因果路径（最可能路径联合置信度 ' || printf('%.2f', ps) || '）' ELSE '图中「line001x」并非「' || m || '」的直接或间接原因' END
    || '；移除「line001x」后，「' || m || '」仍可能经其它路径发生（剩余强度 0.60）。' || chr(10) || '必要性 PN≈0.40，充分性 PS≈' || printf('%.2f', coalesce(ps, 0)) || '，必要且充分 PNS≈' || printf('%.2f', 0.4 * coalesce(ps, 0)) || '。'
    || CASE WHEN n > 2 THEN chr(10) || '连带消失的事件：' || lost || '。' ELSE '' END || chr(10) || '替代路径为：outsidex -> ' || m || '。' AS text,
  CASE WHEN ps IS NOT NULL THEN rids ELSE '' END AS evidence_chain, printf('%.4f', least(greatest(coalesce(ps, 0), 0.4), 0.99))::DOUBLE AS confidence, '' AS direction, 'L1' AS target, -1 AS n_chains, 0.4 AS pn, printf('%.4f', coalesce(ps, 0))::DOUBLE AS ps, printf('%.4f', 0.4 * coalesce(ps, 0))::DOUBLE AS pns, ids AS cascaded_ids, 'L' || n || ',X' AS alive_ids FROM md WHERE n > 1)"""
_REST = """
no AS (SELECT g, 'none' AS query_id, '未在图中定位到与问题相关的事件。' AS text, '' AS evidence_chain, 0.0 AS confidence, '' AS direction, '' AS target, -1 AS n_chains, -1.0 AS pn, -1.0 AS ps, -1.0 AS pns, '' AS cascaded_ids, '' AS alive_ids FROM gr
  UNION ALL SELECT g, 'odd', '暂不支持的问题类型：其他', '', 0, '', '', -1, -1, -1, -1, '', '' FROM gr
  UNION ALL SELECT g, q, t, '', 0, '', '', -1, -1, -1, -1, '', '' FROM gr, (VALUES ('ahead', '「line001x」在图中没有下游影响（可能是末端事件）。'), ('tree', '「line001x」在图中没有下游事件，暂无法推演后续态势。'), ('pair', '「line001x」在图中没有只依赖它的下游事件，删除它不影响其它事件。')) v(q, t) WHERE n = 1)"""

#: label, brief and the likes of pack events, in SQL
_L = "('D' || lpad(({0})::VARCHAR, 3, '0') || '（供货）')"
_D = "('D' || lpad(({0})::VARCHAR, 3, '0'))"
_FEW = f"array_to_string([{_L.format('i')} FOR i IN range(2, least(n, 3) + 1)], '、')"
_TO8 = f"array_to_string([{_L.format('i')} FOR i IN range(2, least(n, 9) + 1)], '、')"
_KNOWN = "'D001（供货）：' || m1"

_TEXT = {
    "two": "'完整因果链：D001（供货） → D002（供货）。其中，供货为起点，经逐级传导，最终导致供货。'",
    "next": f"'D001（供货）直接推动了：' || {_FEW} || '。'",
    "ahead": f"'D001（供货）直接引发：' || {_FEW} || '。主要连锁影响链：D001（供货） → D002（供货）。'",
    "cause": f"{_L.format('n')} || '的直接原因是：' || CASE WHEN n > 2 THEN {_L.format('n - 2')} || '、' ELSE '' END || {_L.format('n - 1')} || '。'",
    "lost": f"'问题未能在图中定位到明确的锚定事件，但材料记载了：' || {_KNOWN} || '。无法据此直接回答该问题，需进一步补充事件标识或更具体的材料。'",
    "fact": "'据材料，D001（供货）；' || m1 || '。'",
    "missed": "'问题所询问的具体事件在材料中未直接定位，但该包最早记载事件为D001（供货）——' || m1 || '。可能因事件命名或编号差异导致未能精确匹配。'",
    "order": "'按时间（叙事）顺序排列如下：1. D001（供货）；2. D002（供货）。排序依据为材料中事件的发生先后。'",
    "soon": f"'基于因果走势，后续将出现：' || {_TO8} || '；其中最关键的是供货——它是承上启下、推动处置走向深入的关键环节。该预测严格沿图中已有因果边推导，不引入材料外信息。'",
    "long": f"'在仅已知截至D001（供货）的条件下，基于因果走势，后续将出现：' || {_TO8} || '；其中最关键的是D002（供货）——' || replace(m2, ' ', '') || '。该预测严格沿图中已有因果边推导，不引入材料外信息。'",
    "alone": f"'结论：若D001（供货）在规定时间内被阻断，仅依赖它传导的下游事件（' || {_TO8} || '）大概率不再发生；但材料不足以断言全部绝对不会发生，存在其它起因的事件仍可能发生。'",
    "general": f"'假设关键条件未发生，仅依赖该条件传导的下游事件发生概率将显著降低。以主线起点D001（供货）为例，其直接下游包括：' || {_FEW} || '。但材料不足以断言全部后果绝对不会发生，存在其它起因的事件仍可能发生。'",
    "amount": f"'材料未提供支持精确量化的数据口径或测算依据，无法给出具体数值或精确的未来预测，只能作定性判断。现有材料可确认的相关事实为：' || m1 || '；可确认的方向性影响包括：' || {_FEW} || '。精确数值需以官方统计或专项评估为准。'",
    "absent": "'材料未记载该具体信息，无法据此给出确切答案。与该问题相关、材料中确有记载的事实是：' || m1 || '。确切内容需查阅原始记录或等待官方进一步披露。'",
    "premise": "'该问题的前提与材料记载不符，不能据此作答。材料记载的实际情况是：' || m1 || '。应以该事实为准。'",
    "sources": "'材料中不同来源对此记载不一致，在未经交叉核验前不应择一给出唯一结论，应标注冲突、存疑待查，并以官方调查认定或权威通报为准。相关记载：' || m1 || '。'",
    "unknown": "'现有材料的证据不足以支持确定性结论（缺少关键数据、原始记录或官方认定）。材料中可确认的相关情况为：' || m1 || '。在证据补齐前应存疑，以官方调查结论或正式公告为准。'",
    "missing": f"'无法精确确定。就' || {_KNOWN} || '而言，材料仅有概括性记载，未提供问题所询问的确切时间、具体数据或责任主体等关键信息，缺少相应原始台账/记录及官方调查认定结论，无法据此得出确定结论；上述概括性记载即为材料中可确认的相关事实，确切情况需以官方调查报告或正式公告为准，信息不足。'",
    "apart": "'无法建立因果关系：D001（供货）为例行安排/独立事件或背景性信息，与主线事件仅在时空或主题上邻近，材料中不存在证据支持的因果联系，应予以排除，不纳入证据链。'",
    "conflict": "'应以官方调查组经现场勘查、技术鉴定得出的认定结论为准（参见D001（供货））；事发初期未经证实的坊间说法与官方结论不一致且缺乏证据，不应采信。材料对争议事实的记载相互矛盾，在交叉核验前应标注冲突、存疑待查，不能据此得出其它唯一结论。材料中可确认的相关记载为：' || m1 || '。'",
    "turned": f"'依据现有材料可作如下审慎判断：D002（供货）：' || m2 || '；' || {_KNOWN} || '。受材料信息完整度限制，该结论置信度有限，如后续有官方调查结论或更完整记录，应以其为准。'",
}
_FROM1 = f"[['D001', {_D.format('i')}] FOR i IN range(2, least(n, {{}}) + 1)]"
_CHAINS = {
    "two": "[['D001', 'D002']]", "next": _FROM1.format(3), "ahead": f"[[{_D.format('j')} FOR j IN range(1, i + 1)] FOR i IN range(2, least(n, 7) + 1)]",
    "cause": f"CASE WHEN n > 2 THEN [[{_D.format('n - 2')}, {_D.format('n')}], [{_D.format('n - 1')}, {_D.format('n')}]] ELSE [['D001', 'D002']] END", "order": "[['D001', 'D002']]", "soon": "[['D001', 'D002']]",
    "long": f"[[{_D.format('j')} FOR j IN range(1, n + 1)]]", "alone": _FROM1.format(9), "general": f"[[{_D.format('j')} FOR j IN range(1, least(n, 3) + 1)]]", "amount": "[['D001', 'D002']]", "turned": "[['D002', 'D001']]",
}
#: (level, score, hops, confidence sent)
_NUMBERS = {
    "two": ("probable", 0.75, "1", 0.45), "next": ("probable", 0.75, "1", 0.45), "ahead": ("probable", 0.75, "1", 0.45), "cause": ("probable", 0.75, "1", 0.45), "lost": ("low", 0.25, "0", 0.41), "fact": ("certain", 0.9, "0", 0.25),
    "missed": ("possible", 0.25, "0", 0.25), "order": ("probable", 0.65, "1", 0.17), "soon": ("probable", 0.6, "1", 0.33), "long": ("probable", 0.75, "n - 1", 0.22), "alone": ("probable", 0.8, "1", 0.21),
    "general": ("possible", 0.35, "1", 0.2), "amount": ("possible", 0.38, "1", -1), "absent": ("possible", 0.38, "0", -1), "premise": ("possible", 0.4, "0", -1), "sources": ("possible", 0.4, "0", -1), "unknown": ("possible", 0.38, "0", -1),
    "missing": ("possible", 0.42, "0", 0.12), "apart": ("possible", 0.5, "0", 0.3), "conflict": ("possible", 0.42, "0", 0.09), "turned": ("possible", 0.36, "1", 0.07),
}


#: What is said of a pack of one event, which has no relations: a careful statement where the answer would be none.
_CAREFUL = f"'依据现有材料可作如下审慎判断：' || {_KNOWN} || '。受材料信息完整度限制，该结论置信度有限，如后续有官方调查结论或更完整记录，应以其为准。'"
_LONE = dict.fromkeys(("two", "next", "ahead", "cause", "order", "soon", "long", "alone", "turned"), _CAREFUL) | {
    "general": "'假设关键条件未发生，仅依赖该条件传导的下游事件发生概率将显著降低。以主线起点D001（供货）为例，其直接下游包括：（无下游事件）。但材料不足以断言全部后果绝对不会发生，存在其它起因的事件仍可能发生。'",
    "amount": "'材料未提供支持精确量化的数据口径或测算依据，无法给出具体数值或精确的未来预测，只能作定性判断。现有材料可确认的相关事实为：' || m1 || '。精确数值需以官方统计或专项评估为准。'",
}
_LONE_NUMBERS = dict.fromkeys(("two", "next", "ahead", "cause", "turned"), ("possible", 0.36, "1", 0.07)) | {
    "order": ("possible", 0.36, "1", 0.26), "soon": ("possible", 0.36, "1", 0.3), "long": ("possible", 0.36, "1", 0.3), "alone": ("possible", 0.3, "1", 0.2), "general": ("possible", 0.35, "0", 0.2), "amount": ("possible", 0.38, "0", -1),
}


def _case(values: dict[str, str], other: str | None = None) -> str:
    return "CASE k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + (f" ELSE {other}" if other else "") + " END"


def _by_size(lone: str, many: str) -> str:
    return f"CASE WHEN n = 1 THEN {lone} ELSE {many} END"


def _number(i: int, form: str) -> str:
    of = lambda values: _case({k: form.format(v[i]) for k, v in values.items()})
    return _by_size(of(_NUMBERS | _LONE_NUMBERS), of(_NUMBERS))


ORACLE = {
    "line_answers": "WITH" + ",".join([_LINES, _BACK, _AHEAD, _TREE, _WHATIF, _REST]) + """, every AS (SELECT * FROM bk UNION ALL SELECT * FROM ah UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM al UNION ALL SELECT * FROM pa UNION ALL SELECT * FROM no)
SELECT g AS graph_id, query_id, md5(text) AS text_md5, evidence_chain, confidence::DOUBLE AS confidence, direction, target, n_chains::BIGINT AS n_chains, pn::DOUBLE AS pn, ps::DOUBLE AS ps, pns::DOUBLE AS pns, cascaded_ids, alive_ids FROM every""",
    "pack_branches": f"""WITH l AS (SELECT l_orderkey::VARCHAR AS g, l_orderkey AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o, 'part ' || l_partkey AS m FROM lineitem),
p AS (SELECT g, ok, count(*) AS n, max(m) FILTER (o = 1) AS m1, max(m) FILTER (o = 2) AS m2 FROM l GROUP BY g, ok),
a(q, k, qt) AS (VALUES {', '.join(f"({i}, '{k}', '{kind}')" for i, (k, kind, _, _) in enumerate(ASKED))}),
x AS (SELECT p.*, a.* FROM p JOIN a ON a.q IN (ok % 21, (ok + 7) % 21, (ok + 14) % 21)),
y AS (SELECT *, {_by_size(_case(_LONE | {k: v for k, v in _TEXT.items() if k not in _LONE}), _case(_TEXT))} AS text, {_by_size("[['D001']]", _case(_CHAINS, "[['D001']]"))} AS ch, {_number(0, "'{}'")} AS level, {_number(1, '{}::DOUBLE')} AS score, {_number(2, '{}')} AS hops, {_number(3, '{}::DOUBLE')} AS sent FROM x)
SELECT g AS graph_id, q::BIGINT AS q_ord, md5(text) AS text_md5, array_to_string([array_to_string(c, ',') FOR c IN ch], ';') AS chains, level, score AS confidence, hops::BIGINT AS hops, md5(CASE WHEN qt = 'unanswerable' THEN '无法确定' ELSE text END) AS sent_md5, CASE WHEN qt = 'unanswerable' THEN '' ELSE array_to_string(ch[1], ',') END AS sent_chain, sent AS sent_confidence FROM y""",
}
