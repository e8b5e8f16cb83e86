"""Registered queries of the text, relation, model and evaluation operators with their full word tables, and their SQL.

Texts, types and labels are written from the rows of the events table, every one of them, with each
word of a table in its turn; what an operator must find is therefore known to SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.functions import text as tx
from eventloom.operators import analytics, extract, mapping, metrics, pack_extract, relate
from eventloom.plans import graphs
from eventloom.plans.graphs import table
from eventloom.sources import io
from eventloom.sources.storage import kept, shared_path

TRIGGERS = [w for words in lx.TRIGGERS.values() for w in words]
FINE_TYPES = [w for words in lx.FINE_TYPES.values() for w in words]
FINE_ROLES = [w for words in lx.FINE_ROLES.values() for w in words]
TYPE_WORDS = [w for _, words in lx.TYPE_RULES for w in words]
ROLE_WORDS = [w for _, words in lx.ROLE_RULES for w in words]
TOOLS = ["无人机", "铲车A3", "大数据", "卫星"]
MANNERS = ["公开", "匿名", "分期", "远程"]


def _pick(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (number % len(words) + 1).cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


# --- texts and tables ---------------------------------------------------------------------------------


def trigger_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two of all triggers in a text about each event."""
    text = F.concat(F.lit("据"), F.col("event_type"), _pick(TRIGGERS, F.col("event_id") * 7 + 3), F.lit("，"), _pick(TRIGGERS, F.col("event_id")), F.lit("了"))
    found = _events(spark, sf_dir).withColumn("t", tx.first_trigger(text))
    return found.select("event_id", F.col("t.position").cast("long").alias("position"), "t.trigger", "t.kind")


def type_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fine types, all keywords inside longer types, and unknown types, mapped."""
    n = F.col("event_id")
    value = F.when(n % 3 == 0, _pick(FINE_TYPES, n)).when(n % 3 == 1, F.concat(F.lit(" x"), _pick(TYPE_WORDS, n), F.lit("y "))).otherwise(F.col("event_type"))
    return _events(spark, sf_dir).select("event_id", mapping.event_type(value).alias("mapped"), mapping.type_covered(value).alias("covered"))


def role_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roles of each event mapped, and the value of its first subject."""
    n = F.col("event_id")
    one = F.when(n % 3 == 2, F.lit("")).otherwise(_pick(FINE_ROLES, n))
    two = F.when(n % 2 == 0, F.concat(F.lit("z"), _pick(ROLE_WORDS, n))).otherwise(F.col("event_type"))
    args = F.array(*[F.struct(mapping.role(r).alias("role"), F.concat(F.lit(name), n.cast("string")).alias("value")) for r, name in ((one, "a"), (two, "b"))])
    made = _events(spark, sf_dir).withColumn("args", args)
    return made.select("event_id", F.col("args")[0]["role"].alias("first_role"), F.col("args")[1]["role"].alias("second_role"), mapping.first_value(F.col("args"), "subject").alias("subject"))


_DRILL = ["例行消防演练", "常规防汛演习", "演练属例行安排", "无关演习", "邻近园区组织演练", "多阶段汇编稿", "综合调查报道", "真实的事故"]
_LABEL = ["事故发生", "综合汇编", "矛盾来源", "背景信息", "例行"]


def routine_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routine drills and non-causal digests among texts about events."""
    kind, mention = _pick(_LABEL, F.col("event_id")), F.concat(F.col("event_type"), _pick(_DRILL, F.col("event_id")))
    return _events(spark, sf_dir).select("event_id", relate.is_distractor(kind, mention).alias("distractor"), relate.is_noncausal(kind, mention).alias("noncausal"))


def cue_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence with one of all cues that names the event's type or its trigger, or none."""
    n = F.col("event_id")
    text = F.concat(F.lit("没有线索。"), _pick(lx.CAUSAL_CUES, n), F.lit("其他"), F.when(n % 2 == 0, F.col("event_type")).otherwise("无"), F.lit("！ "), F.lit("警方"), _pick(lx.CAUSAL_CUES, n + 5), _pick(TRIGGERS, n), F.lit("；完"))
    found = _events(spark, sf_dir).withColumn("s", relate.cue_sentence(text, F.col("event_type"), _pick(TRIGGERS, n * 2)))
    return found.select("event_id", "s")


def argument_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools and manners found in sentences about events, and the arguments made of them."""
    n = F.col("event_id")
    sentence = F.when(n % 4 == 3, F.concat(F.lit("信用"), F.col("event_type"))).otherwise(F.concat(F.lit("警方利用"), _pick(TOOLS, n), F.lit("，以"), _pick(MANNERS, F.floor(n / 4)), F.lit("方式处理了"), F.col("event_type")))
    made = _events(spark, sf_dir).withColumn("a", extract.arguments(sentence, F.lit(0), F.when(n % 2 == 0, "2024-01-02").otherwise(""), F.lit("")))
    values = [F.coalesce(mapping.first_value(F.col("a"), role), F.lit("")).alias(role) for role in ("instrument", "manner", "time")]
    return made.select("event_id", F.size("a").cast("long").alias("n_arguments"), *values)


def contract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules among events with repeated ids, unknown types and roles, wrong offsets and confidences."""
    n = F.col("event_id")
    e = _events(spark, sf_dir)
    docs = e.select(F.col("event_id").cast("string").alias("doc_id"), F.concat(F.lit("前言"), "event_type", F.lit("。")).alias("text"))
    made = e.select(
        F.when(n % 10 == 0, "E000").otherwise(n.cast("string")).alias("event_id"), n.cast("string").alias("doc_id"), F.when(n % 7 == 0, "其他").otherwise(_pick(lx.EVENT_TYPES, n)).alias("event_type"),
        F.col("event_type").alias("mention"), F.array(F.struct(F.when(n % 3 == 0, "owner").otherwise("subject").alias("role"), F.lit("x").alias("value"))).alias("arguments"),
        F.array(F.lit(2) + (n % 5 == 0).cast("int"), F.lit(2) + F.length("event_type")).alias("char_offset"), F.when(n % 11 == 0, 1.5).when(n % 13 == 0, F.lit(None)).otherwise(0.5).alias("confidence"),
    )
    return extract.contract(made, docs)


# --- model outputs and labelled rows ---------------------------------------------------------------------


def span_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest span over six token scores of each event."""
    scores = lambda a, b: F.array(*[((F.col("event_id") * a + i * b) % 101) / F.lit(101.0) for i in range(6)])
    made = _events(spark, sf_dir).withColumn("s", extract.span_of(scores(37, 11), scores(53, 29)))
    return made.select("event_id", F.coalesce("s.start", F.lit(-1)).cast("long").alias("start_at"), F.coalesce("s.end", F.lit(-1)).cast("long").alias("end_at"))


def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events decoded from a score row for the trigger and one for the time of each event."""
    e = _events(spark, sf_dir).withColumn("sentence", F.concat(F.lit("周五"), "event_type", F.lit("了")))
    role = lambda name, start, end: F.struct(F.lit(name).alias("role"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    none = F.lit(None)
    roles = F.array(role("trigger", F.when(F.col("event_id") % 9 == 0, none).otherwise(2), F.length("event_type") + 2), role("time", F.lit(0), F.lit(2)))
    scores = e.select(
        F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("doc_ord"), F.lit(5).alias("sent_start"), "sentence", _pick(lx.EVENT_TYPES, F.col("event_id")).alias("event_type"),
        ((F.col("event_id") % 97) / F.lit(97.0)).alias("type_prob"), F.explode(roles).alias("r"),
    ).select("doc_id", "doc_ord", "sent_start", "sentence", "event_type", "type_prob", "r.*")
    found = extract.decoded(scores, 0.5, 0.6)
    return found.select("event_id", "doc_id", "event_type", "trigger", "time", F.size("arguments").cast("long").alias("n_arguments"), F.col("char_offset")[1].cast("long").alias("end_pos"), "confidence")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled row for each event: a fine type, a trigger at 2, a role with its value at 0 or without a place."""
    n = F.col("event_id")
    argument = F.struct(_pick(FINE_ROLES, n).alias("role"), F.lit("周五").alias("argument"), F.when(n % 4 == 0, -1).otherwise(0).alias("argument_start_index"))
    event = F.struct(_pick(FINE_TYPES, n).alias("event_type"), F.when(n % 10 == 0, "").otherwise(F.col("event_type")).alias("trigger"), F.lit(2).alias("trigger_start_index"), F.array(argument).alias("arguments"))
    return _events(spark, sf_dir).select(n.cast("string").alias("id"), F.concat(F.lit("周五"), "event_type", n.cast("string")).alias("text"), F.array(event).alias("event_list"))


def labelled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training samples of labelled rows that were written as JSON lines, read and converted."""
    path = shared_path(spark, "labelled")
    _labelled(spark, sf_dir).write.json(path)
    samples = extract.training_samples(io.convert_labelled(io.load_labelled(spark, path)))
    return samples.select("text", "event_type", "role", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.col("label").cast("long").alias("label"))


def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted events with wrong spans, types and roles against their labelled rows, by all five measures."""
    rows, n = _labelled(spark, sf_dir), F.col("event_id")
    docs = rows.select(F.col("id").alias("doc_id"), "text")
    pred = _events(spark, sf_dir).where("event_id % 10 <> 0").select(
        n.cast("string").alias("doc_id"), F.when(n % 7 == 0, "其他").otherwise(mapping.event_type(_pick(FINE_TYPES, n))).alias("event_type"), F.col("event_type").alias("trigger"),
        F.concat(F.lit("周五"), "event_type").alias("mention"), F.array(F.when(n % 3 == 0, 1).otherwise(0), F.lit(9)).alias("char_offset"),
        F.array(F.struct(F.when(n % 11 == 0, "instrument").otherwise(mapping.role(_pick(FINE_ROLES, n))).alias("role"), F.lit("周五").alias("value"))).alias("arguments"),
    )
    found = metrics.extraction_report(metrics.gold_records(rows), metrics.pred_records(pred, docs))
    return found.select("metric", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"), "precision", "recall", "f1")


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distribution(_labelled(spark, sf_dir)).select("what", "name", "n", "covered")


# --- relations and views -------------------------------------------------------------------------------------


def stage_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose first ten events are named after the ten stages, related by the template; the others by order."""
    stages = F.try_element_at(F.array(*map(F.lit, lx.STAGES)), F.col("node_ord").cast("int"))
    nodes = kept(graphs.user_nodes(spark, sf_dir).withColumn("event_type", F.coalesce(stages, F.lit("后续"))).withColumn("mention", F.col("event_id")), "stage-nodes")
    edges = relate.relations(nodes)
    return edges.select("graph_id", "relation_id", "cause_event_id", "effect_event_id", "relation_type", "confidence", "time_lag", F.col("evidence")[0].alias("evidence"))


_SAID = {"purchase": "由于view导致交易", "error": "前文。因此click失败", "signup": "例行消防演练"}


def cued_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events related by order with cues: raised confidences, relations over three places, drills left out."""
    said = F.create_map(*[F.lit(x) for kv in _SAID.items() for x in kv])
    nodes = graphs.user_nodes(spark, sf_dir).withColumn("mention", F.coalesce(F.try_element_at(said, F.col("event_type")), F.col("event_type")))
    edges = relate.by_order(nodes)
    return edges.select("graph_id", "relation_id", "cause_event_id", "effect_event_id", "relation_type", "confidence", "time_lag", F.col("evidence")[0].alias("evidence"))


def view_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of users' graphs, those between neighbours highlighted as a chain, with the badge of their confidence."""
    nodes, edges = graphs.user_graph(spark, sf_dir)
    edges = kept(edges, "view-edges")
    _, links = analytics.view(nodes, edges, edges.where("time_lag = 'immediate'").select("graph_id", "relation_id"))
    badge = analytics.badge(F.col("confidence"))
    return links.select("graph_id", "relation_id", "source", "target", "highlighted", badge["percent"].cast("long").alias("percent"), badge["gold"].alias("gold"))


def relation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = graphs.user_graph(spark, sf_dir)
    return analytics.relation_types(edges).select("graph_id", "relation_type", F.col("count").alias("n"))


_REPORTS = {
    "view": "2024年3月5日，河南省开封市一带平静如常。", "click": "应急管理部门赶赴，救援队伍造成交通中断。", "purchase": "平平常常的一天没有别的。",
    "error": "各方说法存在出入，有待查明的情况。", "signup": "以下内容仅作背景参考，不必细看。",
}


def pack_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for each user with a report about each event: stages in their order, conflicts and background apart."""
    said = F.create_map(*[F.lit(x) for kv in _REPORTS.items() for x in kv])
    nodes = graphs.user_nodes(spark, sf_dir)
    title = F.concat(F.lit("T"), F.col("source_id").cast("string"))
    docs = kept(nodes.select("graph_id", F.format_string("D%03d", F.col("node_ord")).alias("doc_id"), F.col("node_ord").alias("doc_ord"), title.alias("title"), F.concat(title, F.lit("\n"), said[F.col("event_type")]).alias("text")), "reports")
    found = pack_extract.events(docs, spark.createDataFrame([], "graph_id string, event_id string, label string"))
    value = lambda role: F.coalesce(mapping.first_value(F.col("arguments"), role), F.lit("")).alias
    return found.select("graph_id", "event_id", "event_type", "mention", "time", "location", value("主体")("organisation"), value("影响")("impact"), F.size("arguments").cast("long").alias("n_arguments"), "confidence")


# --- files ---------------------------------------------------------------------------------------------------------


def documents_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and loaded in file order: as many places, all different, as documents."""
    path = shared_path(spark, "documents") + ".jsonl"
    d = table(spark, sf_dir, "documents")
    d.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("t").alias("title"), "text", "source", F.lit("2024-01-02").alias("publish_time"), F.create_map(F.lit("lang"), "lang").alias("metadata")).write.json(path)
    loaded = io.load_documents(spark, path)
    return loaded.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), "source", F.col("metadata")["lang"].alias("lang"))


def saved_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type graphs saved as one JSON object each, and loaded again: every edge with the types at its ends."""
    from eventloom.sources import schemas as sc

    nodes, edges = graphs.type_graph(spark, sf_dir)
    blank = lambda df, ddl: df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in sc._ddl(ddl)])
    path = shared_path(spark, "graphs")
    io.save_graphs(blank(nodes.withColumn("mention", F.upper("event_id")), sc.NODE_DDL), blank(edges, sc.EDGE_DDL), path)
    n, e = io.load_graphs(spark, path)
    side = lambda c: n.select("graph_id", F.col("event_id").alias(f"{c}_event_id"), F.col("mention").alias(c))
    joined = e.join(side("cause"), ["graph_id", "cause_event_id"]).join(side("effect"), ["graph_id", "effect_event_id"])
    return joined.select("graph_id", "relation_id", "cause", "effect", F.round("confidence", 6).alias("confidence"))


def events_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and relations written as JSON lines and loaded; each relation with its events' triggers."""
    paths = [shared_path(spark, "lines") + ".jsonl" for _ in range(2)]
    e = _events(spark, sf_dir)
    name = lambda c: F.concat(F.lit("E"), c.cast("string"))
    e.select(name(F.col("event_id")).alias("event_id"), F.col("user_id").cast("string").alias("doc_id"), "event_type", F.col("event_type").alias("trigger"), F.lit("m").alias("mention"), F.array().cast(graphs.NONE).alias("arguments"), F.array(F.lit(0), F.lit(1)).alias("char_offset"), F.lit(0.5).alias("confidence")).write.json(paths[0])
    e.select(name(F.col("event_id")).alias("cause_event_id"), name(F.col("event_id") + 1).alias("effect_event_id"), F.lit("causal").alias("relation_type"), F.array(F.lit("x")).alias("evidence"), ((F.col("event_id") % 10) / 10.0).alias("confidence")).write.json(paths[1])
    events, relations = io.load_events(spark, paths[0]), io.load_relations(spark, paths[1])
    side = lambda c: events.select(F.col("event_id").alias(f"{c}_event_id"), F.col("trigger").alias(c))
    joined = relations.join(side("cause"), "cause_event_id").join(side("effect"), "effect_event_id")
    return joined.select("graph_id", "cause_event_id", "effect_event_id", "cause", "effect", "confidence")


QUERIES = {
    f.__name__: f
    for f in (
        trigger_lexicon, type_lexicon, role_lexicon, routine_lexicon, cue_lexicon, argument_lexicon, contract_counts, span_argmax, decoded_events, labelled_samples, extraction_scores, label_distribution,
        stage_template, cued_pairs, view_links, relation_histogram, pack_extraction, documents_file, saved_graphs, events_file,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _nth(words: list[str], number: str) -> str:
    return f"{_list(words)}[({number}) % {len(words)} + 1]"


def _mapped(table_: dict, rules: list, value: str) -> str:
    """CASE branches of an exact table and of ordered keyword rules."""
    exact = " ".join(f"WHEN {value} IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in table_.items())
    by_rule = " ".join(f"WHEN regexp_matches({value}, '{'|'.join(words)}') THEN '{name}'" for name, words in rules)
    return f"{exact} {by_rule}"


_TYPE_OF = f"CASE {_mapped(lx.FINE_TYPES, lx.TYPE_RULES, 'v')} ELSE '{lx.DEFAULT_EVENT_TYPE}' END"
_VALUES = ", ".join(f"({i}, '{w}', '{kind}')" for i, (w, kind) in enumerate((w, kind) for kind, words in lx.TRIGGERS.items() for w in words))
_SPLIT = r"[x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN regexp_split_to_array(text, '[。！？；\n]')] IF length(x) >= 1]"
_NODES = "un AS (SELECT user_id::VARCHAR AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, event_type AS k FROM events)"
_FINE = f"{_nth(FINE_TYPES, 'event_id')}"


def _role_of(value: str) -> str:
    return f"CASE {_mapped(lx.FINE_ROLES, lx.ROLE_RULES, value)} WHEN {value} = '' THEN 'object' ELSE {value} END"


ORACLE: dict[str, str] = {
    "trigger_lexicon": f"""WITH d AS (SELECT event_id, '据' || event_type || {_nth(TRIGGERS, 'event_id * 7 + 3')} || '，' || {_nth(TRIGGERS, 'event_id')} || '了' AS text FROM events), l(o, w, k) AS (VALUES {_VALUES}),
h AS (SELECT event_id, w, k, instr(text, w) - 1 AS p, o FROM d, l WHERE contains(text, w))
SELECT event_id, p::BIGINT AS position, w AS trigger, k AS kind FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p, o) AS n FROM h) WHERE n = 1""",
    "type_lexicon": f"""WITH d AS (SELECT event_id, trim(CASE event_id % 3 WHEN 0 THEN {_nth(FINE_TYPES, 'event_id')} WHEN 1 THEN ' x' || {_nth(TYPE_WORDS, 'event_id')} || 'y ' ELSE event_type END) AS v FROM events)
SELECT event_id, {_TYPE_OF} AS mapped, event_id % 3 <> 2 AS covered FROM d""",
    "role_lexicon": f"""WITH d AS (SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' ELSE {_nth(FINE_ROLES, 'event_id')} END AS a, CASE WHEN event_id % 2 = 0 THEN 'z' || {_nth(ROLE_WORDS, 'event_id')} ELSE event_type END AS b FROM events),
m AS (SELECT event_id, {_role_of('a')} AS first_role, {_role_of('b')} AS second_role FROM d)
SELECT *, CASE WHEN first_role = 'subject' THEN 'a' || event_id WHEN second_role = 'subject' THEN 'b' || event_id END AS subject FROM m""",
    "routine_lexicon": f"""WITH d AS (SELECT event_id, {_nth(_LABEL, 'event_id')} AS k, event_type || {_nth(_DRILL, 'event_id')} AS m FROM events)
SELECT event_id, regexp_matches(k || m, '{lx.DISTRACTOR}') AS distractor, regexp_matches(k, '{lx.NONCAUSAL_TYPE}') OR regexp_matches(k || m, '{lx.NONCAUSAL_TEXT}') AS noncausal FROM d""",
    "cue_lexicon": f"""WITH d AS (SELECT event_id, event_type AS k, {_nth(TRIGGERS, 'event_id * 2')} AS t,
  '没有线索。' || {_nth(lx.CAUSAL_CUES, 'event_id')} || '其他' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE '无' END || '！ 警方' || {_nth(lx.CAUSAL_CUES, 'event_id + 5')} || {_nth(TRIGGERS, 'event_id')} || '；完' AS text FROM events)
SELECT event_id, [x FOR x IN {_SPLIT} IF regexp_matches(x, '{'|'.join(lx.CAUSAL_CUES)}') AND (contains(x, k) OR contains(x, t))][1] AS s FROM d""",
    "argument_lexicon": f"""SELECT event_id, (CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2 END + (event_id % 2 = 0)::INT)::BIGINT AS n_arguments, CASE WHEN event_id % 4 = 3 THEN '' ELSE {_nth(TOOLS, 'event_id')} END AS instrument,
  CASE WHEN event_id % 4 = 3 THEN '' ELSE {_nth(MANNERS, 'event_id // 4')} END AS manner, CASE WHEN event_id % 2 = 0 THEN '2024-01-02' ELSE '' END AS time FROM events""",
    "contract_counts": """SELECT greatest(count(*) FILTER (event_id % 10 = 0) - 1, 0)::BIGINT AS repeated_ids, count(*) FILTER (event_id % 7 = 0) AS unknown_types, count(*) FILTER (event_id % 3 = 0) AS unknown_roles,
  count(*) FILTER (event_id % 5 = 0) AS wrong_offsets, count(*) FILTER (event_id % 11 = 0 OR event_id % 13 = 0) AS wrong_confidences FROM events""",
    "span_argmax": """WITH d AS (SELECT event_id, [(event_id * 37 + i * 11) % 101 FOR i IN range(6)] AS a, [(event_id * 53 + i * 29) % 101 FOR i IN range(6)] AS b FROM events),
m AS (SELECT event_id, list_position(a, list_max(a)) - 1 AS s, list_position(b, list_max(b)) - 1 AS e FROM d)
SELECT event_id, CASE WHEN s > 0 AND e > 0 AND s <= e THEN s ELSE -1 END::BIGINT AS start_at, CASE WHEN s > 0 AND e > 0 AND s <= e THEN e ELSE -1 END::BIGINT AS end_at FROM m""",
    "decoded_events": f"""WITH d AS (SELECT *, (event_id % 97) / 97.0::DOUBLE AS p FROM events WHERE event_id % 9 <> 0 AND (event_id % 97) / 97.0::DOUBLE >= 0.5), k AS (SELECT * FROM d WHERE round(p, 4) >= 0.6)
SELECT printf('E%03d', row_number() OVER (ORDER BY event_id)) AS event_id, user_id::VARCHAR AS doc_id, {_nth(lx.EVENT_TYPES, 'k.event_id')} AS event_type, k.event_type AS trigger, '周五' AS time, 1::BIGINT AS n_arguments, (5 + length(k.event_type) + 3)::BIGINT AS end_pos, round(p, 4) AS confidence FROM k""",
    "labelled_samples": f"""WITH d AS (SELECT '周五' || event_type || event_id AS text, event_type AS k, event_id, {_FINE} AS v, {_nth(FINE_ROLES, 'event_id')} AS r FROM events WHERE event_id % 10 <> 0),
m AS (SELECT text, k, event_id, {_TYPE_OF} AS event_type, {_role_of('r')} AS own FROM d), s AS (SELECT *, unnest({_list(['trigger', *lx.ROLES])}) AS role FROM m),
y AS (SELECT *, CASE WHEN role = 'trigger' THEN 2 WHEN role = own AND event_id % 4 <> 0 THEN 0 END AS st, CASE WHEN role = 'trigger' THEN 2 + length(k) WHEN role = own AND event_id % 4 <> 0 THEN 2 END AS en FROM s)
SELECT text, event_type, role, coalesce(st, 0)::BIGINT AS start_at, coalesce(en, 0)::BIGINT AS end_at, (st IS NOT NULL)::BIGINT AS label FROM y""",
    "extraction_scores": f"""WITH d AS (SELECT event_id, {_FINE} AS v FROM events WHERE event_id % 10 <> 0),
m AS (SELECT event_id, {_TYPE_OF} AS t, event_id % 3 = 0 AS ws, event_id % 7 = 0 AS wt, event_id % 11 = 0 AS wr FROM d),
c AS (SELECT 'TI' AS metric, count(*) FILTER (NOT ws) AS tp, count(*) AS np, count(*) AS ng FROM m UNION ALL SELECT 'TC', count(*) FILTER (NOT ws AND NOT wt), count(*), count(*) FROM m
  UNION ALL SELECT 'AI', count(*), count(*), count(*) FROM m UNION ALL SELECT 'AC', count(*) FILTER (NOT wr), count(*), count(*) FROM m
  UNION ALL SELECT 'TC:' || x.t, coalesce(tp, 0), coalesce(np, 0), coalesce(ng, 0) FROM (SELECT DISTINCT t FROM m UNION SELECT '其他' FROM m WHERE wt) x
    LEFT JOIN (SELECT t, count(*) AS ng, count(*) FILTER (NOT ws AND NOT wt) AS tp FROM m GROUP BY t) g ON g.t = x.t LEFT JOIN (SELECT CASE WHEN wt THEN '其他' ELSE t END AS t, count(*) AS np FROM m GROUP BY ALL) p ON p.t = x.t)
SELECT metric, tp, np - tp AS fp, ng - tp AS fn, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 4) AS precision, round(CASE WHEN ng > 0 THEN tp / ng ELSE 0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * (tp / np) * (tp / ng) / (tp / np + tp / ng) ELSE 0 END, 4)::DOUBLE AS f1 FROM c""",
    "label_distribution": f"""WITH c AS (SELECT 'type' AS what, {_FINE} AS name, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'role', {_nth(FINE_ROLES, 'event_id')}, count(*) FROM events GROUP BY ALL)
SELECT what, name, n, true AS covered FROM (SELECT *, row_number() OVER (PARTITION BY what ORDER BY n DESC, encode(name)) AS r FROM c) WHERE r <= 15""",
    "stage_template": f"""WITH {_NODES}, s AS (SELECT g, o, 'E' || o AS id, coalesce({_list(lx.STAGES)}[o], '后续') AS k, count(*) OVER (PARTITION BY g) AS n FROM un),
f(no, c, e, conf) AS (VALUES {', '.join(f'({i}, {c}, {e}, {conf}::DOUBLE)' for i, (c, e, conf) in enumerate(lx.STAGE_EDGES, 1))}),
w AS (SELECT g, no, c, e, conf, true AS fixed FROM (SELECT DISTINCT g FROM s WHERE n >= 10), f UNION ALL SELECT g, o + 2, o - 1, o, {lx.DIRECT_CONFIDENCE}::DOUBLE, false FROM s WHERE n >= 10 AND o > 10),
x AS (SELECT w.g, no, a.id AS ai, b.id AS bi, conf, conf >= {lx.DIRECT_CONFIDENCE} AS near, CASE WHEN fixed THEN a.id || '（' || a.k || '） → ' || b.id || '（' || b.k || '）' ELSE a.id || ' → ' || b.id END AS ev FROM w JOIN s a ON a.g = w.g AND a.o = c JOIN s b ON b.g = w.g AND b.o = e
  UNION ALL SELECT a.g, row_number() OVER (PARTITION BY a.g ORDER BY a.o, b.o), a.id, b.id, CASE WHEN b.o = a.o + 1 THEN {lx.DIRECT_CONFIDENCE} ELSE {lx.INDIRECT_CONFIDENCE} END::DOUBLE, b.o = a.o + 1, a.id || '（' || a.k || '） → ' || b.id || '（' || b.k || '）' FROM s a JOIN s b ON a.g = b.g AND b.o BETWEEN a.o + 1 AND a.o + 2 WHERE a.n < 10)
SELECT g AS graph_id, printf('R%03d', no) AS relation_id, ai AS cause_event_id, bi AS effect_event_id, CASE WHEN near THEN '{lx.DIRECT}' ELSE '{lx.INDIRECT}' END AS relation_type, conf AS confidence, CASE WHEN near THEN 'immediate' ELSE 'delayed' END AS time_lag, ev AS evidence FROM x""",
    "cued_pairs": f"""WITH {_NODES}, p AS (SELECT a.g, a.o, b.o - a.o AS d, a.k AS ak, b.k AS bk, 'E' || a.o AS ai, 'E' || b.o AS bi,
  CASE WHEN b.k = 'purchase' AND a.k = 'view' THEN '由于view导致交易' WHEN b.k = 'error' AND a.k = 'click' THEN '因此click失败' END AS cue FROM un a JOIN un b ON a.g = b.g AND b.o BETWEEN a.o + 1 AND a.o + 3 WHERE a.k <> 'signup' AND b.k <> 'signup'),
q AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o, d) AS no FROM p WHERE d <= 2 OR contains(coalesce(cue, ''), '导致'))
SELECT g AS graph_id, printf('R%03d', no) AS relation_id, ai AS cause_event_id, bi AS effect_event_id, CASE WHEN d = 1 THEN '{lx.DIRECT}' ELSE '{lx.INDIRECT}' END AS relation_type,
  round(CASE WHEN d = 1 THEN 0.75 ELSE 0.55 END + CASE WHEN cue IS NULL THEN 0 ELSE 0.12 END, 2)::DOUBLE AS confidence, CASE WHEN d = 1 THEN 'immediate' ELSE 'delayed' END AS time_lag, coalesce(cue, ai || '（' || ak || '） → ' || bi || '（' || bk || '）') AS evidence FROM q""",
    "view_links": f"""WITH {_NODES} SELECT a.g AS graph_id, printf('R%03d', row_number() OVER (PARTITION BY a.g ORDER BY a.o, b.o)) AS relation_id, 'E' || a.o AS source, 'E' || b.o AS target, b.o = a.o + 1 AS highlighted,
  CASE WHEN b.o = a.o + 1 THEN 75 ELSE 55 END::BIGINT AS percent, b.o = a.o + 1 AS gold FROM un a JOIN un b ON a.g = b.g AND b.o BETWEEN a.o + 1 AND a.o + 2""",
    "relation_histogram": f"""WITH c AS (SELECT user_id::VARCHAR AS g, count(*) AS n FROM events GROUP BY ALL) SELECT g AS graph_id, '{lx.DIRECT}' AS relation_type, n - 1 AS n FROM c WHERE n > 1 UNION ALL SELECT g, '{lx.INDIRECT}', n - 2 FROM c WHERE n > 2""",
    "pack_extraction": f"""WITH e AS (SELECT user_id::VARCHAR AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, event_type AS k, event_id FROM events),
p AS (SELECT *, count(*) FILTER (k NOT IN ('error', 'signup')) OVER (PARTITION BY g ORDER BY o) AS place FROM e)
SELECT g AS graph_id, printf('D%03d', o) AS event_id, CASE WHEN k = 'error' THEN '矛盾来源' WHEN k = 'signup' THEN '背景信息' WHEN place <= 10 THEN {_list(lx.STAGES)}[place] WHEN k = 'click' THEN '后续事件' || (place - 10) ELSE 'T' || p.event_id END AS event_type,
  CASE k {' '.join(f"WHEN '{k}' THEN '{t[:-1]}'" for k, t in _REPORTS.items())} END AS mention, CASE WHEN k = 'view' THEN '2024年3月5日' ELSE '' END AS time, CASE WHEN k = 'view' THEN '河南省开封市' ELSE '' END AS location,
  CASE WHEN k = 'click' THEN '应急管理部门' ELSE '' END AS organisation, CASE WHEN k = 'click' THEN '{_REPORTS['click'][:-1]}' ELSE '' END AS impact, CASE WHEN k IN ('view', 'click') THEN 2 ELSE 0 END::BIGINT AS n_arguments,
  CASE WHEN k IN ('error', 'signup') THEN 0.35 ELSE 0.55 END::DOUBLE AS confidence FROM p""",
    "documents_file": "SELECT doc_id, md5(text) AS text_md5, source, lang FROM documents",
    "saved_graphs": "",  # filled by the catalog, which has the type graph's SQL
    "events_file": """SELECT 'G001' AS graph_id, 'E' || a.event_id AS cause_event_id, 'E' || b.event_id AS effect_event_id, a.event_type AS cause, b.event_type AS effect, (a.event_id % 10) / 10.0::DOUBLE AS confidence FROM events a JOIN events b ON b.event_id = a.event_id + 1""",
}
