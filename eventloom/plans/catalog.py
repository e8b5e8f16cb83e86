"""The registered queries of the causal-graph operators on the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.functions import text as tx
from eventloom.operators import analytics, anchor, calibrate, dominators, extract, graph, intervene, kbest, mapping, metrics, paths, relate, scenario
from eventloom.plans import graphs, lexical, reasoned, staged, streamed
from eventloom.plans.graphs import table
from eventloom.sources.storage import kept

#: Trigger words of the invented languages' texts, by language.
TRIGGERS = {"en": ["that", "with"], "fr": ["pour"], "es": ["por"], "de": ["auf"]}
CUES = ["ation", "ung", "mente"]
TYPE_TABLE = {"low": ["ECONOMY"], "high": ["PREMIUM"]}
TYPE_RULES = [("widget", ["widget", "ECO"]), ("ring", ["ring", "STAN"]), ("bolt", ["bolt", "PRO"])]
ROLE_TABLE = {"start": ["O"], "end": ["F"]}
ROLE_RULE = [("middle", ["P"])]
HOPS = 3
SCORES = ["multi_hop_causal", "temporal_causal", "grounded_pred", "single_hop", "counterfactual", "distractor_robustness", "conflicting_sources", "missing_information", "unanswerable", "summary"]


def six(c: str):
    return F.round(c, 6).alias(c)


def joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


# --- text -----------------------------------------------------------------------------------------


def sentence_split_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return docs.select("doc_id", F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"), F.md5("s.sentence").alias("sentence_md5"))


def simple_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("s", tx.simple_sentences(F.col("text"), 6))
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("all_md5"))


def first_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("t", tx.first_trigger(F.col("text"), TRIGGERS)).where("t IS NOT NULL")
    return docs.select("doc_id", F.col("t.position").cast("long").alias("position"), "t.trigger", "t.kind")


def extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four forms by the kind of event, found again and normalised."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    y, m, d = F.year("ts"), F.month("ts"), F.dayofmonth("ts")
    raw = (
        F.when(F.col("event_type") == "view", F.format_string("于%d年%d月%d日", y, m, d)).when(F.col("event_type") == "click", F.format_string("在%d月%d日", m, d))
        .when(F.col("event_type") == "error", F.format_string("x %d-%d-%d", y, m, d)).otherwise(F.format_string("x %d/%d/%d", y, m, d))
    )
    return e.select("event_id", tx.time_in(raw, F.lit("published 2019-05-01")).alias("time"))


def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of documents written from the events table: a document for each user."""
    e = table(spark, sf_dir, "events")
    place = F.when(F.col("event_type") == "view", "在开封市").when(F.col("event_type") == "click", "据河南省").otherwise("")
    day = F.when(F.col("event_type") == "error", "").otherwise(F.format_string("%d年%d月%d日，", F.year("ts"), F.month("ts"), F.dayofmonth("ts")))
    verb = F.when(F.col("event_type") == "signup", "宣布召开").when(F.col("event_type") == "purchase", "路过").otherwise("发生事故")
    piece = F.concat(day, place, verb, F.lit("。"))
    docs = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", piece.alias("p")))), lambda x: x["p"]), "").alias("text")).withColumn("publish_time", F.lit(""))
    found = extract.events(docs.withColumn("graph_id", F.col("doc_id")), within=["graph_id"])
    return found.select("doc_id", "event_id", "event_type", "trigger", "time", "location", F.col("char_offset")[0].cast("long").alias("start_pos"), F.size("arguments").cast("long").alias("n_arguments"), "confidence")


def map_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", mapping.event_type(F.col("p_type"), TYPE_TABLE, TYPE_RULES, "other").alias("by_type"), mapping.event_type(F.col("p_name"), TYPE_TABLE, TYPE_RULES, "other").alias("by_name"))


def map_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", mapping.role(F.col("o_orderstatus"), ROLE_TABLE, ROLE_RULE).alias("role"), mapping.role(F.regexp_replace("o_orderpriority", "^[0-9]-", ""), {"start": ["URGENT"]}, [("low", ["LOW", "SPEC"])]).alias("level"))


def id_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("t", F.concat_ws(" then ", "c_name", "c_mktsegment", "c_name", F.concat(F.lit("D"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"))))
    return c.select("c_custkey", F.array_join(tx.ids_in(F.col("t"), "Customer#", "{6,}"), ",").alias("ids"), F.array_join(tx.ids_in(F.col("t")), ",").alias("d_ids"), tx.id_number(F.col("t")).alias("number"), tx.trailing_number(F.col("c_name")).alias("trailing"))


def distractor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pattern = "(license|copyright).{0,40}(rights|software)|[a-z]+@[a-z]+"
    return d.select("doc_id", relate.is_distractor(F.col("lang"), F.col("text"), pattern).alias("distractor"))


def cue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("s", relate.cue_sentence(F.col("text"), F.lit("the"), F.lit("la"), CUES)).where("s IS NOT NULL")
    return d.select("doc_id", F.md5("s").alias("sentence_md5"))


def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(tx.gram_overlap(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand", "p_name")), 6).alias("with_all"), F.round(tx.gram_overlap(F.lower("p_type"), F.col("p_name")), 6).alias("with_type"))


# --- relations and graphs ---------------------------------------------------------------------------


def narrative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relate.relations(graphs.user_nodes(spark, sf_dir))
    return edges.select("graph_id", "relation_id", "cause_event_id", "effect_event_id", "confidence", "time_lag")


def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer merged by status: the longest priority text is the main one's."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("graph_id"), F.col("o_orderstatus").alias("event_id"), F.col("o_orderkey").alias("node_ord"), F.col("o_orderpriority").alias("mention"), F.lit("t").alias("trigger"),
        F.lit("k").alias("event_type"), F.lit("").alias("time"), F.lit("").alias("location"), F.array().cast(graphs.NONE).alias("arguments"), (F.col("o_totalprice") / 1e6).alias("confidence"),
    )
    return graph.merge_nodes(rows).select("graph_id", "event_id", "node_ord", "mention", six("confidence"))


def _edges(df: DataFrame) -> DataFrame:
    return df.select("graph_id", "edge_ord", "cause_event_id", "effect_event_id", six("confidence"))


def edge_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(graph.existing(graphs.raw_type_relations(spark, sf_dir), graphs.type_nodes(spark, sf_dir)))


def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(graph.strongest(graphs.raw_type_relations(spark, sf_dir)))


def edge_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(graph.no_weaker_reverse(graph.strongest(graphs.raw_type_relations(spark, sf_dir))))


def clean_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = graphs.type_graph(spark, sf_dir)
    return edges.select("graph_id", "relation_id", "cause_event_id", "effect_event_id", six("confidence"))


def graph_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metadata(*graphs.type_graph(spark, sf_dir)).select("graph_id", F.col("node_count").cast("long").alias("node_count"), F.col("edge_count").cast("long").alias("edge_count"))


def degrees_roots_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs.type_graph(spark, sf_dir)
    r = graph.roots(nodes, edges).select("graph_id", "event_id", F.lit(True).alias("root"))
    d = graph.degrees(nodes, edges).join(r, ["graph_id", "event_id"], "left")
    return d.select("graph_id", "event_id", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"), F.coalesce("root", F.lit(False)).alias("is_root"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analytics.statistics(*graphs.geo_graph(spark, sf_dir))
    return s.select("graph_id", "node_count", "edge_count", "n_roots", "n_leaves", "max_in", "max_out", "density")


def view_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs.user_graph(spark, sf_dir)
    drawn, _ = analytics.view(nodes, edges)
    return drawn.select("graph_id", "event_id", F.col("category").cast("long").alias("category"), F.col("degree").cast("long").alias("degree"), "symbol_size")


def pagerank_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pagerank_steps(*graphs.type_graph(spark, sf_dir), 3).select("graph_id", "event_id", six("rank"))


def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs.type_graph(spark, sf_dir)
    return analytics.most_central(analytics.pagerank(nodes, edges), nodes).select("graph_id", "event_id", "place", F.round("rank", 4).alias("rank"))


# --- paths -------------------------------------------------------------------------------------------


def _user_adjacency(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graphs.user_graph(spark, sf_dir)
    return nodes, graph.adjacency(edges)


def best_paths_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, adj = _user_adjacency(spark, sf_dir)
    return paths.best_paths(adj, HOPS).select("graph_id", "src", "dst", joined("rids"), six("p"), F.col("hops").cast("long").alias("hops"))


def cause_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest chains to every event."""
    nodes, adj = _user_adjacency(spark, sf_dir)
    ranked = paths.chains(paths.best_paths(adj, HOPS), nodes, "dst", 3)
    return ranked.select("graph_id", F.col("dst").alias("event_id"), F.col("rank").cast("long").alias("rank"), F.col("src").alias("cause"), joined("rids"), six("p"))


def effect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, adj = _user_adjacency(spark, sf_dir)
    ranked = paths.chains(paths.best_paths(adj, HOPS), nodes, "src", 3)
    return ranked.select("graph_id", F.col("src").alias("event_id"), F.col("rank").cast("long").alias("rank"), F.col("dst").alias("effect"), joined("rids"), six("p"))


def topk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, adj = _user_adjacency(spark, sf_dir)
    return paths.top_k(paths.all_paths(adj, HOPS), 2).select("graph_id", "src", "dst", F.col("rank").cast("long").alias("rank"), joined("rids"), six("p"))


def geom_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, adj = _user_adjacency(spark, sf_dir)
    return paths.top_paths(paths.all_paths(adj, HOPS)).select("graph_id", "src", "dst", F.col("rank").cast("long").alias("rank"), joined("rids"), six("score"))


def best_paths_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``best_paths_k`` of up to five edges, the depth of tracing."""
    _, adj = _user_adjacency(spark, sf_dir)
    return paths.best_paths(adj, 5).select("graph_id", "src", "dst", joined("rids"), six("p"), F.col("hops").cast("long").alias("hops"))


def topk_paths_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``topk_paths`` of up to five edges, without listing them."""
    _, adj = _user_adjacency(spark, sf_dir)
    return kbest.ranked(adj, 5, 2, ["rids", "p"]).select("graph_id", "src", "dst", F.col("rank").cast("long").alias("rank"), joined("rids"), six("p"))


def geom_paths_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``geom_paths`` of up to seven edges, the operator's own bound, without listing them."""
    _, adj = _user_adjacency(spark, sf_dir)
    return kbest.ranked(adj, 7, 6, ["rids", "score"], mean=True, cap=300).select("graph_id", "src", "dst", F.col("rank").cast("long").alias("rank"), joined("rids"), six("score"))


def root_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from root events to customers of their nation."""
    nodes, edges = graphs.geo_graph(spark, sf_dir)
    roots = graph.roots(nodes, edges)
    adj = graph.adjacency(edges)
    found = paths.root_chains(paths.all_paths(adj, HOPS, roots, between=paths.inner(adj)), roots)
    return found.select("graph_id", "dst", F.col("rank").cast("long").alias("rank"), joined("path"), six("score"))


def noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that any supplier or region reaches a customer."""
    nodes, edges = graphs.geo_graph(spark, sf_dir)
    roots = graph.roots(nodes, edges)
    adj = graph.adjacency(edges)
    return paths.noisy_or(paths.best_probability(adj, 2, roots, paths.inner(adj))).select("graph_id", F.col("dst").alias("event_id"), six("p"))


def path_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every four consecutive events of each user as a path, numbered by its first event's place; fewer if the user has no four."""
    nodes, adj = _user_adjacency(spark, sf_dir)
    starts = nodes.select("graph_id", "node_ord", "event_id", F.explode(F.sequence(F.greatest(F.col("node_ord") - 3, F.lit(1)), F.col("node_ord"))).alias("path_id"))
    path = starts.groupBy("graph_id", "path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "event_id"))), lambda x: x["event_id"]).alias("path")).where("size(path) = 4 OR path_id = 1")
    return paths.path_probability(path, adj).select("graph_id", "path_id", joined("path"), six("p"))


# --- interventions and scenarios -------------------------------------------------------------------------


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dies with each node of every type graph."""
    nodes, edges = graphs.type_graph(spark, sf_dir)
    causes = nodes.select("graph_id", F.col("event_id").alias("cause"))
    return intervene.dead(nodes, causes, intervene.alive(nodes, edges, causes)).select("graph_id", "cause", "event_id")


def _kept_geo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graphs.geo_graph(spark, sf_dir)
    return kept(nodes.select("graph_id", "event_id", "node_ord"), "geo-nodes"), edges  # edges are written lines already


def cascade_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events die with each region, nation, supplier and customer of each nation's graph, and the first of them."""
    nodes, edges = _kept_geo(spark, sf_dir)
    return dominators.sizes(nodes, dominators.dominators(nodes, edges))


def necessity_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PN, PS and PNS of every edge: of regions for nations, nations and suppliers for customers."""
    found = intervene.edge_measures(*_kept_geo(spark, sf_dir), 3)
    return found.select("graph_id", "cause", "effect", six("pn"), six("ps"), six("pns"), "effect_dead", "alt_root")


def forward_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event type leads to in the end, itself included."""
    nodes, edges = graphs.type_graph(spark, sf_dir)
    start = nodes.select("graph_id", F.col("event_id").alias("source"), "event_id")
    return intervene.reached(start, edges, ["graph_id", "source"])


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs.type_graph(spark, sf_dir)
    return scenario.tree(graph.adjacency(edges), nodes, HOPS)


def scenario_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir).select("graph_id", "source", joined("path"), F.col("depth").cast("long").alias("depth"), six("p"))


def likely_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.likeliest_end(_trees(spark, sf_dir)).select("graph_id", "source", "node", six("prob"))


def anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each event, anchored in the types of its user's events."""
    nodes = graphs.type_nodes(spark, sf_dir).select("graph_id", "event_id", "node_ord", F.col("event_id").alias("trigger"), F.concat(F.lit("the "), F.col("event_id"), F.lit(" flood")).alias("mention"), F.lit("k").alias("event_type"))
    e = table(spark, sf_dir, "events")
    words = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("what about "), "event_type", F.lit("?"))).otherwise(F.concat(F.lit("the flo "), F.left("event_type", F.lit(3)), F.lit(" "), F.col("event_id").cast("string")))
    asked = e.select(F.col("user_id").cast("string").alias("graph_id"), F.col("event_id").alias("query_id"), words.alias("question"))
    return anchor.mentioned(nodes, asked, 3).select("graph_id", "query_id", "event_id", F.col("place").cast("long").alias("place"))


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each event, anchored among all events of its user; every third names one that isn't there."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("graph_id"), "event_id", "event_type")
    nodes = e.select("graph_id", F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("node_ord"), F.lit("").alias("trigger"), F.concat_ws(" ", "event_type", "event_id").alias("mention"), F.lit("").alias("event_type"))
    words = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_id", F.lit("y "), F.left("event_type", F.lit(4)), F.lit("?"))).otherwise(F.concat(F.lit("why "), "event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit("?")))
    found = anchor.mentioned(nodes, e.select("graph_id", F.col("event_id").alias("query_id"), words.alias("question")), 4)
    return found.select("graph_id", "query_id", "event_id", F.col("place").cast("long").alias("place"))


def causal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracing, deduction and counterfactual questions about each nation, answered in text."""
    from eventloom.operators import answer

    nodes, edges = graphs.geo_graph(spark, sf_dir)
    edges = kept(edges.withColumn("evidence", F.array().cast("array<string>")), "geo-edges")
    nodes = kept(nodes.withColumns({"trigger": F.col("mention"), "event_type": F.lit("")}), "geo-nodes")
    n = table(spark, sf_dir, "nation")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("question_type"), F.lit(q).alias("q")) for k, q in zip(answer.KINDS, ("会怎样：", "后续：", "假如没有："), strict=True)])).alias("k")
    asked = n.select(F.col("n_nationkey").cast("string").alias("graph_id"), "n_name", kinds).select("graph_id", F.col("k.question_type").alias("query_id"), F.concat("k.q", "n_name").alias("question"), "k.question_type")
    found = answer.answers(nodes, edges, asked, 2, 1, 2)
    return found.select("graph_id", "query_id", "answer_text", F.array_join("evidence_chain", ",").alias("evidence_chain"), six("confidence"))


def pack_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions about every order, answered and made ready for submission."""
    from eventloom.operators import pack_answer

    g = graphs.order_packs(spark, sf_dir)
    records = pack_answer.records(g["nodes"], g["edges"], g["questions"])
    submitted = pack_answer.submission(records).select("graph_id", "q_ord", F.col("confidence").alias("submitted"))
    return records.join(submitted, ["graph_id", "q_ord"]).select(
        "graph_id", "q_ord", six("confidence"), "confidence_level", F.size("evidence_chains").cast("long").alias("n_chains"), F.array_join(F.col("evidence_chains")[0], ",").alias("first_chain"), "submitted"
    )


# --- calibration and metrics ----------------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question type for each order by its priority's and status's rank, and a score by its price."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, SCORES)), (F.length("o_orderpriority") % 10 + 1).cast("int"))
    return o.select("o_orderkey", kind.alias("rtype"), (F.floor(F.col("o_totalprice") / 5000) / 100).alias("score"))


def level_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("o_orderkey", calibrate.level(F.col("score")).alias("plain"), calibrate.level_for(F.col("rtype"), F.col("score")).alias("level"))


def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's confidence; its SQL rounds binary ties by their exact decimal digits, as the operator does."""
    return _scored(spark, sf_dir).select("o_orderkey", calibrate.confidence(F.col("rtype"), F.col("score")).alias("confidence"))


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    gold = labels.select("doc_id", F.col("quality").alias("kind"))
    pred = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.when((F.col("n_chars") > 300) & ~F.col("text").rlike("[#%]"), 1).otherwise(0).alias("kind"))
    return gold, pred


def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = _keyed(spark, sf_dir)
    return metrics.micro(gold, pred, ["doc_id", "kind"], ["kind"]).select("kind", "tp", "fp", "fn", "precision", "recall", "f1")


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text against that of the document with the next id, or against none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("gold"))
    return docs.join(after, "doc_id", "left").select("doc_id", F.round(metrics.token_f1(F.col("text"), F.col("gold")), 6).alias("f1"), metrics.exact_match(F.col("text"), F.col("gold")).alias("same"))


def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as gold for the assistant turn that follows it; a user turn without one counts as unmatched."""
    after = F.lead(F.struct("role", "text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("after", after).where("role = 'user'").withColumn("query_id", F.struct("conv_id", "turn"))
    replies = turns.where("after.role = 'assistant'").select("query_id", F.col("after.text").alias("answer_text"))
    return metrics.answer_report(replies, turns.select("query_id", F.col("text").alias("answer_text"))).select("total", "exact_match", six("em"), six("avg_f1"))


#: Names that these queries had while others of the first names read a part of their tables.
SAME = {f"{f.__name__}_all": f for f in (path_probability, cascade_geo, necessity_sufficiency, confidence_calibration, answer_report)}
QUERIES = {
    f.__name__: f
    for f in (
        sentence_split_offsets, simple_sentences, first_trigger, extract_dates, rule_extraction, map_types, map_roles, id_extract, distractor_filter, cue_evidence, ngram_overlap,
        narrative_pairs, node_merge, edge_dangling, edge_dedup, edge_conflict, clean_graph, graph_metadata, degrees_roots_leaves, graph_stats, view_nodes, pagerank_k, pagerank_converged,
        best_paths_k, cause_chains, effect_chains, topk_paths, geom_paths, best_paths_5, topk_paths_5, geom_paths_7, root_chains, noisy_or, path_probability,
        cascade, cascade_geo, necessity_sufficiency, forward_closure, scenario_tree, likely_terminal, anchor_match, event_mentions, causal_answers, pack_answers,
        level_calibration, confidence_calibration, micro_prf, token_f1, answer_report,
    )
} | SAME | lexical.QUERIES | reasoned.QUERIES | staged.QUERIES | streamed.QUERIES
FLAGSHIP = "cause_chains"

# --- SQL ---------------------------------------------------------------------------------------------------

def _user(hops: int) -> str:
    return f"""
un AS (SELECT user_id::VARCHAR AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, event_type AS k FROM events),
ue AS (SELECT a.g, 'E' || a.o AS s, 'E' || b.o AS t, a.o AS so, b.o AS t_o, CASE WHEN b.o = a.o + 1 THEN 0.75 ELSE 0.55 END AS c, b.o - a.o AS ord,
  printf('R%03d', row_number() OVER (PARTITION BY a.g ORDER BY a.o, b.o)) AS rid FROM un a JOIN un b ON a.g = b.g AND b.o BETWEEN a.o + 1 AND a.o + 2),
up AS (SELECT g, s, t, [s, t] AS path, [rid] AS rids, [ord] AS ords, c::DOUBLE AS p, 1 AS hops FROM ue
  UNION ALL SELECT up.g, up.s, ue.t, list_append(path, ue.t), list_append(rids, rid), list_append(ords, ord), p * c, hops + 1 FROM up JOIN ue ON up.g = ue.g AND up.t = ue.s WHERE hops < {hops} AND NOT list_contains(path, ue.t)),
ub AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, s, t ORDER BY p DESC, ords) AS n FROM up) WHERE n = 1)"""


_USER = _user(HOPS)
_TYPE = """
rr AS (SELECT user_id::VARCHAR AS g, row_number() OVER w AS o, event_type AS s, lead(event_type) OVER w AS t, abs(value) - floor(abs(value)) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT * FROM rr WHERE t IS NOT NULL),
tn AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY k) AS o FROM (SELECT DISTINCT user_id::VARCHAR AS g, event_type AS k FROM events WHERE event_type <> 'error')),
st AS (SELECT g, s, t, min(o) AS o, max(c) AS c FROM r WHERE s <> t GROUP BY g, s, t),
ex AS (SELECT r.* FROM r SEMI JOIN tn a ON a.g = r.g AND a.k = r.s SEMI JOIN tn b ON b.g = r.g AND b.k = r.t),
cs AS (SELECT g, s, t, min(o) AS o, max(c) AS c FROM ex WHERE s <> t GROUP BY g, s, t),
ce AS (SELECT a.*, row_number() OVER (PARTITION BY a.g ORDER BY a.o) AS n, row_number() OVER (PARTITION BY a.g, a.s ORDER BY a.o) AS ord FROM cs a LEFT JOIN cs b ON a.g = b.g AND a.s = b.t AND a.t = b.s WHERE b.c IS NULL OR a.c >= b.c)"""
_GEO = """
bo AS (SELECT l_suppkey AS sk, o_custkey AS ck, max(l_discount) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
bc AS (SELECT sk, ck, d, c_nationkey::VARCHAR AS g FROM bo JOIN customer ON ck = c_custkey),
gn AS (SELECT n_nationkey::VARCHAR AS g, 'R' || n_regionkey AS k, 0 AS o FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'N' || n_nationkey, 1 FROM nation
  UNION ALL SELECT DISTINCT g, 'S' || sk, sk + 2 FROM bc UNION ALL SELECT c_nationkey::VARCHAR, 'C' || c_custkey, c_custkey + 10000000000 FROM customer),
ge AS (SELECT n_nationkey::VARCHAR AS g, 'R' || n_regionkey AS s, 'N' || n_nationkey AS t, 0.9::DOUBLE AS c FROM nation
  UNION ALL SELECT c_nationkey::VARCHAR, 'N' || c_nationkey, 'C' || c_custkey, abs(c_acctbal) / 10000 FROM customer
  UNION ALL SELECT g, 'S' || sk, 'C' || ck, d * 10 FROM bc),
gr AS (SELECT g, k, o FROM gn ANTI JOIN ge ON gn.g = ge.g AND gn.k = ge.t)"""
_KIND = f"CASE length(o_orderpriority) % 10 {' '.join(f'WHEN {i} THEN {k!r}' for i, k in enumerate(SCORES))} END"
_DAY = "strftime(ts, '%Y-%m-%d')"


def _ranked_chains(own: str, other: str, order: str, name: str) -> str:
    return f"""WITH RECURSIVE {_USER} SELECT g AS graph_id, {own} AS event_id, n2 AS rank, {other} AS {name}, array_to_string(rids, ',') AS rids, round(p, 6) AS p
FROM (SELECT *, row_number() OVER (PARTITION BY g, {own} ORDER BY p DESC, hops, {order}) AS n2 FROM ub) WHERE n2 <= 3"""


_TREE = f"""WITH RECURSIVE {_TYPE}, tr AS (SELECT g, k AS src, k AS node, [k] AS path, [0]::BIGINT[] AS ords, 0 AS depth, 1.0::DOUBLE AS p FROM tn
  UNION ALL SELECT tr.g, src, ce.t, list_append(path, ce.t), list_append(ords, ce.ord), depth + 1, p * c FROM tr JOIN ce ON tr.g = ce.g AND tr.node = ce.s WHERE depth < 3),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, src ORDER BY ords) AS n FROM tr) WHERE n <= 500)"""

ORACLE: dict[str, str] = {
    "sentence_split_offsets": """WITH p AS (SELECT doc_id, regexp_split_to_array(text, '[。！？；!?;\\n]') AS ps FROM documents),
u AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS s FROM p),
w AS (SELECT doc_id, s, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM u)
SELECT doc_id, st AS start_pos, st + length(s) AS end_pos, md5(s) AS sentence_md5 FROM w WHERE length(s) > 0""",
    "simple_sentences": r"""WITH p AS (SELECT doc_id, [x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN regexp_split_to_array(text, '[。！？；\n]')] IF length(x) >= 6] AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS all_md5 FROM p""",
    "first_trigger": """WITH l(o, w, k) AS (VALUES (1, 'that', 'en'), (2, 'with', 'en'), (3, 'pour', 'fr'), (4, 'por', 'es'), (5, 'auf', 'de')),
h AS (SELECT doc_id, o, w, k, instr(text, w) - 1 AS p FROM documents, l WHERE contains(text, w))
SELECT doc_id, p::BIGINT AS position, w AS trigger, k AS kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, o) AS n FROM h) WHERE n = 1""",
    "extract_dates": f"""SELECT event_id, CASE event_type WHEN 'view' THEN {_DAY} WHEN 'click' THEN '2019-' || strftime(ts, '%m-%d')
  WHEN 'error' THEN year(ts) || '-' || month(ts) || '-' || day(ts) ELSE year(ts) || '/' || month(ts) || '/' || day(ts) END AS time FROM events""",
    "rule_extraction": f"""WITH e AS (SELECT user_id, event_type AS k, ts, event_id,
  CASE WHEN event_type = 'error' THEN '' ELSE year(ts) || '年' || month(ts) || '月' || day(ts) || '日，' END || CASE event_type WHEN 'view' THEN '在开封市' WHEN 'click' THEN '据河南省' ELSE '' END
  || CASE event_type WHEN 'signup' THEN '宣布召开' WHEN 'purchase' THEN '路过' ELSE '发生事故' END AS s FROM events),
p AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM e)
SELECT user_id AS doc_id, printf('E%03d', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS event_id, CASE WHEN k = 'signup' THEN '政策/发布' ELSE '灾害/事故' END AS event_type,
  CASE WHEN k = 'signup' THEN '宣布' ELSE '发生' END AS trigger, CASE WHEN k = 'error' THEN '' ELSE {_DAY} END AS time, CASE k WHEN 'view' THEN '开封市' WHEN 'click' THEN '河南省' ELSE '' END AS location, st AS start_pos,
  ((k <> 'error')::INT + (k IN ('view', 'click'))::INT)::BIGINT AS n_arguments, CASE WHEN k = 'error' THEN 0.7 WHEN k IN ('view', 'click') THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence
FROM p WHERE k <> 'purchase'""",
    "map_types": """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'low' WHEN p_type = 'PREMIUM' THEN 'high' WHEN regexp_matches(p_type, 'widget|ECO') THEN 'widget' WHEN regexp_matches(p_type, 'ring|STAN') THEN 'ring' WHEN regexp_matches(p_type, 'bolt|PRO') THEN 'bolt' ELSE 'other' END AS by_type,
  CASE WHEN p_name = 'ECONOMY' THEN 'low' WHEN p_name = 'PREMIUM' THEN 'high' WHEN regexp_matches(p_name, 'widget|ECO') THEN 'widget' WHEN regexp_matches(p_name, 'ring|STAN') THEN 'ring' WHEN regexp_matches(p_name, 'bolt|PRO') THEN 'bolt' ELSE 'other' END AS by_name FROM part""",
    "map_roles": """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'start' WHEN 'F' THEN 'end' WHEN 'P' THEN 'middle' WHEN '' THEN 'object' ELSE o_orderstatus END AS role,
  CASE WHEN substr(o_orderpriority, 3) = 'URGENT' THEN 'start' WHEN regexp_matches(o_orderpriority, 'LOW|SPEC') THEN 'low' ELSE substr(o_orderpriority, 3) END AS level FROM orders""",
    "id_extract": """SELECT c_custkey, c_name AS ids, 'D' || lpad((c_custkey)::VARCHAR, 4, '0')[1:4] AS d_ids, lpad((c_custkey)::VARCHAR, 4, '0')[1:4]::BIGINT AS number, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS trailing FROM customer""",
    "distractor_filter": """SELECT doc_id, regexp_matches(lang || text, '(license|copyright).{0,40}(rights|software)|[a-z]+@[a-z]+') AS distractor FROM documents""",
    "cue_evidence": r"""WITH p AS (SELECT doc_id, [x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN regexp_split_to_array(text, '[。！？；\n]')] IF regexp_matches(x, 'ation|ung|mente') AND (contains(x, 'the') OR contains(x, 'la'))] AS s FROM documents)
SELECT doc_id, md5(s[1]) AS sentence_md5 FROM p WHERE len(s) > 0""",
    "ngram_overlap": """WITH x AS (SELECT p_partkey, p_name AS a, p_type || ' ' || p_brand || ' ' || p_name AS b, lower(p_type) AS c FROM part),
g AS (SELECT p_partkey, list_distinct([a[i:i + 1] FOR i IN range(1, length(a))]) AS ga, list_distinct([b[i:i + 1] FOR i IN range(1, length(b))]) AS gb, list_distinct([c[i:i + 1] FOR i IN range(1, length(c))]) AS gc, length(c) <= length(a) AS first FROM x)
SELECT p_partkey, round(len(list_intersect(ga, gb)) / len(ga), 6) AS with_all, round(len(list_intersect(gc, ga)) / CASE WHEN first THEN len(gc) ELSE len(ga) END, 6) AS with_type FROM g""",
    "narrative_pairs": f"""WITH RECURSIVE {_USER} SELECT g AS graph_id, rid AS relation_id, s AS cause_event_id, t AS effect_event_id, c::DOUBLE AS confidence, CASE WHEN ord = 1 THEN 'immediate' ELSE 'delayed' END AS time_lag FROM ue""",
    "node_merge": """SELECT o_custkey::VARCHAR AS graph_id, o_orderstatus AS event_id, min(o_orderkey) AS node_ord, arg_max(o_orderpriority, length(o_orderpriority) * 10000000000000 - o_orderkey) AS mention, round(max(o_totalprice / 1e6), 6) AS confidence FROM orders GROUP BY ALL""",
    "edge_dangling": f"WITH {_TYPE} SELECT g AS graph_id, o AS edge_ord, s AS cause_event_id, t AS effect_event_id, round(c, 6) AS confidence FROM ex",
    "edge_dedup": f"WITH {_TYPE} SELECT g AS graph_id, o AS edge_ord, s AS cause_event_id, t AS effect_event_id, round(c, 6) AS confidence FROM st",
    "edge_conflict": f"WITH {_TYPE} SELECT a.g AS graph_id, a.o AS edge_ord, a.s AS cause_event_id, a.t AS effect_event_id, round(a.c, 6) AS confidence FROM st a LEFT JOIN st b ON a.g = b.g AND a.s = b.t AND a.t = b.s WHERE b.c IS NULL OR a.c >= b.c",
    "clean_graph": f"WITH {_TYPE} SELECT g AS graph_id, printf('R%03d', n) AS relation_id, s AS cause_event_id, t AS effect_event_id, round(c, 6) AS confidence FROM ce",
    "graph_metadata": f"WITH {_TYPE} SELECT g AS graph_id, count(*) AS node_count, coalesce(max(e), 0)::BIGINT AS edge_count FROM tn LEFT JOIN (SELECT g, count(*) AS e FROM ce GROUP BY g) USING (g) GROUP BY g",
    "degrees_roots_leaves": f"""WITH {_TYPE} SELECT g AS graph_id, k AS event_id, (SELECT count(*) FROM ce WHERE ce.g = tn.g AND ce.t = tn.k) AS in_degree, (SELECT count(*) FROM ce WHERE ce.g = tn.g AND ce.s = tn.k) AS out_degree,
  NOT EXISTS (SELECT 1 FROM ce WHERE ce.g = tn.g AND ce.t = tn.k) AS is_root FROM tn""",
    "graph_stats": f"""WITH {_GEO}, i AS (SELECT g, t AS k, count(*) AS n FROM ge GROUP BY ALL), o AS (SELECT g, s AS k, count(*) AS n FROM ge GROUP BY ALL),
d AS (SELECT gn.g, gn.k, coalesce(i.n, 0) AS i, coalesce(o.n, 0) AS o FROM gn LEFT JOIN i ON gn.g = i.g AND gn.k = i.k LEFT JOIN o ON gn.g = o.g AND gn.k = o.k)
SELECT g AS graph_id, count(*) AS node_count, sum(o)::BIGINT AS edge_count, count(*) FILTER (i = 0) AS n_roots, count(*) FILTER (o = 0) AS n_leaves, max(i)::BIGINT AS max_in, max(o)::BIGINT AS max_out, round(sum(o) / (count(*) * (count(*) - 1)), 4) AS density FROM d GROUP BY g""",
    "view_nodes": f"""WITH RECURSIVE {_USER}, d AS (SELECT g, k, sum(n) AS d FROM (SELECT g, s AS k, count(*) AS n FROM ue GROUP BY ALL UNION ALL SELECT g, t, count(*) FROM ue GROUP BY ALL) GROUP BY ALL),
x AS (SELECT un.g, 'E' || o AS id, dense_rank() OVER (PARTITION BY un.g ORDER BY un.k) - 1 AS cat, coalesce(d, 0) AS d FROM un LEFT JOIN d ON un.g = d.g AND d.k = 'E' || o)
SELECT g AS graph_id, id AS event_id, cat AS category, d::BIGINT AS degree, round(26 + 22 * d / greatest(max(d) OVER (PARTITION BY g), 1), 1)::DOUBLE AS symbol_size FROM x""",
    "pagerank_k": f"""WITH {_TYPE}, w AS (SELECT g, s, t, c / sum(c) OVER (PARTITION BY g, s) AS w FROM ce WHERE c > 0), n AS (SELECT g, k, count(*) OVER (PARTITION BY g) AS n FROM tn),
r0 AS (SELECT g, k, n, 1.0 / n AS r FROM n),"""
    + ",".join(
        f"""
f{i} AS (SELECT r.g, w.t AS k, sum(r.r * w.w) AS x FROM r{i - 1} r JOIN w ON r.g = w.g AND r.k = w.s GROUP BY ALL),
r{i} AS (SELECT r.g, r.k, n, 0.85 * (coalesce(x, 0) + (sum(r) OVER (PARTITION BY r.g) - sum(coalesce(x, 0)) OVER (PARTITION BY r.g)) / n) + 0.15 / n AS r FROM r{i - 1} r LEFT JOIN f{i} f ON r.g = f.g AND r.k = f.k)"""
        for i in (1, 2, 3)
    )
    + " SELECT g AS graph_id, k AS event_id, round(r, 6)::DOUBLE AS rank FROM r3",
    "pagerank_converged": f"""WITH RECURSIVE {_TYPE}, n AS (SELECT g, list(k ORDER BY o) AS ks, count(*) AS n FROM tn GROUP BY g),
w AS (SELECT g, s, t, c / sum(c) OVER (PARTITION BY g, s) AS w FROM ce WHERE c > 0),
l AS (SELECT w.g, list({{'s': list_position(ks, s), 't': list_position(ks, t), 'w': w}} ORDER BY s, t) AS es FROM w JOIN n ON w.g = n.g GROUP BY w.g),
p AS (SELECT n.g, ks, n, coalesce(es, []) AS es, [i FOR i IN range(1, n + 1) IF NOT list_contains([e.s FOR e IN coalesce(es, [])], i)] AS ends FROM n LEFT JOIN l ON n.g = l.g),
pr AS (SELECT g, 0 AS step, [1.0::DOUBLE / n FOR i IN range(1, n + 1)] AS x, 1e9::DOUBLE AS moved FROM p
  UNION ALL SELECT g, step + 1, y, list_sum([abs(y[i] - x[i]) FOR i IN range(1, n + 1)])
  FROM (SELECT pr.g, step, x, p.n, [0.85 * (coalesce(list_sum([x[e.s] * e.w FOR e IN es IF e.t = i]), 0) + coalesce(list_sum([x[j] FOR j IN ends]), 0) / p.n) + 0.15 / p.n FOR i IN range(1, p.n + 1)] AS y FROM pr JOIN p ON pr.g = p.g WHERE step < 100 AND moved >= p.n * 1e-6)),
f AS (SELECT g, arg_max(x, step) AS x FROM pr GROUP BY g), q AS (SELECT f.g, unnest(ks) AS k, unnest(x) AS v, unnest(range(1, n + 1)) AS o FROM f JOIN p ON f.g = p.g)
SELECT g AS graph_id, k AS event_id, row_number() OVER (PARTITION BY g ORDER BY v DESC, o) AS place, round(v, 4) AS rank FROM q QUALIFY place <= 3""",
    "best_paths_k": f"WITH RECURSIVE {_USER} SELECT g AS graph_id, s AS src, t AS dst, array_to_string(rids, ',') AS rids, round(p, 6) AS p, hops::BIGINT AS hops FROM ub",
    "cause_chains": _ranked_chains("t", "s", "substr(s, 2)::BIGINT", "cause"),
    "effect_chains": _ranked_chains("s", "t", "substr(t, 2)::BIGINT", "effect"),
    "topk_paths": f"WITH RECURSIVE {_USER} SELECT g AS graph_id, s AS src, t AS dst, n AS rank, array_to_string(rids, ',') AS rids, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY g, s, t ORDER BY p DESC, ords) AS n FROM up) WHERE n <= 2",
    "geom_paths": f"WITH RECURSIVE {_USER} SELECT g AS graph_id, s AS src, t AS dst, n AS rank, array_to_string(rids, ',') AS rids, round(sc, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY g, s, t ORDER BY sc DESC, hops, ords) AS n FROM (SELECT *, pow(p, 1.0 / hops) AS sc FROM up)) WHERE n <= 6",
    "root_chains": f"""WITH {_GEO}, p AS (SELECT ge.g, s, t, o, s || ',' || t AS path, c AS sc, 1 AS hops FROM ge JOIN gr ON ge.g = gr.g AND ge.s = gr.k
  UNION ALL SELECT a.g, a.s, b.t, o, a.s || ',' || a.t || ',' || b.t, pow(a.c * b.c, 0.5), 2 FROM ge a JOIN ge b ON a.g = b.g AND a.t = b.s JOIN gr ON a.g = gr.g AND a.s = gr.k)
SELECT g AS graph_id, t AS dst, n AS rank, path, round(sc, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY g, t ORDER BY sc DESC, hops DESC, o) AS n FROM p) WHERE n <= 6""",
    "noisy_or": f"""WITH {_GEO}, p AS (SELECT ge.g, s, t, c AS p FROM ge JOIN gr ON ge.g = gr.g AND ge.s = gr.k UNION ALL SELECT a.g, a.s, b.t, a.c * b.c FROM ge a JOIN ge b ON a.g = b.g AND a.t = b.s JOIN gr ON a.g = gr.g AND a.s = gr.k)
SELECT g AS graph_id, t AS event_id, round(1 - product(1 - p), 6) AS p FROM (SELECT g, s, t, max(p) AS p FROM p GROUP BY ALL) GROUP BY g, t""",
    "path_probability": f"""WITH RECURSIVE {_USER}, w AS (SELECT g, o AS i, count(*) OVER v AS n, string_agg('E' || o, ',') OVER v AS path FROM un WINDOW v AS (PARTITION BY g ORDER BY o ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT g AS graph_id, i AS path_id, path, round(pow(0.75, n - 1), 6)::DOUBLE AS p FROM w WHERE n = 4 OR i = 1""",
    "cascade": f"""WITH RECURSIVE {_TYPE}, ro AS (SELECT g, k FROM tn ANTI JOIN ce ON tn.g = ce.g AND tn.k = ce.t),
al AS (SELECT a.g, a.k AS c, b.k FROM tn a JOIN ro b ON a.g = b.g AND a.k <> b.k UNION SELECT al.g, al.c, ce.t FROM al JOIN ce ON al.g = ce.g AND al.k = ce.s WHERE ce.t <> al.c)
SELECT a.g AS graph_id, a.k AS cause, b.k AS event_id FROM tn a JOIN tn b ON a.g = b.g ANTI JOIN al ON al.g = a.g AND al.c = a.k AND al.k = b.k""",
    "cascade_geo": f"""WITH RECURSIVE {_GEO}, al AS (SELECT a.g, a.k AS c, b.k FROM gn a JOIN gr b ON a.g = b.g AND a.k <> b.k UNION SELECT al.g, al.c, ge.t FROM al JOIN ge ON al.g = ge.g AND al.k = ge.s WHERE ge.t <> al.c)
SELECT a.g AS graph_id, a.k AS cause, count(*) AS n_dead, min(b.k) AS first_dead FROM gn a JOIN gn b ON a.g = b.g ANTI JOIN al ON al.g = a.g AND al.c = a.k AND al.k = b.k GROUP BY ALL""",
    "necessity_sufficiency": f"""WITH {_GEO}, ch AS (SELECT ge.g, ge.t, ge.s AS root, NULL AS via, ge.c AS p, r.o FROM ge JOIN gr r ON r.g = ge.g AND r.k = ge.s
  UNION ALL SELECT b.g, b.t, a.s, a.t, a.c * b.c, r.o FROM ge a JOIN ge b ON a.g = b.g AND a.t = b.s JOIN gr r ON r.g = a.g AND r.k = a.s),
rk AS (SELECT e.g, e.s, e.t, e.c AS ps, ch.root, ch.p AS d, row_number() OVER (PARTITION BY e.g, e.s, e.t ORDER BY ch.p DESC, ch.o) AS n FROM ge e LEFT JOIN ch ON ch.g = e.g AND ch.t = e.t AND ch.root <> e.s AND (ch.via IS NULL OR ch.via <> e.s))
SELECT g AS graph_id, s AS cause, t AS effect, round(1 - coalesce(d, 0), 6) AS pn, round(ps, 6) AS ps, round(round(1 - coalesce(d, 0), 6) * ps, 6) AS pns, d IS NULL AS effect_dead, root AS alt_root FROM rk WHERE n = 1""",
    "forward_closure": f"WITH RECURSIVE {_TYPE}, fc AS (SELECT g, k AS source, k FROM tn UNION SELECT fc.g, source, ce.t FROM fc JOIN ce ON fc.g = ce.g AND fc.k = ce.s) SELECT g AS graph_id, source, k AS event_id FROM fc",
    "scenario_tree": f"{_TREE} SELECT g AS graph_id, src AS source, array_to_string(path, ',') AS path, depth::BIGINT AS depth, round(p, 6) AS p FROM tk",
    "likely_terminal": f"""{_TREE}, lf AS (SELECT *, printf('%.4f', p)::DOUBLE AS r FROM tk WHERE depth = 3 OR NOT EXISTS (SELECT 1 FROM ce WHERE ce.g = tk.g AND ce.s = tk.node))
SELECT g AS graph_id, src AS source, node, round(r, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY g, src ORDER BY r DESC, ords DESC) AS m FROM lf) WHERE m = 1""",
    "anchor_match": f"""WITH {_TYPE}, qs AS (SELECT user_id::VARCHAR AS g, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'what about ' || event_type || '?' ELSE 'the flo ' || event_type[1:3] || ' ' || event_id END AS q FROM events),
x AS (SELECT qs.g, id, o, k, k AS a, 'the ' || k || ' flood' AS b, q FROM qs JOIN tn ON qs.g = tn.g),
y AS (SELECT *, CASE WHEN contains(q, a) OR contains(q, b) OR contains(a, q) OR contains(b, q) THEN 3 WHEN greatest(len(list_intersect(list_distinct([a[i:i + 1] FOR i IN range(1, length(a))]), list_distinct([q[i:i + 1] FOR i IN range(1, length(q))]))) / len(CASE WHEN length(a) <= length(q) THEN list_distinct([a[i:i + 1] FOR i IN range(1, length(a))]) ELSE list_distinct([q[i:i + 1] FOR i IN range(1, length(q))]) END), len(list_intersect(list_distinct([b[i:i + 1] FOR i IN range(1, length(b))]), list_distinct([q[i:i + 1] FOR i IN range(1, length(q))]))) / len(CASE WHEN length(b) <= length(q) THEN list_distinct([b[i:i + 1] FOR i IN range(1, length(b))]) ELSE list_distinct([q[i:i + 1] FOR i IN range(1, length(q))]) END), CASE WHEN contains(q, 'k') THEN 1 ELSE 0 END) >= 0.5 THEN 2 ELSE 0 END AS s FROM x),
z AS (SELECT *, max(s) OVER (PARTITION BY g, id) AS m FROM y WHERE s > 0)
SELECT g AS graph_id, id AS query_id, k AS event_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY o) AS n FROM z WHERE s = m) WHERE n <= 3""",
    "event_mentions": """WITH e AS (SELECT user_id::VARCHAR AS g, event_id AS id, event_type || ' ' || event_id AS b, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id || 'y ' || event_type[1:4] || '?' ELSE 'why ' || event_type || ' ' || event_id || '?' END AS q FROM events),
w AS (SELECT *, list_distinct([b[i:i + 1] FOR i IN range(1, length(b))]) AS bg, list_distinct([q[i:i + 1] FOR i IN range(1, length(q))]) AS qg FROM e),
y AS (SELECT q.g, q.id, n.id AS node, CASE WHEN contains(q.q, n.b) OR contains(n.b, q.q) THEN 3 WHEN len(list_intersect(n.bg, q.qg)) / len(CASE WHEN length(n.b) <= length(q.q) THEN n.bg ELSE q.qg END) >= 0.5 THEN 2 ELSE 0 END AS s FROM w q JOIN w n ON q.g = n.g),
z AS (SELECT *, max(s) OVER (PARTITION BY g, id) AS m FROM y WHERE s > 0)
SELECT g AS graph_id, id AS query_id, node::VARCHAR AS event_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY node) AS n FROM z WHERE s = m) WHERE n <= 4""",
    "pack_answers": """WITH o AS (SELECT l_orderkey::VARCHAR AS g, count(*) AS n FROM lineitem GROUP BY l_orderkey),
s AS (SELECT g, n, CASE WHEN n = 1 THEN 0.36 WHEN n = 3 THEN 0.55 WHEN n <= 8 THEN 0.75 ELSE pow(pow(0.75, 7 - (n - 8)) * pow(0.55, n - 8), 1.0 / 7) END::DOUBLE AS sc, CASE WHEN n <= 3 THEN 1 WHEN n = 4 THEN 4 WHEN n = 5 THEN 6 WHEN n <= 14 THEN 7 ELSE 2 END AS k FROM o)
SELECT g AS graph_id, 1::BIGINT AS q_ord, round(sc, 4)::DOUBLE AS confidence, CASE WHEN sc >= 0.6 THEN 'probable' ELSE 'possible' END AS confidence_level, k::BIGINT AS n_chains, CASE WHEN n = 1 THEN 'D001' ELSE 'D001,' || printf('D%03d', n) END AS first_chain,
  CASE WHEN n = 1 THEN 0.26 WHEN n <= 8 AND n <> 3 THEN 0.40 WHEN round(sc, 4) >= 0.65 THEN 0.17 ELSE 0.26 END::DOUBLE AS submitted FROM s
UNION ALL SELECT g, 2, CASE WHEN n = 1 THEN 0.3 ELSE 0.7 END::DOUBLE, CASE WHEN n = 1 THEN 'possible' ELSE 'probable' END, 1, CASE WHEN n = 1 THEN 'D001' ELSE 'D001,D002' END, CASE WHEN n = 1 THEN 0.2 ELSE 0.21 END::DOUBLE FROM s""",
    "level_calibration": f"""WITH s AS (SELECT o_orderkey, {_KIND} AS t, floor(o_totalprice / 5000) / 100 AS s FROM orders),
p AS (SELECT *, CASE WHEN s >= 0.85 THEN 'certain' WHEN s >= 0.6 THEN 'probable' WHEN s >= 0.35 THEN 'possible' WHEN s > 0.05 THEN 'low' END AS plain FROM s)
SELECT o_orderkey, plain, CASE WHEN t = 'single_hop' THEN CASE WHEN s >= 0.6 THEN 'certain' WHEN s >= 0.4 THEN 'probable' WHEN s >= 0.25 THEN 'possible' END
  WHEN t IN ('multi_hop_causal', 'temporal_causal') THEN CASE WHEN s >= 0.85 THEN 'high' ELSE plain END
  WHEN t = 'grounded_pred' THEN CASE WHEN s >= 0.6 THEN 'probable' ELSE plain END
  WHEN t = 'counterfactual' THEN CASE WHEN s >= 0.55 THEN 'probable' WHEN s >= 0.4 THEN 'medium' WHEN s >= 0.25 THEN 'possible' ELSE 'low' END ELSE plain END AS level FROM p""",
    "confidence_calibration": f"""WITH s AS (SELECT o_orderkey, {_KIND} AS t, floor(o_totalprice / 5000) / 100 AS s FROM orders),
b(t, b, v) AS (VALUES {', '.join(f"('{t}', {b}::DOUBLE, {v}::DOUBLE)" for t, bs in lx.CALIBRATION.items() for b, v in bs.items())}),
a(t, v) AS (VALUES {', '.join(f"('{t}', {v}::DOUBLE)" for t, v in lx.CALIBRATION_BASE.items())}),
x AS (SELECT *, printf('%.70f', s) AS digits FROM s), y AS (SELECT *, (digits[1:1] || digits[3:3])::INT AS tenths, digits[4:] AS rest, '5' || repeat('0', 68) AS half FROM x),
k AS (SELECT *, (tenths + CASE WHEN rest > half OR (rest = half AND tenths % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE AS bucket FROM y)
SELECT o_orderkey, round(least(0.85, greatest(0.05, coalesce((SELECT max(v) FROM b WHERE b.t = k.t AND abs(b.b - bucket) < 0.001), (SELECT arg_max(v, b.b) FROM b WHERE b.t = k.t AND b.b <= s), (SELECT max(v) FROM a WHERE a.t = k.t)))), 3) AS confidence FROM k""",
    "micro_prf": """WITH p AS (SELECT doc_id, CASE WHEN n_chars > 300 AND NOT regexp_matches(text, '[#%]') THEN 1 ELSE 0 END AS k FROM documents SEMI JOIN labels USING (doc_id)),
x AS (SELECT coalesce(l.quality, p.k) AS kind, l.doc_id IS NOT NULL AS g, p.doc_id IS NOT NULL AS p FROM labels l FULL JOIN p ON l.doc_id = p.doc_id AND l.quality = p.k),
c AS (SELECT kind, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM x GROUP BY kind)
SELECT kind, tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""",
    "token_f1": r"""WITH p AS (SELECT d.doc_id, d.text AS a, coalesce(b.text, '') AS b, list_distinct([x FOR x IN regexp_split_to_array(d.text, '\s+') IF x <> '']) AS x, list_distinct([x FOR x IN regexp_split_to_array(coalesce(b.text, ''), '\s+') IF x <> '']) AS y FROM documents d LEFT JOIN documents b ON b.doc_id = d.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(list_intersect(x, y)) = 0 THEN 0 ELSE 2 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6)::DOUBLE AS f1, trim(a) = trim(b) AS same FROM p""",
    "answer_report": r"""WITH t AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT * FROM t WHERE role = 'user'),
x AS (SELECT coalesce(text, '') AS a, coalesce(t2, '') AS b, list_distinct([x FOR x IN regexp_split_to_array(coalesce(text, ''), '\s+') IF x <> '']) AS x, list_distinct([x FOR x IN regexp_split_to_array(coalesce(t2, ''), '\s+') IF x <> '']) AS y FROM g WHERE r2 = 'assistant')
SELECT (SELECT count(*) FROM g) AS total, count(*) FILTER (trim(a) = trim(b)) AS exact_match, round(count(*) FILTER (trim(a) = trim(b)) / (SELECT count(*) FROM g), 6) AS em, round(sum(CASE WHEN len(list_intersect(x, y)) = 0 THEN 0 ELSE 2 * len(list_intersect(x, y)) / (len(x) + len(y)) END) / (SELECT count(*) FROM g), 6) AS avg_f1 FROM x""",
}

for _name, _of in (("best_paths_5", "best_paths_k"), ("topk_paths_5", "topk_paths")):
    ORACLE[_name] = ORACLE[_of].replace(_USER, _user(int(_name[-1])))
ORACLE |= {name: ORACLE[f.__name__] for name, f in SAME.items()}
ORACLE |= lexical.ORACLE | reasoned.ORACLE | staged.ORACLE | {
    "saved_graphs": f"WITH {_TYPE} SELECT g AS graph_id, printf('R%03d', n) AS relation_id, upper(s) AS cause, upper(t) AS effect, round(c, 6) AS confidence FROM ce",
}
ORACLE |= {name: ORACLE[same] for name, same in streamed.SAME_ROWS.items()}

_BRANCHING = f"""{_TREE},
bp AS (SELECT g, s, t, [s, t] AS path, [printf('R%03d', n)] AS rids, [ord] AS ords, c::DOUBLE AS p, 1 AS hops FROM ce
  UNION ALL SELECT bp.g, bp.s, ce.t, list_append(path, ce.t), list_append(rids, printf('R%03d', ce.n)), list_append(ords, ce.ord), p * c, hops + 1 FROM bp JOIN ce ON bp.g = ce.g AND bp.t = ce.s WHERE hops < 5 AND NOT list_contains(path, ce.t)),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, s, t ORDER BY p DESC, ords) AS m FROM bp) WHERE m = 1),
w AS (SELECT g, 'back' AS way, t AS a, s AS b, path, rids, p, hops FROM bb UNION ALL SELECT g, 'ahead', s, t, path, rids, p, hops FROM bb),
wr AS (SELECT w.*, tn.o, row_number() OVER (PARTITION BY w.g, way, a ORDER BY p DESC, hops, tn.o) AS r, CASE way WHEN 'back' THEN NOT EXISTS (SELECT 1 FROM ce WHERE ce.g = w.g AND ce.t = b) ELSE NOT EXISTS (SELECT 1 FROM ce WHERE ce.g = w.g AND ce.s = b) END AS fin FROM w JOIN tn ON tn.g = w.g AND tn.k = b),
wl AS (SELECT g, way, a, string_agg('  · ' || array_to_string(path, ' -> ') || '（联合置信度 ' || printf('%.2f', p) || '）', chr(10) ORDER BY r) AS lines, count(*) AS n, min_by(rids, r) AS rids, max(p) AS p,
  string_agg(b || CASE way WHEN 'back' THEN '' ELSE '（强度' || printf('%.2f', p) || '）' END, '、' ORDER BY p DESC, o) FILTER (fin AND p > 0) AS fins FROM wr GROUP BY ALL),
de AS (SELECT g, 'back' AS way, t AS a, s AS b, c, o FROM ce UNION ALL SELECT g, 'ahead', s, t, c, o FROM ce),
dl AS (SELECT de.g, de.way, de.a, string_agg(de.b || '（强度' || printf('%.2f', CASE WHEN w.p > 0 THEN w.p ELSE c END) || '）', '、' ORDER BY de.o) AS direct FROM de LEFT JOIN w ON w.g = de.g AND w.way = de.way AND w.a = de.a AND w.b = de.b GROUP BY ALL),
od AS (SELECT g, list(s) AS ss, list(mx) AS ms FROM (SELECT g, s, max(ord) AS mx FROM ce GROUP BY ALL) GROUP BY g),
tf AS (SELECT tk.*, [ords[i + 1] = ms[list_position(ss, path[i])] FOR i IN range(1, depth + 1)] AS fl FROM tk JOIN od ON od.g = tk.g),
tt AS (SELECT g, src, string_agg(array_to_string([CASE WHEN fl[i] THEN '   ' ELSE '│  ' END FOR i IN range(1, depth)], '') || CASE WHEN depth = 0 THEN '' WHEN fl[depth] THEN '└─ ' ELSE '├─ ' END || node || '（p=' || printf('%.2f', printf('%.4f', p)::DOUBLE) || '）', chr(10) ORDER BY n) AS said FROM tf GROUP BY ALL),
lf AS (SELECT g, src, node, printf('%.4f', p)::DOUBLE AS r, ords FROM tk WHERE depth = 3 OR NOT EXISTS (SELECT 1 FROM ce WHERE ce.g = tk.g AND ce.s = tk.node)),
le AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, src ORDER BY r DESC, ords DESC) AS m FROM lf) WHERE m = 1),
ts AS (SELECT tt.g, tt.src, '从「' || tt.src || '」出发的可能性树（每层概率 = 上层概率 × 边置信度）：' || chr(10) || said || chr(10) || '最可能的最终态势：「' || le.node || '」（概率 ' || printf('%.2f', r) || '）' AS text, coalesce(x.rids, y.rids) AS rids, r
  FROM tt JOIN le ON le.g = tt.g AND le.src = tt.src JOIN ce f ON f.g = tt.g AND f.s = tt.src AND f.ord = 1 LEFT JOIN bb x ON x.g = tt.g AND x.s = tt.src AND x.t = le.node LEFT JOIN bb y ON y.g = tt.g AND y.s = tt.src AND y.t = f.t),
av AS (SELECT tn.g, v.way || '-' || k AS query_id, CASE WHEN n IS NULL THEN '「' || k || '」在图中没有' || v.none ELSE '「' || k || '」' || v.head || chr(10) || v.near || direct || chr(10) || v.every || chr(10) || lines || coalesce(chr(10) || v.last || fins, '') END AS text, rids, p, n
  FROM tn JOIN (VALUES ('back', '的因果追溯如下：', '直接原因：', '多条因果链（按强度排序）：', '根本原因（根事件）：', '上游原因（可能是根事件）。'), ('ahead', '可能引发的后续如下：', '直接后果：', '多条影响链（按强度排序）：', '最终后果：', '下游影响（可能是末端事件）。')) v(way, head, near, every, last, none) ON true
  LEFT JOIN wl ON wl.g = tn.g AND wl.a = k AND wl.way = v.way LEFT JOIN dl ON dl.g = tn.g AND dl.a = k AND dl.way = v.way
  UNION ALL SELECT tn.g, 'tree-' || k, coalesce(text, '「' || k || '」在图中没有下游事件，暂无法推演后续态势。'), rids, r, 0 FROM tn LEFT JOIN ts ON ts.g = tn.g AND ts.src = k)"""
ORACLE["branching_answers"] = f"""{_BRANCHING} SELECT g AS graph_id, query_id, md5(text) AS text_md5, coalesce(array_to_string(rids, ','), '') AS evidence_chain, printf('%.4f', least(coalesce(p, 0), 0.99::DOUBLE))::DOUBLE AS confidence, coalesce(n, 0)::BIGINT AS n_chains FROM av"""
