"""Event graphs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators import graph, relate
from eventloom.sources.storage import joined_by_measure, kept, sized_by_rows

NONE = "array<struct<role:string,value:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    joined_by_measure(spark)
    return sized_by_rows(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def user_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each user: their events in order of time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("graph_id"), F.concat(F.lit("E"), order.cast("string")).alias("event_id"), order.alias("node_ord"), F.col("event_id").alias("source_id"),
        "event_type", F.col("event_type").alias("trigger"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("mention"), F.array().cast(NONE).alias("arguments"),
    )


def user_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users' events, related by narrative order."""
    nodes = user_nodes(spark, sf_dir)
    return nodes, relate.by_order(nodes)


def raw_type_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each user: each event's type leads to the next one's; loops, repeats and reverses included."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.withColumn("effect_event_id", F.lead("event_type").over(order)).withColumn("edge_ord", F.row_number().over(order).cast("long"))
    return steps.where("effect_event_id IS NOT NULL").select(
        F.col("user_id").cast("string").alias("graph_id"), "edge_ord", F.lit("").alias("relation_id"), F.col("event_type").alias("cause_event_id"), "effect_event_id",
        F.lit("causal").alias("relation_type"), (F.abs("value") - F.floor(F.abs("value"))).alias("confidence"),
    )


def type_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types of each user but for errors, in alphabetical order."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").cast("string").alias("graph_id"), F.col("event_type").alias("event_id")).distinct()
    return e.withColumn("node_ord", F.row_number().over(Window.partitionBy("graph_id").orderBy("event_id")).cast("long"))


def type_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = type_nodes(spark, sf_dir)
    return nodes, graph.clean_edges(raw_type_relations(spark, sf_dir), nodes)


def geo_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph for each nation: its region leads to it, it leads to its customers, and so do the
    suppliers whose parts they ordered, by the largest discount."""
    region, nation, customer, orders, lineitem = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    one = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(customer.select("c_custkey", "c_nationkey"), "c_custkey")
    # lines move twice, to their orders and to their customers: a customer's rows lie together, so sums by customer are made before anything moves
    bought = (
        lineitem.select("l_orderkey", "l_suppkey", "l_discount").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .repartition("c_custkey").groupBy("l_suppkey", "c_custkey", "c_nationkey").agg(F.max("l_discount").alias("d"))
    )
    bought = kept(bought, "geo-bought")  # nodes and edges, which are read many times, come from it: the lines are joined once
    n, c = F.col("n_nationkey").cast("string").alias("graph_id"), F.col("c_nationkey").cast("string").alias("graph_id")
    place = lambda k, base: (F.col(k) + F.lit(base)).cast("long").alias("node_ord")
    nodes = (
        one.select(n, name("R", "r_regionkey").alias("event_id"), F.lit(0).cast("long").alias("node_ord"), F.col("r_name").alias("mention"))
        .unionByName(nation.select(n, name("N", "n_nationkey").alias("event_id"), F.lit(1).cast("long").alias("node_ord"), F.col("n_name").alias("mention")))
        .unionByName(bought.select(c, name("S", "l_suppkey").alias("event_id"), place("l_suppkey", 2), name("supplier ", "l_suppkey").alias("mention")).distinct())
        .unionByName(customer.select(c, name("C", "c_custkey").alias("event_id"), place("c_custkey", 10_000_000_000), F.col("c_name").alias("mention")))
    )
    edges = (
        one.select(n, F.lit(0).cast("long").alias("edge_ord"), name("R", "r_regionkey").alias("cause_event_id"), name("N", "n_nationkey").alias("effect_event_id"), F.lit(0.9).alias("confidence"))
        .unionByName(customer.select(c, F.col("c_custkey").alias("edge_ord"), name("N", "c_nationkey").alias("cause_event_id"), name("C", "c_custkey").alias("effect_event_id"), (F.abs("c_acctbal") / 10000).alias("confidence")))
        .unionByName(bought.select(c, (F.col("l_suppkey") * 10_000_000_000 + F.col("c_custkey")).alias("edge_ord"), name("S", "l_suppkey").alias("cause_event_id"), name("C", "c_custkey").alias("effect_event_id"), (F.col("d") * 10).alias("confidence")))
    )
    return nodes, edges.withColumn("relation_id", F.concat_ws(">", "cause_event_id", "effect_event_id"))


def order_packs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A pack for each order that has lines: they are events D001, D002, …, and two questions."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).cast("long")
    many = F.count("*").over(Window.partitionBy("l_orderkey"))
    events = lines.withColumn("node_ord", place).withColumn("n", many)
    nodes = events.select(
        F.col("l_orderkey").cast("string").alias("graph_id"), "node_ord", F.format_string("D%03d", F.col("node_ord")).alias("event_id"), F.lit("").alias("doc_id"), F.lit("供货").alias("event_type"), F.lit("供货").alias("trigger"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("mention"), F.array().cast(NONE).alias("arguments"), F.lit("").alias("time"), F.lit("").alias("location"), F.lit(0.9).alias("confidence"), "n",
    )
    last = F.format_string("D%03d", F.col("n"))
    asked = F.array(
        F.struct(F.lit(1).cast("long").alias("q_ord"), F.lit("temporal_causal").alias("reasoning_type"), F.concat(F.lit("D001先于"), last, F.lit("，能否认定因果？")).alias("question")),
        F.struct(F.lit(2).cast("long").alias("q_ord"), F.lit("counterfactual").alias("reasoning_type"), F.lit("如果阻断D001，D002还会发生吗？").alias("question")),
    )
    questions = nodes.where("node_ord = 1").select("graph_id", F.explode(asked).alias("q")).select("graph_id", "q.*", F.lit("retrospective").alias("question_type"), F.lit("s").alias("sample_id"), F.lit("p").alias("pack_id"), F.lit("B").alias("task"))
    nodes = kept(nodes.drop("n"), "order-nodes")
    return {"nodes": nodes, "edges": kept(relate.by_order(nodes), "order-edges"), "questions": kept(questions, "order-questions")}


def in_turn(sizes: DataFrame, rows: list[tuple[str, ...]], named: list[str], each: int) -> DataFrame:
    """(graph_id, q_ord, *named, question): ``each`` of the rows (values of ``named``, question) for every graph (graph_id, n), in their turn;
    {n} is the last event's id. Places are dealt out first, so only the questions that are asked are made."""
    turn = F.array(*[((F.col("graph_id").cast("long") + i * len(rows) // each) % len(rows)).cast("int") for i in range(each)])
    placed = sizes.select("graph_id", "n", F.explode(turn).alias("_i"))
    listed = [F.get(F.array(*[F.lit(r[c]) for r in rows]), F.col("_i")) for c in range(len(named) + 1)]
    said = F.replace(listed[-1], F.lit("{n}"), F.format_string("D%03d", F.col("n")))
    return placed.select("graph_id", F.col("_i").cast("long").alias("q_ord"), *[v.alias(c) for v, c in zip(listed, named, strict=False)], said.alias("question"))
