"""The three tiers: graph given, events given, or documents only; then questions are answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import answer, extract, graph, relate
from eventloom.sources import io
from eventloom.sources.config import Config, resolve_path
from eventloom.sources.storage import joined_by_measure


def news_answers(spark: SparkSession, path: str, config: Config | None = None) -> DataFrame:
    """Answers to the questions of news bundles (a file, a folder or a glob), all graphs in one run."""
    events, relations, queries = io.load_news(spark, path)
    nodes, edges = graph.build(events, relations)
    return answers(nodes, edges, queries, config)


def answers(nodes: DataFrame, edges: DataFrame, queries: DataFrame, config: Config | None = None) -> DataFrame:
    c = config or Config()
    joined_by_measure(nodes.sparkSession)
    return answer.answers(nodes, edges, queries, c.whole("reasoning.causal_tracing.max_depth", 5), c.whole("reasoning.situation_deduction.max_hops", 3), c.whole("reasoning.counterfactual.max_depth", 5))


def run(spark: SparkSession, config: Config, base: str = ".") -> DataFrame:
    """One tier by ``config``: mode challenge (documents), reasoning (events) or basic (a graph).

    Events, relations, nodes and edges are written under ``output_dir`` and read again between the
    stages; the answers are written there, as an array in answers.json too, and returned.
    """
    mode = config.get("mode", "basic")
    path = lambda key: resolve_path(base, config.get(key))
    out = path("output_dir") or path("paths.output_dir")
    given = lambda name: path(f"input.{name}") or path(f"paths.{name}")

    def step(df: DataFrame, name: str) -> DataFrame:
        io.save_rows(df, f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    if mode == "challenge":
        docs = io.load_documents(spark, given("documents"))
        model = config.get("extraction.model", "rule")
        events = step(extract.events(docs, order=["doc_ord"], model=model).withColumn("graph_id", F.lit("G001")), "events")
    elif mode == "reasoning":
        events = io.load_events(spark, given("events"))
    elif mode == "basic":
        nodes, edges = io.load_graphs(spark, given("graph"))
    else:
        raise ValueError(f"unknown mode: {mode}")
    if mode != "basic":
        relations = step(relate.relations(events), "relations")
        nodes, edges = graph.build(events, relations)
    nodes, edges = step(nodes, "nodes"), step(edges, "edges")
    queries = io.load_queries(spark, given("queries"))
    names = nodes.select("graph_id").distinct()
    queries = queries.drop("graph_id").join(F.broadcast(names.limit(1))) if mode == "basic" else queries  # one graph a file
    found = step(answers(nodes, edges, queries, config), "answers")
    io.save_array(found, f"{out}/answers.json", ["graph_id", "query_id"])
    return found


def main(arguments: list[str] | None = None) -> None:
    """``python -m eventloom.plans.tiers CONFIG [--mode MODE] [--output-dir DIR]``."""
    import argparse
    import os

    from eventloom.sources.config import load_config

    parser = argparse.ArgumentParser(description=run.__doc__)
    parser.add_argument("config")
    parser.add_argument("--mode", choices=["basic", "reasoning", "challenge"])
    parser.add_argument("--output-dir")
    given = parser.parse_args(arguments)
    raw = dict(load_config(given.config).raw)
    raw |= {k: v for k, v in (("mode", given.mode), ("output_dir", given.output_dir)) if v}
    run(SparkSession.builder.getOrCreate(), Config(raw), os.path.dirname(os.path.abspath(given.config)))


if __name__ == "__main__":
    main()
