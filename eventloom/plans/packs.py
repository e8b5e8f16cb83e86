"""All packs below a folder: graphs prepared by task, questions answered, results written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import graph, pack_answer, pack_extract, relate
from eventloom.sources import io, packs
from eventloom.sources.storage import joined_by_measure, kept


def pack_graphs(spark: SparkSession, folder: str, task: str | None = None) -> dict[str, DataFrame]:
    """nodes, edges, questions and docs of every pack.

    Packs with events and relations (A) are taken as given, with events only (B) their relations
    are inferred, else (C) events too. ``task`` changes the label of the records only.
    """
    joined_by_measure(spark)
    files = kept(packs.pack_files(spark, folder), "pack-files")
    if files.isEmpty():
        raise FileNotFoundError(f"no question packs in {folder}")
    docs = kept(packs.pack_documents(spark, folder), "pack-docs")
    questions = kept(packs.pack_questions(spark, folder), "pack-questions")
    given = packs.pack_events(spark, folder, docs).join(files.where("given_events").select("graph_id"), "graph_id", "left_semi")
    bare = docs.join(files.where("NOT given_events").select("graph_id"), "graph_id", "left_semi")
    made = pack_extract.events(bare, packs.label_hints(questions, given))
    events = kept(given.unionByName(made), "pack-events")
    stated = packs.pack_relations(spark, folder, events, docs).join(files.where("given_relations").select("graph_id"), "graph_id", "left_semi")
    open_ = events.join(files.where("NOT given_relations").select("graph_id"), "graph_id", "left_semi")
    relations = kept(stated.select(*relate.EDGE).unionByName(relate.relations(open_).select(*relate.EDGE)), "pack-relations")
    nodes, edges = graph.build(events, relations)
    label = F.lit(task) if task else F.col("task")
    return {"files": files, "docs": docs, "nodes": kept(nodes, "pack-nodes"), "edges": kept(edges, "pack-edges"), "questions": questions.join(files.select("graph_id", label.alias("task")), "graph_id")}


def run_packs(spark: SparkSession, folder: str, out: str | None = None, task: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, submission, summary) of all packs; below ``out``, if given, an array for each pack, and one each of
    submissions and summaries."""
    g = pack_graphs(spark, folder, task)
    records = kept(pack_answer.records(g["nodes"], g["edges"], g["questions"], g["docs"]), "pack-records")
    submission = pack_answer.submission(records)
    sizes = graph.metadata(g["nodes"], g["edges"])
    types = records.groupBy("graph_id", "question_type").count().groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("question_type", "count"))).alias("question_types"))
    counts = records.groupBy("graph_id").agg(F.count("*").alias("questions"), F.count_if(F.col("confidence_level").isNull()).alias("refused"), F.first("task").alias("task"))
    summary = g["files"].select("graph_id").join(counts, "graph_id", "left").join(sizes, "graph_id", "left").join(types, "graph_id", "left")
    if out:
        io.save_arrays(records, f"{out}/packs", "graph_id", ["q_ord"])
        names = [c for c in submission.columns if c not in ("graph_id", "q_ord")]
        io.save_array(submission.select(F.col("graph_id").alias("_g"), F.col("q_ord").alias("_q"), *names), f"{out}/submit_answers.json", ["_g", "_q"])
        io.save_array(summary.withColumn("_g", F.col("graph_id")), f"{out}/run_summary.json", ["_g"])
    return records, submission, summary


def main(arguments: list[str] | None = None) -> None:
    """``python -m eventloom.plans.packs FOLDER OUT [--task A|B|C]``."""
    import argparse

    parser = argparse.ArgumentParser(description=run_packs.__doc__)
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--task", choices=["A", "B", "C"])
    given = parser.parse_args(arguments)
    run_packs(SparkSession.builder.getOrCreate(), given.folder, given.out, given.task)


if __name__ == "__main__":
    main()
