"""Readers and writers of documents, events, relations, graphs, questions and answers.

Everything goes through Spark's readers, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators import numbering
from eventloom.sources import schemas as sc


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One object a line; blank lines are skipped, malformed ones are an error."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A file that is one object or an array of objects."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_any(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """By suffix: ``.jsonl`` holds lines, anything else an array."""
    return read_jsonl(spark, path, ddl) if path.endswith(".jsonl") else read_json(spark, path, ddl)


def check_keys(spark: SparkSession, path: str, ddl: str, multi_line: bool = False) -> list[str]:
    """Keys of the objects in ``path`` that the schema doesn't know."""
    known = set(spark.createDataFrame([], ddl).columns)
    return sorted(set(spark.read.option("multiLine", multi_line).json(path).columns) - known)


def ordered(df: DataFrame, column: str) -> DataFrame:
    """``df``, just read from files, with its reading order 1, 2, 3 … as ``column``: by path, then by place in the file."""
    placed = df.withColumns({"_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    return numbering.numbered(placed, ["_path", "_block", "_line"], column).drop("_path", "_block", "_line")


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    return ordered(read_any(spark, path, sc.DOCUMENT_DDL), "doc_ord")


def load_events(spark: SparkSession, path: str, graph_id: str = "G001") -> DataFrame:
    return ordered(read_jsonl(spark, path, sc.EVENT_DDL), "node_ord").withColumn("graph_id", F.lit(graph_id))


def load_relations(spark: SparkSession, path: str, graph_id: str = "G001") -> DataFrame:
    return ordered(read_jsonl(spark, path, sc.RELATION_DDL), "edge_ord").withColumn("graph_id", F.lit(graph_id))


def load_queries(spark: SparkSession, path: str | None, graph_id: str = "G001") -> DataFrame:
    """Questions; a missing file gives none."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], f"graph_id STRING, {sc.QUERY_DDL}")
    return read_any(spark, path, sc.QUERY_DDL).withColumn("graph_id", F.lit(graph_id))


def _spread(df: DataFrame, graph: str, column: str, order: str) -> DataFrame:
    return df.select(F.col(graph).alias("graph_id"), F.posexplode(column).alias(order, "x")).select("graph_id", F.col(order).cast("long").alias(order), "x.*")


def _one_a_line(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank is a whole JSON object."""
    first = spark.read.text(path).where(F.trim("value") != "").select("value").first()
    try:
        return isinstance(json.loads(first[0]), dict) if first else True
    except ValueError:
        return False


def load_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of saved graphs, an object a line or a file of its own each, as they are: saved graphs aren't
    cleaned again."""
    graphs = (read_jsonl if _one_a_line(spark, path) else read_json)(spark, path, sc.GRAPH_DDL)
    return _spread(graphs, "graph_id", "nodes", "node_ord"), _spread(graphs, "graph_id", "edges", "edge_ord")


def load_news(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, relations, questions) of news bundles, a graph for each ``news_id``; to be built."""
    news = read_json(spark, path, sc.NEWS_DDL)
    queries = news.select(F.col("news_id").alias("graph_id"), F.explode("queries").alias("x")).select("graph_id", "x.*")
    return _spread(news, "news_id", "events", "node_ord"), _spread(news, "news_id", "relations", "edge_ord"), queries


def save_rows(df: DataFrame, path: str, fmt: str = "parquet", one_file: bool = False) -> None:
    """``df`` as Parquet or JSON lines; ``one_file`` only for what is known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").format(fmt).save(path)


def save_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A JSON object for each graph (graph_id, nodes, edges, metadata), as ``load_graphs`` reads it."""
    gather = lambda d, o: F.transform(F.array_sort(F.collect_list(F.struct(o, F.struct(*[c for c in d.columns if c not in ("graph_id", o)]).alias("x")))), lambda r: r["x"])
    n = nodes.groupBy("graph_id").agg(gather(nodes, "node_ord").alias("nodes"))
    e = edges.groupBy("graph_id").agg(gather(edges, "edge_ord").alias("edges"))
    both = n.join(e, "graph_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)))
    counts = F.create_map(F.lit("node_count"), F.size("nodes").cast("string"), F.lit("edge_count"), F.size("edges").cast("string"))
    both.withColumn("metadata", counts).write.mode("overwrite").json(path)


def save_answers(answers: DataFrame, path: str) -> None:
    """Answers as JSON lines."""
    answers.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_array(rows: DataFrame, path: str, order: list[str]) -> None:
    """One file ``path`` that is a JSON array of the rows in that order, written line by line by one task.

    For results that people read: rows stream through the task, no more is held than its sort.
    """
    spark = rows.sparkSession
    body = F.to_json(F.struct(*[c for c in rows.columns if not c.startswith("_")]), {"ignoreNullFields": "false"})
    lines = rows.select(*order, body.alias("_json"))
    place = numbering.numbered(lines, order, "_n")
    last = place.agg(F.max("_n")).first()[0]
    text = F.concat(F.when(F.col("_n") == 1, "[\n").otherwise(""), F.col("_json"), F.when(F.col("_n") == last, "\n]").otherwise(","))
    shaped = place.select("_n", text.alias("value")).orderBy("_n").select("value") if last else spark.createDataFrame([("[]",)], "value string")
    folder = f"{path}.parts"
    shaped.coalesce(1).write.mode("overwrite").text(folder)
    _moved(spark, folder, path)


def save_arrays(rows: DataFrame, folder: str, key: str, order: list[str]) -> None:
    """A file ``folder/<key>.json`` for each value of ``key``, a JSON array of its rows in that order; a group is
    small by nature (the questions of a pack)."""
    one = F.struct(*[c for c in rows.columns if c not in (key, *order)]).alias("_row")
    groups = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, one))), lambda x: x["_row"]).alias("_rows"))
    parts = f"{folder}.parts"
    groups.select(key, F.to_json("_rows", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy(key).text(parts)
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(parts)
    for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
        name = f.getPath().getName()
        if name.startswith(f"{key}="):
            _moved(spark, f.getPath().toString(), f"{folder}/{unquote(name[len(key) + 1 :])}.json")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _moved(spark: SparkSession, folder: str, path: str) -> None:
    """Moves the only part file of a written folder to ``path`` and deletes the folder."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = file(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in store.listStatus(file(folder)) if f.getPath().getName().startswith("part-"))
    store.mkdirs(file(path).getParent())
    store.delete(file(path), True)
    store.rename(part, file(path))
    store.delete(file(folder), True)


def load_labelled(spark: SparkSession, path: str, ddl: str = sc.DUEE_DDL) -> DataFrame:
    """Labelled rows: a JSON array if the file begins with ``[``, else a row a line."""
    first = spark.read.text(path, wholetext=False).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    return read_json(spark, path, ddl) if first and first[0] == "[" else read_jsonl(spark, path, ddl)


def convert_labelled(rows: DataFrame, keep_without_trigger: bool = False) -> DataFrame:
    """Training rows (text, events) of labelled ones: spans from start and length, types and roles mapped.

    Rows without text, events without a trigger (unless kept), arguments without a start, and rows
    left without events go.
    """
    from eventloom.operators import mapping

    def span(start, text):
        return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))

    def argument(a):
        text = a["argument"]
        return F.struct(a["role"].alias("role"), mapping.role(a["role"]).alias("mapped_role"), a["argument_start_index"].alias("start"), (a["argument_start_index"] + F.length(text)).alias("end"), text.alias("text"))

    def event(e):
        located = (F.coalesce(e["trigger"], F.lit("")) != "") & (e["trigger_start_index"] >= 0)
        args = F.transform(F.filter(e["arguments"], lambda a: (F.coalesce(a["argument"], F.lit("")) != "") & (a["argument_start_index"] >= 0)), argument)
        return F.struct(e["event_type"].alias("event_type"), mapping.event_type(e["event_type"]).alias("mapped_type"), F.when(located, span(e["trigger_start_index"], e["trigger"])).alias("trigger"), args.alias("arguments"))

    events = F.filter(F.transform("event_list", event), lambda e: F.lit(keep_without_trigger) | e["trigger"].isNotNull())
    return rows.where(F.coalesce("text", F.lit("")) != "").select("text", events.alias("events")).where(F.size("events") > 0)


def numbered(df: DataFrame, within: list[str], order: list, column: str) -> DataFrame:
    """1, 2, 3 … by ``order`` inside each group."""
    return df.withColumn(column, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
