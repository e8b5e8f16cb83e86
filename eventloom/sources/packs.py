"""Question packs: folders with document texts, and event, relation and question files.

All packs below a folder are read together; a pack's graph_id is the path of its folder below that one
(its own name, if the folder is the pack).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.functions import text as tx
from eventloom.operators.relate import cue_sentence
from eventloom.sources import schemas as sc


def _path() -> Column:
    return F.col("_metadata.file_path")


def _folder(path: Column, spark: SparkSession, root: str) -> Column:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/")
    whole = F.try_url_decode(path)
    parent = F.regexp_replace(F.substring(whole, F.locate(at, whole) + len(at), F.length(whole)), "/[^/]*$", "")
    return F.when(parent == "", at.rsplit("/", 1)[-1]).otherwise(F.regexp_replace(parent, "^/", ""))


def _json(spark: SparkSession, folder: str, name: str, ddl: str) -> DataFrame:
    read = spark.read.schema(ddl).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(folder)
    return read.select(_folder(_path(), spark, folder).alias("graph_id"), F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`") for c in read.columns])


def _placed(df: DataFrame, name: str) -> DataFrame:
    """The rows numbered from 1 in their file's order, for each pack."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("graph_id").orderBy("_row")).cast("long")).drop("_row")


def pack_files(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, given_events, given_relations, task) of every folder that holds questions, sorted by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path")
    name = F.try_url_decode(F.element_at(F.split("path", "/"), -1))
    has = lambda n: F.bool_or(name == n)
    by = files.groupBy(_folder(F.col("path"), spark, folder).alias("graph_id")).agg(has(lx.QUESTIONS_FILE).alias("asked"), has(lx.EVENTS_FILE).alias("events"), has(lx.RELATIONS_FILE).alias("relations"))
    task = F.when(F.col("events") & F.col("relations"), "A").when(F.col("events"), "B").otherwise("C")
    return by.where("asked").select("graph_id", F.col("events").alias("given_events"), (F.col("events") & F.col("relations")).alias("given_relations"), task.alias("task")).orderBy("graph_id")


def pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, doc_id, doc_ord, title, text): the whole text, its first non-blank line as title."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").text(folder, wholetext=True)
    name = F.try_url_decode(F.element_at(F.split(_path(), "/"), -1))
    rows = files.select(_folder(_path(), spark, folder).alias("graph_id"), name.alias("_f"), tx.strip(F.col("value")).alias("text")).where(F.col("_f").rlike("^" + lx.DOCUMENT_FILE))
    lines = F.filter(F.transform(F.split("text", r"\R"), tx.strip), lambda x: x != "")
    return rows.select("graph_id", F.regexp_replace("_f", r"\.[^.]*$", "").alias("doc_id"), F.regexp_extract("_f", lx.DOCUMENT_FILE, 1).cast("long").alias("doc_ord"), F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")).alias("title"), "text")


def _filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, or the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def pack_events(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """Given events as nodes: arguments in file order without empty ones, mention from the content, the title or the type."""
    raw = _placed(_json(spark, folder, lx.EVENTS_FILE, sc.PACK_EVENT_DDL), "node_ord").join(docs.select("graph_id", "doc_id", F.col("title").alias("_title")), ["graph_id", "doc_id"], "left")
    args = F.filter(F.transform(F.map_entries(F.coalesce("argument", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("role"), e["value"].alias("value"))), lambda a: F.coalesce(a["value"], F.lit("")) != "")
    arg = lambda k: F.try_element_at(F.coalesce("argument", F.create_map().cast("map<string,string>")), F.lit(k))
    whole = lambda c: F.col(c).rlike(r"^-?\d+$")
    return raw.select(
        "graph_id", "node_ord", "event_id", _filled(F.col("doc_id"), F.col("event_id")).alias("doc_id"), _filled(F.col("event_type")).alias("event_type"), _filled(F.col("trigger_word")).alias("trigger"),
        _filled(arg("内容"), F.col("_title"), F.col("event_type")).alias("mention"), args.alias("arguments"), _filled(F.col("occur_time")).alias("time"), _filled(arg("地点")).alias("location"),
        F.when(whole("start") & whole("end"), F.array(F.col("start").cast("int"), F.col("end").cast("int"))).alias("char_offset"), F.lit(0.95).alias("confidence"),
    )


def pack_relations(spark: SparkSession, folder: str, events: DataFrame, docs: DataFrame) -> DataFrame:
    """Given relations between given events, with evidence from the effect's document, the description or the two names."""
    raw = _placed(_json(spark, folder, lx.RELATIONS_FILE, sc.PACK_RELATION_DDL), "edge_ord").withColumn("effect", _filled(F.col("result_event_id"), F.col("effect_event_id")))
    own = events.select("graph_id", "event_id", F.struct("event_type", "trigger").alias("e"))
    a, b = (own.select("graph_id", F.col("event_id").alias(k), F.col("e").alias(x)) for k, x in (("cause_event_id", "a"), ("effect", "b")))
    joined = raw.join(a, ["graph_id", "cause_event_id"]).join(b, ["graph_id", "effect"]).join(docs.select("graph_id", F.col("doc_id").alias("effect"), "text"), ["graph_id", "effect"], "left")
    sentence = cue_sentence(F.col("text"), F.col("a.event_type"), F.col("a.trigger"), lx.EVIDENCE_CUES, least=6)
    names = F.concat(F.col("cause_event_id"), F.lit("（"), _filled(F.col("a.event_type"), F.col("a.trigger")), F.lit("） → "), F.col("effect"), F.lit("（"), F.col("b.event_type"), F.lit("）"))
    level = F.create_map(*[F.lit(x) for kv in lx.LEVEL_CONFIDENCE.items() for x in kv])
    return joined.select(
        "graph_id", "edge_ord", F.format_string("R%03d", F.col("edge_ord")).alias("relation_id"), "cause_event_id", F.col("effect").alias("effect_event_id"),
        F.coalesce(F.nullif("causal_type", F.lit("")), F.nullif("relation_type", F.lit("")), F.lit("causal")).alias("relation_type"),
        F.array(F.coalesce(sentence, F.nullif("description", F.lit("")), names)).alias("evidence"),
        F.coalesce(F.try_element_at(level, F.lower(F.coalesce("confidence_level", F.lit("")))), F.lit(lx.DEFAULT_LEVEL_CONFIDENCE)).alias("confidence"), F.lit("").alias("time_lag"),
    )


def pack_questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _placed(_json(spark, folder, lx.QUESTIONS_FILE, sc.PACK_QUESTION_DDL), "q_ord")
    return rows.withColumn("question_type", F.coalesce("question_type", F.lit("retrospective"))).withColumn("reasoning_type", F.coalesce("reasoning_type", F.lit("multi_hop_causal"))).withColumn("question", F.coalesce("question", F.lit("")))


def label_hints(questions: DataFrame, events: DataFrame) -> DataFrame:
    """(graph_id, event_id, label): labels that questions give to ids, the first one each; given types win."""
    both = F.regexp_extract_all("question", F.lit(lx.ID_LABEL), 0)
    found = questions.select("graph_id", "q_ord", F.posexplode(both).alias("i", "m")).select("graph_id", "q_ord", "i", F.concat(F.lit("D"), F.regexp_extract("m", lx.ID_LABEL, 1)).alias("event_id"), tx.strip(F.regexp_extract("m", lx.ID_LABEL, 2)).alias("label")).where("label <> ''")
    asked = found.groupBy("graph_id", "event_id").agg(F.min_by("label", F.struct("q_ord", "i")).alias("asked"))
    given = events.where("event_type <> ''").groupBy("graph_id", "event_id").agg(F.max_by("event_type", "node_ord").alias("given"))
    return asked.join(given, ["graph_id", "event_id"], "full").select("graph_id", "event_id", F.coalesce("given", "asked").alias("label"))
