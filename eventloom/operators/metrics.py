"""Evaluation: answers against gold, extracted events against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.numbers import exact_round
from eventloom.functions.text import strip
from eventloom.operators import mapping


def exact_match(pred: Column, gold: Column) -> Column:
    return strip(F.coalesce(pred, F.lit(""))) == strip(F.coalesce(gold, F.lit("")))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the two sets of white-space tokens; 0 if either is empty."""
    sets = [F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")) for c in (pred, gold)]
    common = F.size(F.array_intersect(*sets))
    return F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size(sets[0]) + F.size(sets[1])))


def answer_report(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """(total, exact_match, em, avg_f1) of (query_id, answer_text) rows; all gold rows count, unmatched predictions don't."""
    joined = preds.select("query_id", F.col("answer_text").alias("p")).join(gold.select("query_id", F.col("answer_text").alias("g")), "query_id")
    scored = joined.agg(F.coalesce(F.sum(exact_match(F.col("p"), F.col("g")).cast("long")), F.lit(0)).alias("exact_match"), F.coalesce(F.sum(token_f1(F.col("p"), F.col("g"))), F.lit(0.0)).alias("f"))
    n = F.col("total")
    return gold.agg(F.count("*").alias("total")).join(F.broadcast(scored)).select("total", "exact_match", F.when(n > 0, F.col("exact_match") / n).otherwise(0.0).alias("em"), F.when(n > 0, F.col("f") / n).otherwise(0.0).alias("avg_f1"))


def micro(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """(*by, tp, fp, fn, precision, recall, f1) of two multisets of ``keys``, in one shuffle of their counts."""
    by = by or []
    rows = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    counts = rows.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    total = counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("tp", F.least("g", "p")), ("np", F.col("p")), ("ng", F.col("g")))])
    tp, p, g = F.col("tp"), F.col("np"), F.col("ng")
    return total.select(
        *by, "tp", (p - tp).alias("fp"), (g - tp).alias("fn"),
        exact_round(F.when(p > 0, tp / p).otherwise(0.0), 4).alias("precision"), exact_round(F.when(g > 0, tp / g).otherwise(0.0), 4).alias("recall"),
        exact_round(F.when(tp > 0, 2.0 * (tp / p) * (tp / g) / (tp / p + tp / g)).otherwise(0.0), 4).alias("f1"),
    )


def gold_records(rows: DataFrame) -> DataFrame:
    """(doc_id, event_type, start, end, arguments) of labelled rows; events without a located trigger go."""
    e = rows.select(F.col("id").alias("doc_id"), F.explode("event_list").alias("e"))
    trigger = strip(F.coalesce("e.trigger", F.lit("")))
    args = F.filter(F.transform("e.arguments", lambda a: F.struct(mapping.role(a["role"]).alias("role"), strip(F.coalesce(a["argument"], F.lit(""))).alias("value"))), lambda a: a["value"] != "")
    start = F.col("e.trigger_start_index")
    return e.where((trigger != "") & (start >= 0)).select("doc_id", mapping.event_type(F.col("e.event_type")).alias("event_type"), start.alias("start"), (start + F.length(trigger)).alias("end"), args.alias("arguments"))


def pred_records(events: DataFrame, docs: DataFrame) -> DataFrame:
    """The same columns of extracted events: the trigger's span in the document."""
    joined = events.join(docs.select("doc_id", "text"), "doc_id", "left")
    inside, anywhere = F.instr("mention", F.col("trigger")), F.instr(F.coalesce("text", F.lit("")), F.col("trigger"))
    at = F.when(inside > 0, F.coalesce(F.col("char_offset")[0], F.lit(0)) + inside - 1).when(anywhere > 0, anywhere - 1)
    return joined.withColumn("start", at).where("start IS NOT NULL").select("doc_id", "event_type", "start", (F.col("start") + F.length("trigger")).alias("end"), "arguments")


def extraction_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Micro scores: triggers by span (TI), with type (TC), arguments by text (AI), with role (AC), and TC by type."""
    args = lambda d: d.select("doc_id", F.explode("arguments").alias("a")).select("doc_id", "a.role", "a.value")
    span = ["doc_id", "start", "end"]
    parts = [("TI", micro(gold, pred, span)), ("TC", micro(gold, pred, [*span, "event_type"])), ("AI", micro(args(gold), args(pred), ["doc_id", "value"])), ("AC", micro(args(gold), args(pred), ["doc_id", "role", "value"]))]
    out = micro(gold, pred, [*span, "event_type"], ["event_type"]).withColumn("metric", F.concat(F.lit("TC:"), "event_type")).drop("event_type")
    for name, part in parts:
        out = out.unionByName(part.withColumn("metric", F.lit(name)))
    return out


def distribution(rows: DataFrame, k: int = 15) -> DataFrame:
    """(what, name, n, covered) of labelled rows: the ``k`` commonest event types and roles, and whether a map covers them."""
    e = rows.select(F.explode("event_list").alias("e"))
    types = e.select(F.col("e.event_type").alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)
    roles = e.select(F.explode("e.arguments").alias("a")).select(F.col("a.role").alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)
    return types.select(F.lit("type").alias("what"), "name", "n", mapping.type_covered(F.col("name")).alias("covered")).unionByName(roles.select(F.lit("role").alias("what"), "name", "n", mapping.role_covered(F.col("name")).alias("covered")))
