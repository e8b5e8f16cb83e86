"""Causal relations between the events of each graph, by narrative order and cue words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.functions import text as tx
from eventloom.functions.numbers import exact_round
from eventloom.operators import numbering

EDGE = ["graph_id", "edge_ord", "relation_id", "cause_event_id", "effect_event_id", "relation_type", "evidence", "confidence", "time_lag"]


def _blob(kind: Column, mention: Column) -> Column:
    return F.concat(F.coalesce(kind, F.lit("")), F.coalesce(mention, F.lit("")))


def is_distractor(kind: Column, mention: Column, pattern: str = lx.DISTRACTOR) -> Column:
    """Routine drills and the like."""
    return _blob(kind, mention).rlike(pattern)


def is_noncausal(kind: Column, mention: Column) -> Column:
    """Digests, conflicting sources and background."""
    return F.coalesce(kind, F.lit("")).rlike(lx.NONCAUSAL_TYPE) | _blob(kind, mention).rlike(lx.NONCAUSAL_TEXT)


def cue_sentence(effect_text: Column, cause_type: Column, cause_trigger: Column, cues: list[str] | None = None, end: str | None = None, least: int = 1) -> Column:
    """The first sentence of the effect with a cue word and the cause's type or trigger, or null."""
    sentences = tx.simple_sentences(effect_text, least)

    def named(s: Column) -> Column:
        has = lambda w: (F.length(w) >= 2) & F.contains(s, w)
        return F.coalesce(has(cause_type), F.lit(False)) | F.coalesce(has(cause_trigger), F.lit(False))

    return F.try_element_at(F.filter(sentences, lambda s: tx.any_of(s, cues or lx.CAUSAL_CUES) & named(s)), F.lit(1))


def narrative(nodes: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """``nodes`` with ``pos``, their place by the digits that end the id, then by node_ord; ``large`` graphs are numbered by ranges."""
    dated = nodes.withColumn("_digits", tx.trailing_number(F.col("event_id")))
    return numbering.placed(dated, "graph_id", ["_digits", "node_ord"], "pos", large).drop("_digits")


def _arrow(*, types: bool = True) -> Column:
    named = lambda side: F.concat(F.col(f"{side}.event_id").cast("string"), F.lit("（"), F.coalesce(F.nullif(F.col(f"{side}.event_type"), F.lit("")), F.col(f"{side}.trigger"), F.lit("")), F.lit("）"))
    return F.concat(named("a"), F.lit(" → "), named("b")) if types else F.concat(F.col("a.event_id").cast("string"), F.lit(" → "), F.col("b.event_id").cast("string"))


def pairs(nodes: DataFrame, reach: int = 3, large: DataFrame | None = None) -> DataFrame:
    """(graph_id, a, b, distance): main events and those up to ``reach`` places on. Places count distractors.

    One shuffle by graph serves the numbering and the look ahead; ``large`` graphs are numbered by ranges and looked
    ahead in by blocks with a few rows of the next.
    """
    own = F.struct("event_id", "event_type", "trigger", "mention", "skipped")
    skipped = is_distractor(F.col("event_type"), F.col("mention")) | is_noncausal(F.col("event_type"), F.col("mention"))
    looked = numbering.ahead(narrative(nodes, large).withColumn("skipped", skipped), "graph_id", "pos", own, reach).select("graph_id", "pos", own.alias("a"), "ahead")
    return looked.where(~F.col("a.skipped")).select("graph_id", "pos", "a", F.explode("ahead").alias("x")).select("graph_id", "pos", "a", "x.b", "x.distance").where(F.col("b").isNotNull() & ~F.col("b.skipped"))


def by_order(nodes: DataFrame) -> DataFrame:
    """Relations of neighbours: direct at distance 1, indirect at 2, and at 3 where a sentence has a direct cue."""
    large = numbering.large(nodes, "graph_id")
    cued = pairs(nodes, large=large).withColumn("cue", cue_sentence(F.col("b.mention"), F.col("a.event_type"), F.col("a.trigger")))
    kept = cued.where((F.col("distance") <= 2) | tx.any_of(F.col("cue"), lx.DIRECT_CUES))
    near = F.col("distance") == 1
    base = F.when(near, lx.DIRECT_CONFIDENCE).otherwise(lx.INDIRECT_CONFIDENCE)
    raised = F.when(F.col("cue").isNotNull(), F.least(base + lx.CUE_BOOST, F.lit(lx.MOST_CONFIDENCE))).otherwise(base)
    return numbering.placed(kept, "graph_id", ["pos", "distance"], "edge_ord", large).select(
        "graph_id", "edge_ord", F.format_string("R%03d", F.col("edge_ord")).alias("relation_id"),
        F.col("a.event_id").alias("cause_event_id"), F.col("b.event_id").alias("effect_event_id"),
        F.when(near, lx.DIRECT).otherwise(lx.INDIRECT).alias("relation_type"), F.array(F.coalesce("cue", _arrow())).alias("evidence"),
        exact_round(raised, 2).alias("confidence"), F.when(near, "immediate").otherwise("delayed").alias("time_lag"),
    )


def staged(nodes: DataFrame) -> DataFrame:
    """Main events of graphs whose first ten carry the ten stage labels in order, with their ``place``."""
    main = nodes.where(~(is_distractor(F.col("event_type"), F.col("mention")) | is_noncausal(F.col("event_type"), F.col("mention"))))
    placed = narrative(main, numbering.large(main, "graph_id")).withColumnRenamed("pos", "place")
    right = (F.col("place") <= 10) & (F.col("event_type") == F.element_at(F.array(*map(F.lit, lx.STAGES)), F.least(F.col("place"), F.lit(10)).cast("int")))
    fits = placed.where(right).groupBy("graph_id").agg(F.count("*").alias("_right")).where("_right = 10")
    return placed.join(fits.select("graph_id"), "graph_id", "left_semi")


def by_template(stages: DataFrame) -> DataFrame:
    """The fixed edges between the ten stages, then an edge from each later main event's predecessor."""
    spark = stages.sparkSession
    own = stages.select("graph_id", "place", F.struct("event_id", "event_type", "trigger").alias("e"))
    fixed = spark.createDataFrame([(i, c, e, conf) for i, (c, e, conf) in enumerate(lx.STAGE_EDGES, 1)], "no long, cause int, effect int, confidence double")
    later = own.where("place > 10").select("graph_id", (F.col("place") + 2).cast("long").alias("no"), (F.col("place") - 1).alias("cause"), F.col("place").alias("effect"), F.lit(lx.DIRECT_CONFIDENCE).alias("confidence"))
    wanted = own.select("graph_id").distinct().join(F.broadcast(fixed)).unionByName(later)
    a, b = (own.select("graph_id", F.col("place").alias(side), F.col("e").alias(x)) for side, x in (("cause", "a"), ("effect", "b")))
    near = F.col("confidence") >= lx.DIRECT_CONFIDENCE
    return wanted.join(a, ["graph_id", "cause"]).join(b, ["graph_id", "effect"]).select(
        "graph_id", F.col("no").alias("edge_ord"), F.format_string("R%03d", F.col("no")).alias("relation_id"),
        F.col("a.event_id").alias("cause_event_id"), F.col("b.event_id").alias("effect_event_id"),
        F.when(near, lx.DIRECT).otherwise(lx.INDIRECT).alias("relation_type"),
        F.array(F.when(F.col("no") <= len(lx.STAGE_EDGES), _arrow()).otherwise(_arrow(types=False))).alias("evidence"),
        "confidence", F.when(near, "immediate").otherwise("delayed").alias("time_lag"),
    )


def relations(nodes: DataFrame) -> DataFrame:
    """Relations of every graph: by the template where it fits, by order elsewhere."""
    stages = staged(nodes)
    rest = nodes.join(stages.select("graph_id").distinct(), "graph_id", "left_anti")
    return by_template(stages).select(*EDGE).unionByName(by_order(rest).select(*EDGE))
