"""How sides of joins travel: by the size of their rows, not of their files."""

import re

from pyspark.sql import functions as F

from eventloom.operators import analytics
from eventloom.plans import graphs
from eventloom.sources import storage
from eventloom.sources.storage import kept


def _joins(df):
    again = df.groupBy().count()
    again.collect()
    return re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", again._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])


def test_well_compressed_rows_are_not_broadcast(spark, tmp_path):
    spark.range(300_000).select("id", F.concat(F.lit("x" * 60), F.col("id") % 7).alias("t")).write.parquet(f"{tmp_path}/events.parquet")
    e = graphs.table(spark, str(tmp_path), "events")
    big = kept(e, "big").join(e.groupBy("id").count(), "id").select("id", "t")
    assert _joins(e.join(big.withColumnRenamed("t", "u"), "id").where("length(concat(t, u)) > 9"))[0] == "SortMergeJoin"
    few = e.where("id < 10").select("id", F.upper("t").alias("v"))
    assert "BroadcastHashJoin" in _joins(e.join(few, "id").where("length(concat(t, v)) > 9"))


def test_ranks_of_many_graphs_stay_out_of_the_driver(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"g{g}", f"n{n}") for g in range(30) for n in range(3)], "graph_id string, event_id string")
    edges = spark.createDataFrame([(f"g{g}", f"n{n}", f"n{(n + 1 + g % 2) % 3}", 0.5) for g in range(30) for n in range(3)], "graph_id string, cause_event_id string, effect_event_id string, confidence double")
    few = sorted(analytics.pagerank_steps(nodes, edges, 3).collect())
    monkeypatch.setattr(analytics, "FEW_GRAPHS", 20)
    assert sorted(analytics.pagerank_steps(nodes, edges, 3).collect()) == few
    weights = kept(analytics._weights(edges), "rank-weights")
    rank = analytics._first(nodes, weights)
    assert set(_joins(analytics._step(rank, weights, 0.85, many=analytics._many(rank)).where("r > before OR before IS NULL"))) == {"SortMergeJoin"}


def test_broadcasts_of_one_plan_stay_small_together(spark, tmp_path):
    spark.range(60_000).select("id", F.concat(F.lit("x" * 20), F.col("id") % 7).alias("t")).write.parquet(f"{tmp_path}/events.parquet")
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "10485760b"), ("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")):
        spark.conf.set(name, value)
    e = graphs.table(spark, str(tmp_path), "events")
    sides = [kept(e.select("id", F.upper("t").alias(f"t{i}")), "side") for i in range(3)]  # 3 MB of rows each
    out = e
    for side in sides:
        out = out.join(side, "id")
    assert set(_joins(out.where("length(concat(t, t0, t1, t2)) > 9"))) == {"SortMergeJoin"}


def test_a_smaller_bound_of_the_session_stays(spark):
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for given, after in (("256k", 256 << 10), ("10485760b", storage.BROADCAST), ("1g", storage.BROADCAST), ("-1", -1), ("4096", 4096)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "7m")
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", given)
            storage.joined_by_measure(spark)
            assert int(spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold").rstrip("b")) == after
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_tasks_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")
    before = {c: spark.conf.get(c, None) for c in names}
    monkeypatch.setattr(storage, "PARTITION_ROWS", 5_000)
    monkeypatch.setattr(storage, "TASK_BYTES", 64 << 10)
    try:
        spark.conf.set(names[2], "false")
        tasks = []
        for rows in (20_000, 200_000):
            folder = tmp_path / str(rows)
            spark.range(rows).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).write.parquet(f"{folder}/events.parquet")
            seen = graphs.table(spark, str(folder), "events").groupBy("t").agg(F.max("id").alias("id")).groupBy(F.spark_partition_id()).count().collect()
            tasks.append((len(seen), max(r["count"] for r in seen)))
        assert tasks[1][0] > 4 and tasks[1][1] < 3 * tasks[0][1]
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
