"""Graphs merged from streams against building them at once."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import graph as gr
from eventloom.sources import schemas as sc
from eventloom.streaming import graphs as st


def records(rng, n):
    """Nodes' and edges' records with repeats, empty fields, ties, loops, reverses and dangling ends."""
    pick = lambda *values: rng.choice(values)
    nodes = [(pick("g", "h"), i, pick("A", "B", "C", "D"), "d", pick("", "k", "l"), pick("", "t", None), pick("", "mm", "nn", "long mention", None), [("r", "v")] * pick(0, 0, 1, 2), pick("", "2020", "2021"), pick("", "X"), None, pick(None, 0.2, 0.9)) for i in range(n)]
    edges = [(pick("g", "h"), i, pick("", f"R{i}x"), pick("A", "B", "C", "Z"), pick("A", "B", "C", "D"), "causal", [str(i)], pick(None, 0.25, 0.5, 0.75), "") for i in range(n)]
    return nodes, edges


def replay(spark, rows, ddl, folder, merge, path, size):
    """The rows streamed in batches of ``size`` in their order, the query stopped and started again after each."""
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], ddl).coalesce(1).write.mode("append").json(f"{folder}/{path}-in", ignoreNullFields=False)
        st.started(merge(spark.readStream.schema(ddl).json(f"{folder}/{path}-in")), f"{folder}/{path}", available_now=True).awaitTermination()


def plain(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_replayed_records_end_in_the_same_graph(spark, tmp_path):
    nodes, edges = records(random.Random(3), 60)
    replay(spark, nodes, sc.NODE_DDL, tmp_path, st.merged_nodes, "nodes", 20)
    replay(spark, edges, sc.EDGE_DDL, tmp_path, st.merged_edges, "edges", 20)
    got_nodes, got_edges = st.current_graph(spark, f"{tmp_path}/nodes", f"{tmp_path}/edges")
    want_nodes, want_edges = gr.build(spark.createDataFrame(nodes, sc.NODE_DDL), spark.createDataFrame(edges, sc.EDGE_DDL))
    assert plain(got_nodes) == plain(want_nodes)
    assert plain(got_edges) == plain(want_edges) and got_edges.count() > 4


def test_edges_in_any_order_and_a_batch_written_twice(spark, tmp_path):
    _, edges = records(random.Random(4), 40)
    mixed = random.Random(1).sample(edges, len(edges))
    replay(spark, mixed, sc.EDGE_DDL, tmp_path, st.merged_edges, "edges", 20)
    rows = f"{tmp_path}/edges/rows"
    before = plain(st.current(spark, f"{tmp_path}/edges", st.EDGE_KEYS, sc.EDGE_DDL))
    assert before == plain(gr.strongest(spark.createDataFrame(edges, sc.EDGE_DDL)))
    again = spark.read.schema(sc.EDGE_DDL).parquet(f"{rows}/batch=1").persist()
    again.count()
    again.write.mode("overwrite").parquet(f"{rows}/batch=1")
    assert plain(st.current(spark, f"{tmp_path}/edges", st.EDGE_KEYS, sc.EDGE_DDL)) == before


@pytest.mark.parametrize("ddl,merge,keys", [(sc.NODE_DDL, st.merged_nodes, st.NODE_KEYS), (sc.EDGE_DDL, st.merged_edges, st.EDGE_KEYS)])
def test_nothing_and_nulls(spark, tmp_path, ddl, merge, keys):
    schema = sc._ddl(ddl)
    spark.createDataFrame([(None,) * len(schema)], ddl).write.json(f"{tmp_path}/in", ignoreNullFields=False)
    st.started(merge(spark.readStream.schema(ddl).json(f"{tmp_path}/in")), f"{tmp_path}/out", available_now=True).awaitTermination()
    got = st.current(spark, f"{tmp_path}/out", keys, ddl)
    assert got.count() == 0 and got.columns == [f.name for f in schema] and got.where(F.lit(True)).schema.simpleString() == schema.simpleString()


def test_nodes_in_any_order_of_arrival(spark, tmp_path):
    """Fields that others fill come out as in the batch form, whichever batch their record was in; no rows pass through Python."""
    nodes, _ = records(random.Random(6), 40)
    mixed = random.Random(2).sample([n if n[11] is not None else (*n[:11], 0.0) for n in nodes], len(nodes))
    replay(spark, [*mixed, *mixed[:9]], sc.NODE_DDL, tmp_path, st.merged_nodes, "nodes", 17)
    got = st.current(spark, f"{tmp_path}/nodes", st.NODE_KEYS, sc.NODE_DDL)
    assert plain(got) == plain(gr.merge_nodes(spark.createDataFrame(nodes, sc.NODE_DDL)))
    plan = st.merged_nodes(spark.readStream.schema(sc.NODE_DDL).json(f"{tmp_path}/nodes-in"))._jdf.queryExecution().logical().toString()
    assert "Pandas" not in plan
