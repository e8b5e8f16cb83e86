"""The registered queries against their SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from eventloom.plans import lexical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda x: "null" if x is None or x is pd.NA or (not isinstance(x, (list, tuple)) and pd.isna(x)) else f"{x:.6f}" if isinstance(x, float) else str(x)
    floats = {c for c in df if df[c].dtype.kind == "f"}
    return sorted(tuple((f"{float(v):.6f}" if c in floats and not pd.isna(v) else show(v)) for c, v in zip(df.columns, row, strict=True)) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


CORE = [
    "sentence_split_offsets", "first_trigger", "rule_extraction", "narrative_pairs", "node_merge", "clean_graph", "graph_stats", "best_paths_k", "root_chains", "cascade", "necessity_sufficiency", "scenario_tree",
    "likely_terminal", "anchor_match", "confidence_calibration", "micro_prf", "token_f1", "line_answers", "branching_answers", "pack_branches", "pack_stages", "pack_summaries", "digest_extraction", "streamed_graph", "streamed_nodes", *lexical.QUERIES,
]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and plain(got) == plain(want)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["graph_id", "event_id", "rank", "cause", "rids", "p"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
