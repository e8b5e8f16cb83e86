"""Rounding of the binary value, against Python's."""

import random

from pyspark.sql import functions as F

from eventloom.functions.numbers import exact_round, fixed


def test_the_binary_value_is_rounded(spark):
    values = [0.005, 0.015, 0.025, 0.125, 0.375, 0.0005, 0.00005, 2.675, 1.005, 0.995, 5e-7, 0.0, 1.0]
    rng = random.Random(3)
    values += [(k + 0.5) / 10**d for d in (2, 4, 6) for k in rng.sample(range(10**d), 90)] + [rng.random() for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[exact_round(F.col("v"), d).alias(f"r{d}") for d in (2, 4, 6)], fixed(F.col("v")).alias("t")).collect()
    assert [r.v for r in rows if r.t != f"{r.v:.2f}"] == []
    assert [(r.v, d) for r in rows for d in (2, 4, 6) if r[f"r{d}"] != float(f"{r.v:.{d}f}")] == []
