"""Scores to levels and to calibrated confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import lexicons as lx
from eventloom.functions.numbers import exact_round


def _steps(score: Column, steps: list[tuple[float, str]], last: str | None = None) -> Column:
    return reduce(lambda c, s: c.when(score >= s[0], s[1]), steps, F.when(F.lit(False), "")).otherwise(F.lit(last))


def level(score: Column) -> Column:
    """certain, probable, possible, low or null."""
    return F.when(score.isNotNull(), F.coalesce(_steps(score, [(0.85, "certain"), (0.6, "probable"), (0.35, "possible")]), F.when(score > 0.05, "low")))


def level_for(kind: Column, score: Column) -> Column:
    """The level by the habits of each kind of question; null for a null score."""
    tail = F.when(score > 0.05, "low")
    single = _steps(score, [(0.6, "certain"), (0.4, "probable"), (0.25, "possible")])
    multi = F.coalesce(_steps(score, [(0.85, "high"), (0.6, "probable"), (0.35, "possible")]), tail)
    grounded = F.coalesce(_steps(score, [(0.6, "probable"), (0.35, "possible")]), tail)
    counter = _steps(score, [(0.55, "probable"), (0.4, "medium"), (0.25, "possible")], "low")
    by_kind = F.when(kind == "single_hop", single).when(kind.isin("multi_hop_causal", "temporal_causal"), multi).when(kind == "grounded_pred", grounded).when(kind == "counterfactual", counter).otherwise(level(score))
    return F.when(score.isNotNull(), by_kind)


def confidence(kind: Column, score: Column) -> Column:
    """The expected share of right answers: by the score's bucket, else the highest bucket below it,
    else the kind's base, else the score itself in [0.1, 0.6]; all in [0.05, 0.85]."""
    s = score.try_cast("double")
    rounded = exact_round(s, 1)
    table = F.create_map(*[x for k, bs in lx.CALIBRATION.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(b).alias("b"), F.lit(v).alias("v")) for b, v in bs.items()]))])
    buckets = F.try_element_at(table, kind)
    exact = F.try_element_at(F.filter(buckets, lambda x: x["b"] == rounded), F.lit(1))["v"]
    below = F.array_max(F.filter(buckets, lambda x: x["b"] <= s))["v"]
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in lx.CALIBRATION_BASE.items() for x in kv]), kind)
    value = F.coalesce(exact, below, base, F.greatest(F.lit(0.1), F.least(F.lit(0.6), s)))
    clamped = F.least(F.lit(0.85), F.greatest(F.lit(0.05), value))
    return F.when(s.isNotNull(), exact_round(clamped, 3))
