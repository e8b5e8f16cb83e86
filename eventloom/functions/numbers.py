"""Number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_confidence(value: Column) -> Column:
    """A confidence in [0, 1]; null, NaN and what is no number count as 1."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 1.0).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def exact_round(value: Column, digits: int) -> Column:
    """Rounds the binary value of a double, exact ties to even (Spark's own functions round its shortest
    decimal text). The double is split in two halves so that its scaled remainder is exact."""
    scale = float(10**digits)
    spread = value * 134217729.0
    high = spread - (spread - value)
    low = value - high
    whole = F.floor(value * scale).cast("double")
    over = (high * scale - whole - 0.5) + low * scale  # the small half comes last: only an exact tie sums to zero
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    return (whole + F.when(up, 1.0).otherwise(0.0)) / scale


def fixed(value: Column, digits: int = 2) -> Column:
    """The number as text with so many digits, rounded as by ``exact_round``."""
    return F.format_string(f"%.{digits}f", exact_round(value, digits))
