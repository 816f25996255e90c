"""Numeric helpers whose results do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Polarity is summed as whole millionths: a long sum is exact, order-free and stays in hash aggregation.
POLARITY_SCALE = 1_000_000


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value, returned as double."""
    return F.round(value.cast("decimal(30,12)"), digits).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL when whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.lit(100.0) * part.cast("double") / whole.cast("double"))


def polarity_units(compound: Column) -> Column:
    return F.round(compound.cast("double") * POLARITY_SCALE).cast("long")


def polarity_mean(units_sum: Column, count: Column) -> Column:
    return F.when(count > 0, units_sum.cast("double") / F.lit(float(POLARITY_SCALE)) / count.cast("double"))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")), F.lit(0).cast("long"))
