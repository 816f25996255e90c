"""Exact quantiles by selection: no task ever holds the distinct values.

The value of a rank is searched between two bounds. A round asks the quantile sketch of the rows between them for a few
values near the rank, then counts exactly how many rows are below each and equal to it. Either one of them has the rank, or
the bounds close in on it, by a factor of about the sketch's accuracy; what is left at the end is a short sorted list. The
sketch only proposes values, the counts decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.session import cut_lineage

ACCURACY = 10_000  # of the sketch, hence the factor by which a round narrows the search
SHORT_LIST = 10_000  # rows between two bounds that are sorted and read
FEW_VALUES = 20_000  # distinct values up to which the built-in percentile, one entry per value and task, is used


class _Search:
    """Where the value of one rank (from 0) is: between ``low`` and ``high`` (both excluded), ``below`` rows up to ``low``."""

    def __init__(self, rank: int, rows: int):
        self.rank, self.low, self.high = rank, None, None
        self.below, self.end = 0, rows  # rows up to low, rows below high
        self.value: float | None = None

    @property
    def inside(self) -> int:
        return self.end - self.below

    def holds(self, v: Column) -> Column:
        inside = v.isNotNull()
        if self.low is not None:
            inside = inside & (v > F.lit(self.low))
        if self.high is not None:
            inside = inside & (v < F.lit(self.high))
        return inside

    def proposals(self) -> list[float]:
        at = (self.rank - self.below + 0.5) / self.inside
        near = [at + side * step / ACCURACY for step in (0, 2, 20) for side in (-1, 1)]
        return sorted({min(max(p, 0.0), 1.0) for p in near})

    def narrow(self, found: list[tuple[float, int, int]]) -> None:
        """``found``: (value, rows below it, rows below it or equal to it) in order."""
        for value, less, upto in found:
            if upto <= self.rank:
                self.low, self.below = value, upto
            elif less > self.rank:
                self.high, self.end = value, less
                return
            else:
                self.value = value
                return


def _in_order(values: Iterable[float]) -> list[float]:
    """Distinct values in ascending order, not a number last; zero has no sign."""
    once = {str(x + 0.0): x + 0.0 for x in values}
    return sorted(once.values(), key=lambda x: (math.isnan(x), x))


def order_statistics(df: DataFrame, value: Column, ranks: list[int], rows: int) -> dict[int, float]:
    """The values of ``ranks`` (from 0, in ascending order, not numbers last) among ``rows`` rows whose value is not null.

    Two scans a round; ten thousand million rows take two rounds and a sorted list of at most 10,000 values.
    """
    v = F.col("v")
    kept = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    searches = [_Search(r, rows) for r in sorted(set(ranks))]
    while True:
        open_ = [s for s in searches if s.value is None and s.inside > SHORT_LIST]
        if not open_:
            break
        asked = kept.agg(*[
            F.percentile_approx(F.when(s.holds(v), v), s.proposals(), ACCURACY).alias(f"s{k}") for k, s in enumerate(open_)]).first()
        proposed = [_in_order(asked[k]) for k in range(len(open_))]
        every = _in_order(x for p in proposed for x in p)
        counts = kept.agg(*[c for k, x in enumerate(every) for c in (
            F.count_if(v < F.lit(x)).alias(f"l{k}"), F.count_if(v <= F.lit(x)).alias(f"u{k}"))]).first()
        known = {str(x): (x, counts[2 * k], counts[2 * k + 1]) for k, x in enumerate(every)}
        for s, p in zip(open_, proposed):
            s.narrow([known[str(x)] for x in p])
    for s in searches:
        if s.value is None:
            near = kept.where(s.holds(v)).orderBy("v").limit(s.rank - s.below + 1)
            s.value = near.agg(F.max("v")).first()[0]
    return {s.rank: s.value for s in searches}


def quantile_columns(df: DataFrame, value: Column, probabilities: list[float]) -> list[Column]:
    """Aggregates of ``df`` (as built-in percentiles, or as literals) with its exact quantiles, interpolated linearly.

    One scan counts; a column of few distinct values is then left to the built-in aggregate, whose memory it bounds.
    """
    v = value.cast("double")
    rows, values = df.agg(F.count(v), F.approx_count_distinct(v, 0.02)).first()
    if values <= FEW_VALUES:
        return [F.percentile(v, F.lit(q)) for q in probabilities]
    staged = cut_lineage(df.select(v.alias("v")).where("v IS NOT NULL"))
    places = [(rows - 1) * q for q in probabilities]
    found = order_statistics(staged, F.col("v"), [f(p) for p in places for f in (math.floor, math.ceil)], rows)
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        a, b = found[low], found[high]
        out.append(F.lit(a if low == high or a == b else (high - p) * a + (p - low) * b))
    return out
