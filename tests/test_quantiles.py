from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import profile as P
from reviewlens.operators import quantiles as Q


def plain(values, q):
    found = sorted((v for v in values if v is not None), key=lambda x: (math.isnan(x), x))
    at = (len(found) - 1) * q
    low, high = math.floor(at), math.ceil(at)
    a, b = found[low], found[high]
    return a if low == high or a == b else (high - at) * a + (at - low) * b


def told(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


CASES = {
    "ties": [float(v % 7) for v in range(400)] + [None] * 5,
    "one value": [2.5] * 300,
    "wide": [10.0 ** (v % 300) * (-1) ** v for v in range(900)],
    "odd": [float("nan")] * 3 + [float("inf"), float("-inf"), 0.0, -0.0] * 40 + [float(v) for v in range(90)],
    "single": [1.0],
}


@pytest.mark.parametrize("name", list(CASES))
def test_selection_equals_a_sorted_list(spark, monkeypatch, name):
    monkeypatch.setattr(Q, "FEW_VALUES", -1)
    monkeypatch.setattr(Q, "SHORT_LIST", 3)
    monkeypatch.setattr(Q, "ACCURACY", 20)
    rows, ps = told(spark, CASES[name]), [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = rows.agg(*Q.quantile_columns(rows, F.col("x"), ps)).first()
    assert [str(x + 0.0) for x in got] == [str(plain(CASES[name], p) + 0.0) for p in ps]


def test_many_distinct_values(spark):
    n = 3_000_000
    rows = spark.range(n).select(((F.col("id") * 7919 % n) / 13.0).alias("x"))
    values = np.arange(n) * 7919 % n / 13.0
    jobs = []
    whole = Q.order_statistics
    try:
        Q.order_statistics = lambda df, v, ranks, total: jobs.append(total) or whole(df, v, ranks, total)
        summary = P.numeric_summary(rows, "x")
    finally:
        Q.order_statistics = whole
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert jobs == [n] and "percentile" not in plan
    got = summary.first()
    assert [got["q25"], got["median"], got["q75"]] == [plain_sorted(np.sort(values), p) for p in (0.25, 0.5, 0.75)]


def plain_sorted(values, q):
    at = (len(values) - 1) * q
    low, high = math.floor(at), math.ceil(at)
    return values[low] if low == high else (high - at) * values[low] + (at - low) * values[high]


def test_nothing(spark):
    rows = told(spark, [None, None])
    assert tuple(P.numeric_summary(rows, "x").first()) == (0, *[None] * 7)
