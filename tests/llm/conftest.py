from __future__ import annotations

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import DOCS  # noqa: E402


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(5)


@pytest.fixture(scope="session")
def corpus(spark):
    """Small documents with copies, near copies, chains, blank and null texts, ties, repeated rows and clashing columns."""
    rng = np.random.default_rng(3)
    vocabulary = ["w%03d" % i for i in range(400)]
    make = lambda n: [vocabulary[i] for i in rng.integers(0, 400, n)]
    rows, base = [], None
    for i in range(160):
        if i % 4 == 0 or base is None:
            base = make(int(rng.integers(5, 120)))
            words = base
        elif i % 4 == 1:
            words = list(base)
        else:
            words = list(base)
            for _ in range(i % 4 - 1):
                words[int(rng.integers(0, len(words)))] = "x%d" % i
        rows.append((i, " ".join(words), "en" if i % 3 else "fr", "s%d" % (i % 3) if i % 2 else "hot", 7))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\n", "en", "hot", 3), (None, "only words here", "en", "s1", 9)]
    rows += [(5, rows[5][1], "en", "s1", 7), rows[6], (300, "Ü" * 50_000, "en", "s2", 1)]
    rows = [(*r, "clash", 3.5) for r in rows]
    frame = spark.createDataFrame(rows, DOCS + ", shard string, score double")
    return frame.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
