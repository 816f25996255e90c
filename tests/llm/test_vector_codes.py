"""Vector codes against a plain Lloyd loop, and against SQL on the given table."""

from __future__ import annotations

import hashlib
import math

import pytest

import oracle
from reviewlens.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, row string, entry double"


def plain(rows, entries=16, rounds=6):
    """[(vec_id, code, error, label_error)], digest of the books."""
    good = [(i, [math.floor(min(max(4096 * x, -(1 << 24)), 1 << 24)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    if not good:
        return [], None
    length = len(min(good, key=order)[1])
    good = [r for r in good if len(r[1]) == length]
    width = -(-length // 8)
    good = [(i, v + [0] * (8 * width - length), label) for i, v, label in good]
    start = {}
    for i, v, _ in sorted(good, key=order):
        start.setdefault(i, v)
    start = list(start.values())[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in start] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(start)), key=lambda e: (gap(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(8):
            found = [near(v, p) for _, v, _ in good]
            new.append([])
            for e in range(len(start)):
                own = [cut(v, p) for (_, v, _), f in zip(good, found) if f == e]
                new[p].append([sum(c) // len(own) for c in zip(*own)] if own else books[p][e])
        books = new
    out, totals = [], {}
    for i, v, label in good:
        code = [near(v, p) for p in range(8)]
        error = sum(gap(cut(v, p), books[p][e]) for p, e in enumerate(code))
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return sorted([(i, c, e, totals[label]) for i, c, e, label in out], key=str), digest


def check(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "clash", 1.5) for r in rows], SCHEMA).repartition(3)
    learnt = vector_codes.learn_codes(frame, keep=("label",), **options)
    found = vector_codes.label_errors(learnt)
    assert found.columns == ["vec_id", "code", "error", "label_error"]
    want, digest = plain(rows)
    assert sorted([tuple(r) for r in found.collect()], key=str) == want
    if want:
        assert learnt.fingerprint == digest


@pytest.mark.parametrize("owned", [1 << 16, 20])
def test_codes_equal_a_plain_loop(spark, rng, owned):
    vectors = rng.normal(size=(6, 16))[rng.integers(0, 6, 250)] + 0.2 * rng.normal(size=(250, 16))
    rows = [(int(i), [float(x) for x in v.astype("f4")], int(rng.integers(0, 3)) if i % 5 else None) for i, v in enumerate(vectors)]
    rows += rows[:30] + [(None, rows[0][1], 1), (5, rows[9][1], 2)]
    rows += [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [float("nan")] * 16, 1), (903, [float("-inf")] * 16, None), (904, [1.0], 1)]
    rows += [(905, [1e30] * 16, 1), (-3, [-0.0001] * 16, 2)]
    check(spark, rows, owned=owned)


@pytest.mark.parametrize("rows", [
    [], [(1, None, 1)], [(1, [], 1), (2, [], 2)], [(None, [0.5] * 8, None)] * 3, [(4, [0.1] * 11, 1), (3, [0.2] * 11, 1), (3, [0.1] * 11, 1)],
    [(i, [float(i % 2)] * 8, 1) for i in range(40)]])
def test_little_or_equal_vectors(spark, rows):
    check(spark, rows)


def test_only_changed_parts_are_shuffled(spark, rng):
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)], 1, "", 0.0) for i in range(400)], SCHEMA)
    seen = []
    whole = vector_codes._to_owners

    def counted(movers, salts):
        seen.append(movers.count())
        return whole(movers, salts)

    vector_codes._to_owners = counted
    try:
        vector_codes.learn_codes(frame)
    finally:
        vector_codes._to_owners = whole
    assert seen[0] == 8 * 400 and len(seen) == 6 and all(n < seen[0] / 2 for n in seen[1:])


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, message = oracle.compare(spark, oracle.duck(sf), "op11_vector_codes", sf)
    assert ok, message
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = plain(given)
    found = oracle.entry.queries()["op11_vector_codes"](spark, sf).collect()
    assert sorted([tuple(r)[:4] for r in found], key=str) == want and {r[4] for r in found} == {digest}
