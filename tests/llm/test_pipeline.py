"""The corpus pipeline stage by stage: every stage is held against a plain version of its rule on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from llm_helpers import components, shingles
from reviewlens.llm import decontaminate, langid
from reviewlens.llm.common import held_out, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The input of every stage, and the output of the last."""
    docs = table(spark, SF, "documents")
    extra = [(900_000, None, "en", "s", 0), (900_001, "", "en", None, 0), (900_002, "12 34 !!", None, "s", 8), (None, "only some words in here", "en", "s", 3)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).union(docs.where("doc_id IN (3, 4)"))
    out = []
    for name, step in [("input", None), *corpus_pipeline.STAGES]:
        found = docs if step is None else step(spark, out[-1], SF)
        path = str(tmp_path_factory.mktemp(name) / "out")
        found.write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_names_and_columns(inputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "source_weights", "shards"]
    for df in inputs[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_what_it_can_name(spark, inputs):
    from pyspark.sql import functions as F

    docs = inputs[0]
    learnt = langid.learn(langid.training_rows(docs.select("doc_id", "text", "lang"), held_out(F.col("doc_id"))))
    labeller = langid.Labeller(learnt[1])
    want = Counter()
    for row, n in rows(docs).items():
        text = row[1] or ""
        sums = labeller.pooled([text.encode()])[0]
        p = [2.718281828459045 ** float(x) for x in (sums[:-1] - sums[:-1].max()) / max(sums[-1], 1) ** 0.5]
        if any(c.isalpha() for c in text) and max(p) / sum(p) >= langid.LEAST_SCORE:
            want[row] += n
    assert rows(inputs[1]) == want


def test_one_of_every_group_of_near_duplicates_stays(inputs):
    before, after = rows(inputs[1]), rows(inputs[2])
    assert set(after) <= set(before) and set(after.values()) == {1}
    sets = {r: frozenset(shingles(r[1], 5)) for r in before}
    names = sorted(set(sets.values()), key=sorted)
    number = {s: k for k, s in enumerate(names)}
    edges = [(number[a], number[b]) for a in names for b in names if a and len(a) <= len(b) <= 1.25 * len(a) + 1 and len(a & b) >= 0.8 * len(a | b)]
    root = components(range(len(names)), edges)
    least = {}
    for r, s in sets.items():
        key = (r[0] is None, r[0] or 0)
        least[root[number[s]]] = min(key, least.get(root[number[s]], key))
    assert sorted((r[0] is None, r[0] or 0) for r in after) == sorted(least.values())


def test_leaks_go(spark, inputs):
    found = decontaminate.matches(inputs[2], table(spark, SF, "benchmark"))
    bad = {r.doc_id for r in found.collect()}
    items = [r.text for r in table(spark, SF, "benchmark").select("text").collect()]
    verbatim = {r[0] for r in rows(inputs[2]) if any(i and len(i.split()) >= 8 and i in (r[1] or "") for i in items)}
    assert verbatim <= bad
    assert rows(inputs[3]) == Counter({r: n for r, n in rows(inputs[2]).items() if r[0] not in bad})


def test_every_document_is_mixed_once_or_twice(inputs):
    before, after = rows(inputs[3]), rows(inputs[4])
    assert set(before) == set(after)
    assert all(before[r] <= n <= 2 * before[r] for r, n in after.items())


def test_shards_are_even_and_gapless(inputs):
    assert rows(inputs[5]) == rows(inputs[4])
    shards = {}
    for r in inputs[5].select("doc_id", "text", "shard", "slot", "size").collect():
        assert r.size == len((r.text or "").encode()) + 1
        shards.setdefault(r.shard, []).append((r.slot, r.size, r.text))
    total = sum(s for own in shards.values() for _, s, _ in own)
    largest = Counter()
    for own in shards.values():
        assert sorted(s for s, _, _ in own) == list(range(len(own)))
        for _, size, text in own:
            largest[text] += size
    assert all(abs(sum(s for _, s, _ in own) - total / 8) <= max(largest.values()) + 0.002 * total / 8 for own in shards.values())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"shard", "slot"} <= set(out.columns) and out.count() > 0
