"""Results under the plans a large cluster would choose, and under hot keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import oracle
from reviewlens.operators import similarity as X
from reviewlens.operators.dedup import dedup_by_key, near_duplicates_to_drop
from reviewlens.operators import lookup as L
from reviewlens.operators.lookup import SALTS, salted_lookup
from test_similarity import brute_walk

SF = "/root/testdata/sf0.001"
SHUFFLED = ["q01", "q02", "q03", "q08", "q12", "q16", "rp08", "ai_report", "tx05", "sample_stratified_quota", "dedup_key_rejects",
            "en04_edit", "en06", "pr10", "sentiment_score", "tfidf_vectors"]


@pytest.mark.parametrize("name", SHUFFLED)
def test_without_broadcast_or_adaptive_plans(spark, name):
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        ok, message = oracle.compare(spark, oracle.duck(SF), name, SF)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ok, message


def test_salted_lookup_spreads_a_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.select("k").distinct().withColumn("v", F.length("k"))
    out = salted_lookup(rows, table, "k", F.xxhash64("id"))
    assert out.count() == 3000 and out.where("v IS NULL").count() == 0
    salts = rows.where("k = 'hot'").select(F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("s")).groupBy("s").count()
    assert salts.agg(F.max("count")).first()[0] < 3 * 1000 / SALTS


def test_only_frequent_keys_are_repeated(spark, monkeypatch):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.select("k").distinct().withColumn("v", F.length("k"))
    hot = L.frequent_keys(rows, "k")
    assert [r[0] for r in hot.collect()] == ["hot"]
    keys = table.where("k IS NOT NULL").count()
    assert L.repeated(table, hot, "k").where("k IS NOT NULL").count() == keys - 1 + SALTS
    for how, n in (("left", 60_000), ("inner", 40_000)):
        assert salted_lookup(rows, table, "k", F.xxhash64("id"), how).count() == n
    monkeypatch.setattr(L, "LEAST", 20_001)
    assert L.frequent_keys(rows, "k").isEmpty()


def test_a_family_of_copies_stays_linear(spark):
    """A third of the texts are equal, another third differ in one word; every one of them maps to its first member."""
    n = 600
    text = (
        F.when(F.col("id") % 3 == 0, "alpha beta gamma delta epsilon zeta eta theta")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("river stone cloud meadow forest valley mountain lake path "), F.concat(F.lit("w"), F.col("id") % 50)))
        .otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"p{k}x"), F.col("id")) for k in range(4)]))
    )
    docs = spark.range(n).select("id", text.alias("text"))
    threshold = 0.45  # the family shares 17 common terms and differs in two rare ones
    weights = X.tfidf(docs, 400, [])
    every = X.vectors(weights, threshold)
    assert X.smallest_neighbours(every, every, threshold).count() <= n  # one row per text, never one per pair
    pairs = {r["dup_id"]: r["principal_id"] for r in X.duplicate_map(docs, threshold, 400, []).collect()}
    assert pairs == brute_walk([tuple(r) for r in docs.collect()], threshold, 400)
    assert sum(d % 3 == 0 and p == 0 for d, p in pairs.items()) == n // 3 - 1
    assert sum(d % 3 == 1 and p == 1 for d, p in pairs.items()) == n // 3 - 1


def test_one_principal_behind_many_rows(spark):
    rows = spark.range(1, 901).select(F.col("id").alias("book_id"), F.when(F.col("id") % 2 == 0, "x").alias("a"))
    pairs = spark.range(2, 901).select(F.col("id").alias("dup_id"), F.lit(1).cast("long").alias("principal_id"))
    dropped = {r["book_id"] for r in near_duplicates_to_drop(rows, pairs).collect()}
    assert dropped == {1} | {i for i in range(2, 901) if i % 2}


def test_hot_key_dedup(spark):
    rows = spark.range(2000).select(F.col("id").alias("book_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"), F.when(F.col("id") == 1500, F.lit(None)).otherwise(F.col("id")).alias("v"))
    kept, rejected = dedup_by_key(rows, ["k"])
    assert sorted(r["book_id"] for r in kept.collect()) == [0, 1]
    assert rejected.count() == 1998
