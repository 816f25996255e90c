from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    # One stratum holds more than half of all rows, one stratum is NULL.
    stratum = F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7))
    return spark.range(3000).select("id", stratum.alias("kind"), F.rand(3).alias("x"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("n", [0, 1, 7, 299, 2999, 3000, 5000])
def test_exact_size(rows, n):
    got = ids(S.take_sample(rows, n, ["id"]))
    assert len(got) == len(set(got)) == min(n, 3000)


def test_same_rows_under_another_partitioning_and_other_rows_for_another_seed(rows):
    a = ids(S.take_sample(rows, 100, ["id"]))
    assert a == ids(S.take_sample(rows.repartition(7, "x"), 100, ["id"]))
    assert a != ids(S.take_sample(rows, 100, ["id"], seed=7))


def test_sample_is_the_smallest_hashes(rows):
    ordered = [r["id"] for r in rows.orderBy(F.xxhash64(F.lit(42), "id")).select("id").collect()]
    assert sorted(ordered[:123]) == ids(S.take_sample(rows, 123, ["id"]))


@pytest.mark.parametrize("digest", ["xxhash64", "md5"])
@pytest.mark.parametrize("n", [1, 123, 2999])
def test_large_ranges_are_counted_again(rows, monkeypatch, digest, n):
    whole = ids(S.take_sample(rows, n, ["id"], digest=digest))
    monkeypatch.setattr(S, "BUCKET_BITS", 4)
    monkeypatch.setattr(S, "ROWS_PER_BUCKET", 3)
    assert ids(S.take_sample(rows, n, ["id"], digest=digest)) == whole and len(whole) == n
    some = S.sample_stratified(rows, 200, "kind", ["id"], digest=digest)
    monkeypatch.undo()
    assert ids(some) == ids(S.sample_stratified(rows, 200, "kind", ["id"], digest=digest))


def test_md5_order_is_that_of_the_hexadecimal_digits(rows):
    told = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()[:15]
    assert ids(S.take_sample(rows, 123, ["id"], digest="md5")) == sorted(sorted(range(3000), key=told)[:123])
    with pytest.raises(ValueError):
        S.take_sample(rows, 5, ["id"], digest="crc32")


@pytest.mark.parametrize("percent", [1, 10, 33, 100])
def test_percent(rows, percent):
    assert len(ids(S.sample_percent(rows, percent, ["id"]))) == round(3000 * percent / 100)


@pytest.mark.parametrize("percent", [0, 101, -1])
def test_percent_out_of_range(rows, percent):
    with pytest.raises(ValueError):
        S.sample_percent(rows, percent, ["id"])


@pytest.mark.parametrize("per_bucket", [100_000, 20])
def test_stratified_quotas(rows, monkeypatch, per_bucket):
    monkeypatch.setattr(S, "ROWS_PER_BUCKET", per_bucket)
    picked = S.sample_stratified(rows, 200, "kind", ["id"])
    got = {r["kind"]: r["n"] for r in picked.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    size = {r["kind"]: r["n"] for r in rows.groupBy(F.coalesce("kind", F.lit("missing")).alias("kind")).agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 200
    for kind, n in size.items():
        assert got[kind] in (200 * n // 3000, 200 * n // 3000 + 1)
    # Within a stratum the smallest hashes are taken.
    hot = [r["id"] for r in rows.where("kind = 'hot'").orderBy(F.xxhash64(F.lit(42), "id")).limit(got["hot"]).collect()]
    assert sorted(hot) == ids(picked.where("kind = 'hot'"))


def test_stratified_whole_input_and_fallbacks(spark, rows):
    assert len(ids(S.sample_stratified(rows, 3000, "kind", ["id"]))) == 3000
    assert len(ids(S.sample_stratified(rows, 50, "absent", ["id"]))) == 50
    lonely = rows.select("id", F.when(F.col("id") == 5, "alone").otherwise("rest").alias("kind"))
    assert len(ids(S.sample_stratified(lonely, 50, "kind", ["id"]))) == 50  # a stratum with one row
    many = rows.select("id", (F.col("id") % 1000).alias("kind"))
    assert len(ids(S.sample_stratified(many, 50, "kind", ["id"]))) == 50  # more strata than rows to draw


def test_reviews_of_sample_matches_null_titles(spark):
    reviews = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "review_id int, title string")
    books = spark.createDataFrame([("a",), (None,), ("a",)], "title string")
    got = sorted(r["review_id"] for r in S.reviews_of_sample(reviews, books).collect())
    assert got == [1, 2]


def test_pair_modes(spark, rows):
    books = rows.select(F.col("id").alias("book_id"), F.concat(F.lit("t"), "id").alias("title"), "kind")
    reviews = spark.range(9000).select(F.col("id").alias("review_id"), F.concat(F.lit("t"), F.col("id") % 3000).alias("title"))
    b, r = S.sample_pair(books, reviews, mode="fixed", sample_size=60, stratify_column="kind")
    assert b.count() == 60 and r.count() == 180
    b, r = S.sample_pair(books, reviews)
    assert b.count() == 150 and r.count() == 180
    assert S.sample_pair(books, reviews, use_sample=False) == (books, reviews)
    with pytest.raises(ValueError):
        S.sample_pair(books, reviews, mode="other")


def test_before_scoring(rows):
    assert len(ids(S.sample_before_scoring(rows, ["id"], frac=0.1))) == 300
    assert len(ids(S.sample_before_scoring(rows, ["id"], n=17))) == 17
    assert len(ids(S.sample_before_scoring(rows, ["id"]))) == 3000
