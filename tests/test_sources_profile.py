from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reviewlens import schemas
from reviewlens.operators import dedup as D
from reviewlens.operators import profile as P
from reviewlens.plans.preparation import clean_books, clean_reviews, standardise_books
from reviewlens.session import scratch_path, shared_dir
from reviewlens.sources import files, serving

TRICKY = [("plain", "a"), ('quote " inside', None), ("line\nbreak, comma", " padded "), ("back\\slash", "é")]


def test_csv_keeps_quotes_breaks_and_padding(spark, tmp_path):
    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    frame = spark.createDataFrame(TRICKY, schema)
    path = files.write_csv(frame, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, path, schema).collect()), key=str) == sorted(TRICKY, key=str)
    stage = files.csv_to_parquet(spark, path, str(tmp_path / "stage"), schema, "row_id")
    assert stage.select("row_id").distinct().count() == 4
    assert stage.schema["row_id"].dataType.typeName() == "long"


def test_json_and_partitioned_parquet(spark, tmp_path):
    frame = spark.createDataFrame(TRICKY, "a string, b string")
    assert files.read_json(spark, files.write_json(frame, str(tmp_path / "j")), frame.schema).count() == 4
    files.write_parquet(frame, str(tmp_path / "p"), partition_by=["b"])
    assert files.read_parquet(spark, str(tmp_path / "p")).where("b = 'a'").count() == 1


def test_public_file_columns_are_renamed(spark):
    frame = spark.createDataFrame([], schemas.REVIEWS_CSV)
    assert {"title", "user_id", "score", "text"} <= set(schemas.with_standard_names(frame).columns)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_load_time_cleaning(spark):
    rows = [(i, [" nan ", "None", "null", "", "  ok\t"][i % 5], "x" if i < 9 else None, "y" if i < 10 else None) for i in range(100)]
    frame = spark.createDataFrame(rows, "i int, note string, nine string, ten string")
    assert serving.drop_sparse_columns(frame).columns == ["i", "note", "ten"]
    cleaned = serving.clean_strings(frame).groupBy("note").count().collect()
    assert {r["note"]: r["count"] for r in cleaned} == {None: 80, "ok": 20}
    assert serving.clean_for_load(frame.union(frame)).count() == 100


def test_tables_are_loaded_skipped_appended_and_refused(spark, tmp_path):
    stage = files.write_parquet(spark.range(5).withColumn("s", F.lit(" v ")), str(tmp_path / "stage"))
    empty = files.write_parquet(spark.range(0), str(tmp_path / "empty"))
    inputs = {"served_t": stage, "served_absent": str(tmp_path / "nope"), "served_empty": empty}
    assert serving.load_tables(spark, inputs, location=str(tmp_path / "wh")) == ["served_t"]
    assert {r["s"] for r in spark.table("served_t").collect()} == {"v"}
    serving.load_tables(spark, {"served_t": stage}, "append")
    assert spark.table("served_t").count() == 10
    with pytest.raises(AnalysisException):
        serving.load_tables(spark, {"served_t": stage}, "fail")
    health = {r["table_name"]: r for r in serving.table_health(spark, ("served_t", "books_data_processed_x")).collect()}
    assert (health["served_t"]["rows"], health["served_t"]["columns"], health["served_t"]["has_data"]) == (10, 2, True)
    assert health["books_data_processed_x"]["table_exists"] is False
    assert serving.run_sql(spark, "SELECT count(*) AS n FROM served_t WHERE id >= ?", [3]).first()["n"] == 4
    spark.sql("DROP TABLE served_t")


def test_profiles(spark):
    rows = [(1, "a", 1.0), (2, None, 2.0), (2, None, 2.0), (4, "a", None)]
    frame = spark.createDataFrame(rows, "k int, s string, x double")
    assert [(r["column"], r["missing"], r["missing_pct"]) for r in P.missing_profile(frame).collect()] == [("s", 2, 50.0), ("x", 1, 25.0), ("k", 0, 0.0)]
    assert tuple(P.duplicate_rows(frame).first()) == (4, 1)
    card = {r["column"]: tuple(r)[1:] for r in P.cardinality(frame, ["k", "s"]).collect()}
    assert card == {"k": (4, 3, 1, 0, 4), "s": (4, 1, 2, 2, 2)}
    assert [tuple(r) for r in P.top_values(frame, "s").collect()] == [("a", 2)]
    assert tuple(P.numeric_summary(frame, "x").first())[3:] == (1.0, 1.5, 2.0, 2.0, 2.0)
    empty = frame.select(F.lit(None).cast("string").alias("z"), F.when(F.col("k") > 9, "q").alias("y"))
    assert tuple(P.empty_records(empty).first()) == (2, 4)
    assert tuple(P.text_coverage(frame, "s").first()) == (2, 2, 50.0)


def test_histogram_edges(spark):
    frame = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9.99, 10, 10)], "v double")
    assert [r["n"] for r in P.histogram(frame, "v", 10).orderBy("bin").collect()] == [1, 1, 0, 0, 0, 1, 0, 0, 0, 3]
    assert [r["n"] for r in P.histogram(frame, "v", 2, 1, 5).orderBy("bin").collect()] == [1, 1]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r["n"] for r in P.histogram(same, "v", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_key_dedup_keeps_the_most_complete_row(spark):
    rows = [(1, "a", None, "x"), (2, "a", "y", "x"), (3, "a", "z", "x"), (4, None, None, None), (5, None, "q", None), (6, "b", None, None)]
    frame = spark.createDataFrame(rows, "book_id long, k string, v string, w string")
    kept, rejected = D.dedup_by_key(frame, ["k"])
    assert sorted(r["book_id"] for r in kept.collect()) == [2, 5, 6]
    assert sorted(r["book_id"] for r in rejected.collect()) == [1, 3, 4]
    again, none = D.dedup_by_key(kept, ["k"])
    assert again.count() == 3 and none.count() == 0


def test_exact_dedup_ignores_the_id(spark):
    frame = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", None)], "book_id long, k string, v string")
    assert sorted(r["book_id"] for r in D.drop_duplicate_rows(frame, "book_id").collect()) == [1, 2]
    assert tuple(D.removed_count(frame, D.drop_duplicate_rows(frame, "book_id")).first()) == (3, 2, 1)


def test_catalogue_cleaning(spark):
    rows = [
        (1, "The Silent River", "['Ann Lee']", "House, Inc.", "1999", "['Art']"),
        (2, "The Silent River", "['Ann Lee']", "House, Inc.", "1999", "['Art']"),
        (3, "the silent river!", "['Ann Lee']", None, "1999-05", "['Art', 'art']"),
        (4, "Golden Apple", "['Bob Ray', 'Ann Lee']", None, "junk", None),
        (5, "Green Meadow", "['Ann Lee']", "House", "2001", "['Art']"),
        (6, None, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, schemas.BOOKS_RAW)
    kept, rejected = clean_books(raw, dedup_authors=False, stop_words=["the"])
    got = {r["book_id"]: r for r in kept.collect()}
    assert sorted(got) == [1, 4, 5, 6]
    assert (got[1]["title_std"], got[1]["authors_std"], got[1]["publisher_std"], got[1]["pub_year"]) == ("The Silent River", "ann lee", "house inc", 1999)
    assert got[4]["authors_std"] == "ann lee, bob ray"
    merged, _ = clean_books(raw, dedup_authors=True, stop_words=["the"])
    assert sorted(r["book_id"] for r in merged.collect()) == [1, 4, 6]  # books of one author collapse
    reviews = spark.createDataFrame([("A  b!",), ("A  b!",), (None,)], "title string")
    assert sorted(map(tuple, clean_reviews(reviews).collect()), key=str) == [("A  b!", "a b"), (None, None)]


def test_books_that_differ_only_in_their_id_are_two_books(spark):
    row = ("Blue Ring", "['Ann']", "House", "1999", "['x']")
    raw = spark.createDataFrame([(1, *row), (2, *row), (2, *row)], schemas.BOOKS_RAW)
    assert sorted(r["book_id"] for r in standardise_books(raw).collect()) == [1, 2]
