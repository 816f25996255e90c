"""Sources, sinks, load-time cleaning and serving."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from entry_queries import query
from entry_queries.sql import BOOKS, BOOKS_RAW, REVIEWS, with_
from reviewlens import schemas
from reviewlens.session import scratch_path
from reviewlens.sources import files, serving
from reviewlens.sources.sample_tables import books, books_raw, reviews, table

DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@query("csv_roundtrip", DOCUMENTS)
def csv_roundtrip(spark, sf):
    docs = table(spark, sf, "documents")
    return files.read_csv(spark, files.write_csv(docs, scratch_path(spark, "csv")), docs.schema)


@query("processed_csv_scan", f"""{with_(BOOKS, REVIEWS)}
SELECT b.*, review_id, score, sentimento, compound FROM books b JOIN reviews ON title = title_std""")
def processed_csv_scan(spark, sf):
    rated = reviews(spark, sf)
    paths = [files.write_csv(df, scratch_path(spark, name)) for df, name in ((books(spark, sf), "books"), (rated, "reviews"))]
    left, right = files.read_raw_pair(spark, *paths, schemas.BOOKS, rated.schema)
    return left.join(right, F.col("title") == F.col("title_std")).drop("title")


@query("parquet_roundtrip", f"{with_(REVIEWS)} SELECT * FROM reviews")
def parquet_roundtrip(spark, sf):
    return files.read_parquet(spark, files.write_parquet(reviews(spark, sf), scratch_path(spark, "reviews")))


@query("json_roundtrip", DOCUMENTS)
def json_roundtrip(spark, sf):
    docs = table(spark, sf, "documents")
    return files.read_json(spark, files.write_json(docs, scratch_path(spark, "json")), docs.schema)


@query("csv_to_parquet", f"{with_(BOOKS_RAW)} SELECT title, authors, publisher, published_date, categories FROM books_raw")
def csv_to_parquet(spark, sf):
    rows = books_raw(spark, sf).drop("book_id")
    src = files.write_csv(rows, scratch_path(spark, "raw"))
    return files.csv_to_parquet(spark, src, scratch_path(spark, "stage"), rows.schema, "book_id").drop("book_id")


@query("save_table", f"{with_(BOOKS)} SELECT DISTINCT * FROM books")
def save_table(spark, sf):
    stage = files.write_parquet(books(spark, sf), scratch_path(spark, "stage"))
    name = f"served_{uuid.uuid4().hex}"
    inputs = {name: stage, f"absent_{name}": stage + "-absent"}
    serving.load_tables(spark, inputs, "replace", scratch_path(spark, "warehouse"))
    return spark.table(name)


@query("sql_params", f"""{with_(REVIEWS)}
SELECT title, count(*) AS n FROM reviews WHERE sentimento = 'negativo' AND score >= 3 GROUP BY title HAVING count(*) >= 5""")
def sql_params(spark, sf):
    reviews(spark, sf).createOrReplaceTempView(serving.REVIEW_TABLE)
    return serving.run_sql(
        spark,
        f"SELECT title, count(*) AS n FROM {serving.REVIEW_TABLE} WHERE sentimento = ? AND score >= ? "
        "GROUP BY title HAVING count(*) >= ?",
        ["negativo", 3, 5],
    )


@query("table_health", f"""SELECT 'books_data_processed' AS table_name, count(*) AS rows, 6 AS columns, true AS table_exists,
  count(*) > 0 AS has_data, true AS expected FROM part
UNION ALL SELECT 'books_rating_modified', count(*), 5, true, count(*) > 0, true FROM lineitem
UNION ALL SELECT 'books_final', 0, 0, false, false, true""")
def table_health(spark, sf):
    books(spark, sf).createOrReplaceTempView(serving.CATALOGUE)
    reviews(spark, sf).createOrReplaceTempView(serving.REVIEW_TABLE)
    health = serving.table_health(spark, (serving.CATALOGUE, serving.REVIEW_TABLE, "books_final"))
    return health.where("expected")


def _noted(spark, sf):
    """Documents with a padded note holding spelled-out missing values, and a column few rows fill."""
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    key = F.col("doc_id")
    return docs.join(marks, "doc_id", "left").select(
        "doc_id",
        F.when(key % 5 == 0, F.lit(" nan "))
        .when(key % 5 == 1, F.lit("None"))
        .when(key % 5 == 2, F.lit("   "))
        .otherwise(F.concat(F.lit("  "), F.col("source"), F.lit("\t")))
        .alias("note"),
        "quality",
        F.when(F.col("toxic") == 1, F.lit("toxic")).alias("warning"),
    )


NOTED = """noted AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' nan ' WHEN 1 THEN 'None' WHEN 2 THEN '   ' ELSE '  ' || source || chr(9) END AS note,
    quality, CASE WHEN toxic = 1 THEN 'toxic' END AS warning
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query("clean_nulls", f"""WITH {NOTED}
SELECT doc_id, CASE WHEN doc_id % 5 > 2 THEN trim(note, chr(9) || ' ') END AS note, quality, warning FROM noted""")
def clean_nulls(spark, sf):
    return serving.clean_strings(_noted(spark, sf))


@query("drop_sparse_columns", f"WITH {NOTED} SELECT doc_id, note, quality FROM noted")
def drop_sparse_columns(spark, sf):
    return serving.drop_sparse_columns(_noted(spark, sf))


@query("load_dedup", f"""WITH {NOTED}
SELECT DISTINCT CASE WHEN doc_id % 5 > 2 THEN trim(note, chr(9) || ' ') END AS note, quality FROM noted""")
def load_dedup(spark, sf):
    return serving.clean_strings(_noted(spark, sf).select("note", "quality")).dropDuplicates()
