"""Text standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from entry_queries import query
from entry_queries.reports_q import PERIOD, RECENCY
from entry_queries.sql import BOOKS, BOOKS_RAW, TEXT_REVIEWS, with_
from reviewlens.functions import text as T
from reviewlens.operators.standardise import most_frequent_spelling
from reviewlens.sources.sample_tables import books, books_raw, reviews, table


def normal_sql(c: str) -> str:
    return (
        f"nullif(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), '')"
    )


ITEM_SQL = r"""'''[^''\\]*(?:\\.[^''\\]*)*''|"[^"\\]*(?:\\.[^"\\]*)*"'"""


def names_sql(c: str) -> str:
    """The list literals of the sample catalogue hold no escapes, so quotes are simply cut off."""
    items = f"regexp_extract_all({c}, {ITEM_SQL})"
    names = f"list_filter(list_transform({items}, lambda x: trim(lower(x[2:-2]))), lambda x: x != '')"
    return (
        f"CASE WHEN {c} LIKE '[%]' THEN nullif(array_to_string(list_sort(list_distinct({names})), ', '), '') "
        f"WHEN regexp_full_match({c}, '[0-9]+(\\.[0-9]*)?') THEN {c} END"
    )


def year_sql(c: str) -> str:
    return f"""CASE WHEN regexp_full_match({c}, '[0-9]{{4}}(-[0-9]{{2}}(-[0-9]{{2}})?)?')
      THEN CAST(year(TRY_CAST(rpad({c}, 10, '-01-01'[length({c}) - 3:]) AS DATE)) AS INTEGER) END"""


def _words_sql(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    )


def search_title_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.SEARCH_STOP_WORDS)
    return f"""array_to_string(list_filter(string_split({_words_sql(f"coalesce({c}, '')")}, ' '),
      lambda w: length(w) > 2 AND NOT list_contains([{stop}], w))[1:5], ' ')"""


def search_author_sql(c: str) -> str:
    name = _words_sql(f"split_part({c}, ',', 1)")
    return f"CASE WHEN length({name}) > 2 THEN {name} END"


@query("tx01", f"""{with_(BOOKS_RAW)}
SELECT 'book' AS kind, book_id AS id, {normal_sql('title')} AS title_norm FROM books_raw
UNION ALL SELECT 'document', doc_id, {normal_sql('text')} FROM documents""")
def tx01(spark, sf):
    titles = books_raw(spark, sf).select(
        F.lit("book").alias("kind"), F.col("book_id").alias("id"), T.normal_form(F.col("title")).alias("title_norm")
    )
    texts = table(spark, sf, "documents").select(F.lit("document"), "doc_id", T.normal_form(F.col("text")))
    return titles.union(texts)


@query("tx02", f"{with_(BOOKS_RAW)} SELECT book_id, {names_sql('authors')} AS authors_std FROM books_raw")
def tx02(spark, sf):
    return books_raw(spark, sf).select("book_id", T.names_from_list_literal(F.col("authors")).alias("authors_std"))


@query("tx03", f"{with_(BOOKS_RAW)} SELECT book_id, {names_sql('categories')} AS categories_std FROM books_raw")
def tx03(spark, sf):
    return books_raw(spark, sf).select("book_id", T.names_from_list_literal(F.col("categories")).alias("categories_std"))


@query("tx04", f"{with_(BOOKS_RAW)} SELECT book_id, {year_sql('published_date')} AS pub_year FROM books_raw")
def tx04(spark, sf):
    return books_raw(spark, sf).select("book_id", T.publication_year(F.col("published_date")).alias("pub_year"))


STANDARD_TITLES = f"""
normed AS (SELECT *, {normal_sql('title')} AS title_norm FROM books_raw),
ranked AS (
  SELECT title_norm, title, row_number() OVER (PARTITION BY title_norm ORDER BY count(*) DESC, title) AS rn
  FROM normed WHERE title_norm IS NOT NULL GROUP BY title_norm, title),
standard AS (SELECT title_norm, title AS title_std FROM ranked WHERE rn = 1)"""


@query("tx05", f"""{with_(BOOKS_RAW, STANDARD_TITLES)}
SELECT book_id, title, title_std FROM normed LEFT JOIN standard USING (title_norm)""")
def tx05(spark, sf):
    raw = books_raw(spark, sf).withColumn("title_norm", T.normal_form(F.col("title")))
    return most_frequent_spelling(raw, "title_norm", "title", "title_std").select("book_id", "title", "title_std")


@query("tx06", f"""{with_(BOOKS_RAW)}
SELECT book_id, coalesce(title, '') || '_' || coalesce(authors, '') AS pair_key FROM books_raw""")
def tx06(spark, sf):
    return books_raw(spark, sf).select("book_id", T.pair_key(F.col("title"), F.col("authors")).alias("pair_key"))


@query("tx07", f"""{with_(BOOKS_RAW)}
SELECT 'book' AS kind, book_id AS id, {search_title_sql('title')} AS search_title FROM books_raw
UNION ALL SELECT 'document', doc_id, {search_title_sql('text')} FROM documents""")
def tx07(spark, sf):
    titles = books_raw(spark, sf).select(
        F.lit("book").alias("kind"), F.col("book_id").alias("id"), T.search_title(F.col("title")).alias("search_title")
    )
    texts = table(spark, sf, "documents").select(F.lit("document"), "doc_id", T.search_title(F.col("text")))
    return titles.union(texts)


@query("tx08", f"{with_(BOOKS_RAW)} SELECT book_id, {search_author_sql('authors')} AS search_author FROM books_raw")
def tx08(spark, sf):
    return books_raw(spark, sf).select("book_id", T.search_author(F.col("authors")).alias("search_author"))


@query("tx09", f"""{with_(BOOKS)}
SELECT book_id, trim(split_part(categories_std, ',', 1)) AS main_category,
  split_part(' ' || categories_std, ',', 1) AS main_category_untrimmed FROM books""")
def tx09(spark, sf):
    padded = F.concat(F.lit(" "), F.col("categories_std"))
    return books(spark, sf).select(
        "book_id",
        T.first_category(F.col("categories_std")).alias("main_category"),
        T.first_category(padded, trim=False).alias("main_category_untrimmed"),
    )


@query("tx10", f"""{with_(TEXT_REVIEWS)}
SELECT review_id, substr(text, 1, 200) AS review_preview, substr(title, 1, 60) || '...' AS title_short FROM reviews""")
def tx10(spark, sf):
    return reviews(spark, sf, text=True).select(
        "review_id",
        T.preview(F.col("text"), 200).alias("review_preview"),
        T.preview(F.col("title"), 60, ellipsis=True).alias("title_short"),
    )


@query("tx11", f"{with_(BOOKS)} SELECT book_id, {PERIOD} AS period, {RECENCY} AS recency FROM books")
def tx11(spark, sf):
    year = F.col("pub_year")
    return books(spark, sf).select("book_id", T.period_band(year).alias("period"), T.recency_band(year).alias("recency"))


@query("tx12", f"{with_(BOOKS)} SELECT book_id, CAST(pub_year // 10 * 10 AS INTEGER) AS decade FROM books")
def tx12(spark, sf):
    return books(spark, sf).select("book_id", T.decade(F.col("pub_year")).alias("decade"))


@query("tx13", f"""{with_(BOOKS_RAW)}
SELECT 'book' AS kind, book_id AS id, CAST(nullif(regexp_extract(published_date, '([0-9]{{4}})', 1), '') AS INTEGER) AS year_found
FROM books_raw
UNION ALL SELECT 'document', doc_id, CAST(nullif(regexp_extract(text, '([0-9]{{4}})', 1), '') AS INTEGER) FROM documents""")
def tx13(spark, sf):
    dates = books_raw(spark, sf).select(
        F.lit("book").alias("kind"), F.col("book_id").alias("id"),
        T.year_in_text(F.col("published_date")).alias("year_found"),
    )
    texts = table(spark, sf, "documents").select(F.lit("document"), "doc_id", T.year_in_text(F.col("text")))
    return dates.union(texts)


@query("tx14", f"""{with_(BOOKS_RAW)}
SELECT book_id, CAST((title IS NULL)::INT + (authors IS NULL)::INT + (publisher IS NULL)::INT
  + (published_date IS NULL)::INT + (categories IS NULL)::INT AS INTEGER) AS n_nulls FROM books_raw""")
def tx14(spark, sf):
    raw = books_raw(spark, sf)
    return raw.select("book_id", T.null_cells(["title", "authors", "publisher", "published_date", "categories"]).alias("n_nulls"))
