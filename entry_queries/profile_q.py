"""Profiling and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from entry_queries import query
from entry_queries.reports_q import Q06
from entry_queries.sql import BOOKS, BOOKS_RAW, REVIEWS, TEXT_REVIEWS, rnd, with_
from reviewlens.functions.numeric import rounded
from reviewlens.operators import profile as P
from reviewlens.operators import sampling as S
from reviewlens.plans import reports as R
from reviewlens.sources.sample_tables import books, books_raw, reviews, table

RAW_COLUMNS = ["book_id", "title", "authors", "publisher", "published_date", "categories"]


def _per_column(columns, expr, source):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expr.format(c=c)} FROM {source}" for c in columns)


@query("pr01", f"""{with_(BOOKS_RAW)}
{_per_column(RAW_COLUMNS, '''CASE '{c}' WHEN 'book_id' THEN 'bigint' ELSE 'string' END AS dtype, count({c}) AS non_null,
  count(*) AS rows, 6 AS columns''', 'books_raw')}""")
def pr01(spark, sf):
    return P.overview(books_raw(spark, sf))


@query("pr02", f"""{with_(BOOKS_RAW)}
{_per_column(RAW_COLUMNS, f"count(*) - count({{c}}) AS missing, {rnd('1e2 * (count(*) - count({c})) / count(*)', 2)} AS missing_pct", 'books_raw')}""")
def pr02(spark, sf):
    return P.missing_profile(books_raw(spark, sf))


@query("pr03", """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicates
FROM documents""")
def pr03(spark, sf):
    return P.duplicate_rows(table(spark, sf, "documents").drop("doc_id"))


@query("pr04", f"""{with_(REVIEWS)}
SELECT (count(sentimento) = 0)::INT + (count(compound) = 0)::INT + 1 AS all_null_columns,
  count(*) FILTER (WHERE sentimento IS NULL AND compound IS NULL) AS all_null_rows FROM reviews""")
def pr04(spark, sf):
    empty = F.lit(None).cast("string").alias("notes")
    return P.empty_records(reviews(spark, sf).select("sentimento", "compound", empty))


@query("pr05", f"""{with_(BOOKS_RAW)}
{_per_column(RAW_COLUMNS[1:], '''count(*) AS total, count(DISTINCT {c}) AS unique_values,
  count(*) - count(DISTINCT {c}) - max(({c} IS NULL)::INT) AS repeated,
  count(*) - count({c}) AS nulls, count({c}) AS non_null''', 'books_raw')}""")
def pr05(spark, sf):
    return P.cardinality(books_raw(spark, sf), RAW_COLUMNS[1:])


@query("pr06", f"""{with_(BOOKS)}
SELECT publisher_std AS value, count(*) AS n FROM books GROUP BY 1 ORDER BY n DESC, value LIMIT 15""")
def pr06(spark, sf):
    return P.top_values(books(spark, sf), "publisher_std", 15)


def _summary_sql(c, source):
    return f"""SELECT count({c}) AS count, {rnd(f'avg({c})', 6)} AS mean, {rnd(f'stddev_samp({c})', 6)} AS std,
  min({c})::DOUBLE AS min, {rnd(f'quantile_cont({c}::DOUBLE, 0.25)', 6)} AS q25,
  {rnd(f'quantile_cont({c}::DOUBLE, 0.5)', 6)} AS median, {rnd(f'quantile_cont({c}::DOUBLE, 0.75)', 6)} AS q75,
  max({c})::DOUBLE AS max FROM {source}"""


def _rounded_summary(df):
    cut = {c: rounded(F.col(c), 6) for c in ("mean", "std", "q25", "median", "q75")}
    return df.withColumns(cut)


@query("pr07", f"{with_(BOOKS)} {_summary_sql('pub_year', 'books')}")
def pr07(spark, sf):
    return _rounded_summary(P.numeric_summary(books(spark, sf), "pub_year"))


@query("pr07_polarity", f"{with_(REVIEWS)} {_summary_sql('compound', 'reviews')}")
def pr07_polarity(spark, sf):
    return _rounded_summary(P.numeric_summary(reviews(spark, sf), "compound"))


@query("pr08", f"""{with_(BOOKS)},
kept AS (SELECT pub_year::DOUBLE AS v FROM books WHERE pub_year BETWEEN 1800 AND 2024),
edge AS (SELECT min(v) AS lo, (max(v) - min(v)) / 50e0 AS w FROM kept),
counted AS (SELECT least(floor((v - lo) / w), 49)::INT AS bin, count(*) AS n FROM kept, edge GROUP BY 1)
SELECT b.bin, lo + b.bin * w AS bin_from, lo + (b.bin + 1) * w AS bin_to, coalesce(n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b CROSS JOIN edge LEFT JOIN counted USING (bin)""")
def pr08(spark, sf):
    return P.histogram(books(spark, sf), "pub_year", 50, 1800, 2024)


@query("pr08_scores", f"""WITH ranked AS ({Q06}),
edge AS (SELECT min(performance_score) AS lo, (max(performance_score) - min(performance_score)) / 1e1 AS w FROM ranked),
counted AS (SELECT least(floor((performance_score - lo) / w), 9)::INT AS bin, count(*) AS n FROM ranked, edge GROUP BY 1)
SELECT b.bin, lo + b.bin * w AS bin_from, lo + (b.bin + 1) * w AS bin_to, coalesce(n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b CROSS JOIN edge LEFT JOIN counted USING (bin)""")
def pr08_scores(spark, sf):
    return P.histogram(R.best_books(books(spark, sf), reviews(spark, sf)), "performance_score", 10)


@query("pr09", f"""{with_(TEXT_REVIEWS)}, t AS (SELECT CASE WHEN length(text) > 500 THEN text END AS text FROM reviews)
SELECT count(text) AS with_text, count(*) - count(text) AS without_text, {rnd('1e2 * count(text) / count(*)', 1)} AS pct_with_text FROM t""")
def pr09(spark, sf):
    long_texts = reviews(spark, sf, text=True).select(F.when(F.length("text") > 500, F.col("text")).alias("text"))
    return P.text_coverage(long_texts)


# Samples: sizes, quotas and, as drawn by MD5, the rows themselves are checked against SQL. ------------------

BOOK_KEYS = ["book_id"]
REVIEW_KEYS = ["review_id"]


def _draw(key: str) -> str:
    return f"left(md5('42|' || {key}), 15), {key}"


@query("sample_percent", f"""{with_(REVIEWS)}
SELECT * EXCLUDE (place, n) FROM (SELECT *, row_number() OVER (ORDER BY {_draw('review_id')}) AS place, count(*) OVER () AS n FROM reviews)
WHERE place <= round_even(n * 0.1e0, 0)""")
def sample_percent(spark, sf):
    return S.sample_percent(reviews(spark, sf), 10, REVIEW_KEYS, digest="md5")


@query("sample_percent_size", f"{with_(REVIEWS)} SELECT CAST(round_even(count(*) * 0.1e0, 0) AS BIGINT) AS n FROM reviews")
def sample_percent_size(spark, sf):
    return S.sample_percent(reviews(spark, sf), 10, REVIEW_KEYS).agg(F.count_distinct("review_id").alias("n"))


def _typed_books(spark, sf):
    return books(spark, sf).withColumn("main_type", F.substring_index("categories_std", ",", 1))


STRATIFIED = f"""
typed AS (SELECT *, split_part(categories_std, ',', 1) AS main_type FROM books),
strata AS (SELECT main_type AS stratum, count(*) AS rows FROM typed GROUP BY main_type),
tot AS (SELECT sum(rows)::BIGINT AS n, CAST(floor(150 / sum(rows)::DOUBLE * sum(rows)) AS BIGINT) AS drawn FROM strata),
share AS (SELECT stratum, rows * drawn // n AS base, rows * drawn % n AS rest, drawn FROM strata, tot),
quota AS (
  SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, {_draw('stratum')}) <= drawn - sum(base) OVER () THEN 1 ELSE 0 END AS n
  FROM share),
placed AS (SELECT *, row_number() OVER (PARTITION BY main_type ORDER BY {_draw('book_id')}) AS place FROM typed),
picked AS (SELECT p.* EXCLUDE (place) FROM placed p JOIN quota q ON q.stratum = p.main_type WHERE place <= q.n)"""


@query("sample_stratified", f"{with_(BOOKS, STRATIFIED)} SELECT * FROM picked")
def sample_stratified(spark, sf):
    return S.sample_stratified(_typed_books(spark, sf), 150, "main_type", BOOK_KEYS, digest="md5")


@query("sample_stratified_quota", """WITH strata AS (SELECT p_type AS stratum, count(*) AS rows FROM part GROUP BY p_type),
tot AS (SELECT sum(rows)::BIGINT AS n, CAST(floor(150 / sum(rows)::DOUBLE * sum(rows)) AS BIGINT) AS drawn FROM strata),
share AS (SELECT stratum, rows, rows * drawn // n AS base, rows * drawn % n AS rest, drawn FROM strata, tot)
SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC) <= drawn - sum(base) OVER () THEN 1 ELSE 0 END AS n
FROM share""")
def sample_stratified_quota(spark, sf):
    picked = S.sample_stratified(_typed_books(spark, sf), 150, "main_type", BOOK_KEYS)
    return picked.groupBy(F.col("main_type").alias("stratum")).agg(F.count_distinct("book_id").alias("n"))


@query("sample_semi", f"""WITH best AS ({Q06}), {REVIEWS}
SELECT review_id, title, sentimento FROM reviews WHERE title IN (SELECT titulo FROM best)""")
def sample_semi(spark, sf):
    best = R.best_books(books(spark, sf), reviews(spark, sf)).select(F.col("titulo").alias("title"))
    return S.reviews_of_sample(reviews(spark, sf), best).select("review_id", "title", "sentimento")


def _sizes(pair):
    tagged = [df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, df in zip(("books", "reviews"), pair)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


@query("sample_pair", """SELECT 'books' AS kind, CAST(round_even(count(*) * 0.05e0, 0) AS BIGINT) AS n FROM part
UNION ALL SELECT 'reviews', CAST(round_even(count(*) * 0.02e0, 0) AS BIGINT) FROM lineitem""")
def sample_pair(spark, sf):
    return _sizes(S.sample_pair(books(spark, sf), reviews(spark, sf)))


@query("sample_pair_fixed", f"""{with_(BOOKS, STRATIFIED, REVIEWS)}
SELECT 'books' AS kind, count(*) AS n FROM picked
UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE title IN (SELECT title_std FROM picked)""")
def sample_pair_fixed(spark, sf):
    catalogue = _typed_books(spark, sf).withColumnRenamed("title_std", "title")
    return _sizes(S.sample_pair(catalogue, reviews(spark, sf), mode="fixed", sample_size=150, stratify_column="main_type", digest="md5"))


@query("sample_n", "SELECT least(1000, count(*)) AS n FROM lineitem")
def sample_n(spark, sf):
    return S.sample_before_scoring(reviews(spark, sf), REVIEW_KEYS, n=1000).agg(F.count_distinct("review_id").alias("n"))
