"""Enrichment from a reference catalogue, and what it changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from entry_queries import query
from entry_queries.sql import BOOKS, rnd, with_
from entry_queries.text_q import search_author_sql, search_title_sql
from reviewlens.functions.numeric import rounded
from reviewlens.operators import enrich as E
from reviewlens.operators import profile as P
from reviewlens.session import scratch_path
from reviewlens.sources.sample_tables import books_with_gaps, books_with_typos, reference_catalog

GAPS = """
gaps AS (
  SELECT book_id, title_std, CASE WHEN book_id % 4 != 0 THEN authors_std END AS authors_std,
    CASE WHEN book_id % 6 = 0 THEN '' WHEN book_id % 5 != 0 THEN publisher_std END AS publisher_std,
    CASE WHEN book_id % 7 != 0 THEN categories_std END AS categories_std,
    CASE WHEN book_id % 9 != 0 THEN pub_year END AS pub_year FROM books)"""
CATALOG = """
catalog AS (
  SELECT 'OL' || p_partkey AS key,
    CASE p_partkey % 3 WHEN 0 THEN p_name || ' #' || p_partkey
      WHEN 1 THEN 'The ' || list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])),
        'string_agg', ' ') || ', #' || p_partkey
      ELSE p_name || ' #' || p_partkey || ' and other stories of the old trade' END AS title,
    [p_brand, 'Editor ' || p_size] AS author_name, 'House ' || p_size AS publisher,
    p_type || ', ' || p_name AS subject, CAST(1951 + p_partkey % 74 AS INTEGER) AS pub_year
  FROM part WHERE p_partkey % 10 != 9)"""
MISSING = """missing AS (
  SELECT * FROM gaps WHERE coalesce(publisher_std, '') = '' OR coalesce(authors_std, '') = ''
    OR coalesce(categories_std, '') = '' OR pub_year IS NULL)"""


def _keys(source: str, id_: str, author: str) -> str:
    """Search keys of normalised titles ``t`` and authors ``a`` in ``source``."""
    return f"""SELECT DISTINCT {id_}, 1 AS strategy_rank, 'titulo_autor' AS strategy, t || ' | ' || {author} AS search_key
  FROM {source} WHERE t != '' AND {author} IS NOT NULL
UNION ALL SELECT DISTINCT {id_}, 2, 'titulo_completo', t FROM {source} WHERE t != ''
UNION ALL SELECT DISTINCT {id_}, 3, 'busca_geral', array_to_string(list_sort(list_distinct(string_split(t, ' '))), ' ')
  FROM {source} WHERE t != ''
UNION ALL SELECT DISTINCT {id_}, 4, 'palavras_chave', array_to_string(string_split(t, ' ')[1:3], ' ')
  FROM {source} WHERE t != '' AND length(array_to_string(string_split(t, ' ')[1:3], ' ')) > 5"""


BOOK_KEYS = f"""
normed AS (SELECT book_id, {search_title_sql('title_std')} AS t, {search_author_sql('authors_std')} AS a FROM missing),
book_keys AS ({_keys('normed', 'book_id', 'a')})"""


def _gap(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) > 0 AND length({b}) > 0 THEN 1e0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE ELSE 0e0 END"


HITS = f"""
cat_normed AS (SELECT key, {search_title_sql('title')} AS t, unnest(author_name) AS raw_a FROM catalog),
cat_authors AS (SELECT key, t, {search_author_sql('raw_a')} AS a FROM cat_normed),
cat_keys AS ({_keys('cat_authors', 'key', 'a')}),
found AS (SELECT *, count(*) OVER (PARTITION BY strategy_rank, search_key) AS n_found FROM cat_keys),
hits AS (
  SELECT k.book_id, k.strategy_rank, k.strategy, f.n_found, f.key,
    {_gap('lower(m.title_std)', 'lower(c.title)')}
    + CASE WHEN n.a IS NOT NULL AND list_max(list_transform(c.author_name, lambda x: {_gap('n.a', 'lower(x)')})) > 0.7
        THEN 0.2e0 ELSE 0e0 END AS similarity
  FROM book_keys k JOIN found f USING (strategy_rank, search_key) JOIN catalog c ON c.key = f.key
  JOIN missing m ON m.book_id = k.book_id JOIN normed n ON n.book_id = k.book_id)"""
BEST = """
limits AS (SELECT book_id, min(strategy_rank) FILTER (WHERE similarity > 0.8) AS last FROM hits GROUP BY book_id),
ranked AS (
  SELECT h.*, row_number() OVER (PARTITION BY book_id ORDER BY (similarity <= 0.9)::INT,
    CASE WHEN similarity > 0.9 THEN 0e0 ELSE -similarity END, strategy_rank, h.key) AS rn
  FROM hits h JOIN limits USING (book_id) WHERE (last IS NULL OR strategy_rank <= last) AND similarity > 0.6),
results AS (
  SELECT m.book_id, array_to_string(c.author_name[1:3], ', ') AS authors_std, c.publisher AS publisher_std,
    c.subject AS categories_std, c.pub_year, r.strategy, coalesce(r.similarity, 0e0) AS similarity,
    CAST(coalesce(r.n_found, 0) AS INTEGER) AS n_found
  FROM missing m LEFT JOIN ranked r ON r.book_id = m.book_id AND rn = 1 LEFT JOIN catalog c ON c.key = r.key)"""
BASE = with_(BOOKS, GAPS, MISSING)
SEARCH = with_(BOOKS, GAPS, MISSING, CATALOG, BOOK_KEYS, HITS, BEST)
AFTER = """after AS (
  SELECT g.book_id, g.title_std, coalesce(r.authors_std, g.authors_std) AS authors_std,
    coalesce(r.publisher_std, g.publisher_std) AS publisher_std, coalesce(r.categories_std, g.categories_std) AS categories_std,
    coalesce(r.pub_year, g.pub_year) AS pub_year FROM gaps g LEFT JOIN results r USING (book_id))"""

# The same with titles a few edits apart as a last strategy: every pair of distinct titles is compared.
TYPOS = GAPS.replace("title_std, CASE", """CASE book_id % 3 WHEN 1 THEN title_std[1] || 'q' || title_std[3:]
    WHEN 2 THEN title_std[1] || title_std[3:] ELSE title_std END AS title_std, CASE""", 1)
NEAR = """
cat_titles AS (SELECT t, count(*) AS uses FROM (SELECT DISTINCT key, t FROM cat_normed) WHERE t != '' GROUP BY t),
near AS MATERIALIZED (
  SELECT b.t, c.t AS other, levenshtein(b.t, c.t) AS edits, c.uses
  FROM (SELECT DISTINCT t FROM normed WHERE t != '') b JOIN cat_titles c
    ON b.t != c.t AND abs(length(b.t) - length(c.t)) <= 3 AND levenshtein(b.t, c.t) <=
      CASE WHEN greatest(length(b.t), length(c.t)) >= 32 THEN 3 WHEN greatest(length(b.t), length(c.t)) >= 16 THEN 2
        WHEN greatest(length(b.t), length(c.t)) >= 8 THEN 1 ELSE 0 END),
near_found AS (SELECT t, sum(uses) AS n_found FROM near GROUP BY t)"""
_NEAR_ROWS = """
near_hits AS (
  SELECT n.book_id, 5 AS strategy_rank, 'titulo_proximo' AS strategy, f.n_found, c.key, {score} AS similarity
  FROM normed n JOIN near p ON p.t = n.t JOIN near_found f ON f.t = n.t JOIN (SELECT DISTINCT key, t FROM cat_normed) k ON k.t = p.other
  JOIN catalog c ON c.key = k.key JOIN missing m ON m.book_id = n.book_id),
hits AS (SELECT * FROM key_hits UNION ALL SELECT * FROM near_hits)"""
_SCORE = HITS[HITS.index("f.key,") + len("f.key,") : HITS.index(" AS similarity\n  FROM book_keys")]
NEAR_SEARCH = with_(BOOKS, TYPOS, MISSING, CATALOG, BOOK_KEYS, HITS.replace("hits AS (", "key_hits AS (", 1), NEAR,
                    _NEAR_ROWS.replace("{score}", _SCORE), BEST)


@query("en01", f"{BASE} SELECT * FROM missing")
def en01(spark, sf):
    return E.missing_records(books_with_gaps(spark, sf))


@query("en02", f"{with_(BOOKS, GAPS, MISSING, BOOK_KEYS)} SELECT * FROM book_keys")
def en02(spark, sf):
    return E.search_keys(E.missing_records(books_with_gaps(spark, sf)))


def _hits(spark, sf, measure):
    return E.match_scores(E.missing_records(books_with_gaps(spark, sf)), reference_catalog(spark, sf), measure=measure)


@query("en03")
def en03(spark, sf):
    return _hits(spark, sf, "matching").select("book_id", "strategy", "key", "similarity")


@query("en03_edit", f"{SEARCH} SELECT book_id, strategy, key, {rnd('similarity', 9)} AS similarity FROM hits")
def en03_edit(spark, sf):
    hits = _hits(spark, sf, "edit")
    return hits.select("book_id", "strategy", "key", rounded(F.col("similarity"), 9).alias("similarity"))


@query("en04")
def en04(spark, sf):
    return E.best_matches(_hits(spark, sf, "matching"))


@query("en04_edit", f"{SEARCH} SELECT book_id, key AS catalog_key, strategy, CAST(n_found AS INTEGER) AS n_found FROM ranked WHERE rn = 1")
def en04_edit(spark, sf):
    return E.best_matches(_hits(spark, sf, "edit")).select("book_id", "catalog_key", "strategy", "n_found")


@query("en05", f"""{with_(CATALOG)}
SELECT key, array_to_string(author_name[1:3], ', ') AS authors_std, publisher AS publisher_std, subject AS categories_std, pub_year
FROM catalog""")
def en05(spark, sf):
    return E.extract_fields(reference_catalog(spark, sf))


def _found(spark, sf):
    return E.enrich_missing(books_with_gaps(spark, sf), reference_catalog(spark, sf), measure="edit")


@query("en06", f"{SEARCH}, {AFTER} SELECT * FROM after")
def en06(spark, sf):
    return E.apply_enrichment(books_with_gaps(spark, sf), _found(spark, sf))


@query("en06_fill_only", f"""{SEARCH}
SELECT g.book_id, g.title_std, coalesce(g.authors_std, r.authors_std) AS authors_std,
  coalesce(g.publisher_std, r.publisher_std) AS publisher_std, coalesce(g.categories_std, r.categories_std) AS categories_std,
  coalesce(g.pub_year, r.pub_year) AS pub_year FROM gaps g LEFT JOIN results r USING (book_id)""")
def en06_fill_only(spark, sf):
    return E.apply_enrichment(books_with_gaps(spark, sf), _found(spark, sf), fill_only=True)


@query("en07")
def en07(spark, sf):
    return E.enrich_missing(books_with_gaps(spark, sf), reference_catalog(spark, sf))


@query("en07_edit", f"{SEARCH} SELECT * REPLACE ({rnd('similarity', 9)} AS similarity) FROM results")
def en07_edit(spark, sf):
    return _found(spark, sf).withColumn("similarity", rounded(F.col("similarity"), 9))


@query("en07_summary", f"""{SEARCH}
SELECT count(*) AS processed, count(*) FILTER (WHERE strategy IS NOT NULL) AS succeeded,
  1e2 * count(*) FILTER (WHERE strategy IS NOT NULL) / count(*) AS success_pct FROM results""")
def en07_summary(spark, sf):
    return E.enrichment_summary(_found(spark, sf))


_FIELDS = ("authors_std", "publisher_std", "categories_std", "pub_year")


@query("pr10", f"""{SEARCH}, {AFTER},
fields AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, (SELECT count(*) - count({c}) FROM gaps) AS before, (SELECT count(*) - count({c}) FROM after) AS after" for c in _FIELDS)}),
every AS (SELECT * FROM fields UNION ALL SELECT 'total', sum(before), sum(after) FROM fields)
SELECT col AS "column", before, after, before - after AS filled,
  {rnd('CASE WHEN before > 0 THEN (before - after)::DOUBLE / before * 1e2 ELSE 0e0 END', 1)} AS success_pct FROM every""")
def pr10(spark, sf):
    before = books_with_gaps(spark, sf)
    return P.compare_missing(before, E.apply_enrichment(before, _found(spark, sf)), list(_FIELDS))


@query("pr11", f"""{SEARCH}, {AFTER}
SELECT a.* FROM after a JOIN gaps g USING (book_id) WHERE g.authors_std IS NULL AND a.authors_std IS NOT NULL ORDER BY book_id LIMIT 5""")
def pr11(spark, sf):
    before = books_with_gaps(spark, sf)
    return P.first_filled(before, E.apply_enrichment(before, _found(spark, sf)), "authors_std")


@query("pr11_years", f"""{SEARCH}, {AFTER}
SELECT count(*) AS count, min(a.pub_year)::DOUBLE AS min, max(a.pub_year)::DOUBLE AS max, median(a.pub_year)::DOUBLE AS median
FROM after a JOIN gaps g USING (book_id) WHERE g.pub_year IS NULL AND a.pub_year IS NOT NULL""")
def pr11_years(spark, sf):
    before = books_with_gaps(spark, sf)
    return P.filled_summary(before, E.apply_enrichment(before, _found(spark, sf)), "pub_year")


@query("pr12", f"""{BASE}
SELECT count(*) AS total, count(*) FILTER (WHERE length(title_std) < 5) AS too_short, count(*) FILTER (WHERE length(title_std) > 100) AS too_long,
  count(*) FILTER (WHERE coalesce(authors_std, '') = '') AS no_author,
  count(*) FILTER (WHERE regexp_matches(title_std, '[^\\p{{L}}\\p{{N}}_\\s]')) AS special_characters FROM gaps""")
def pr12(spark, sf):
    return E.diagnose_titles(books_with_gaps(spark, sf))


@query("pr12_strategies", f"""{SEARCH}
SELECT strategy, count(*) AS n, {rnd('1e2 * count(*) / (SELECT count(*) FROM results)', 1)} AS pct FROM results GROUP BY strategy""")
def pr12_strategies(spark, sf):
    return E.diagnose_strategies(_found(spark, sf))


@query("pr12_similarity", f"""{SEARCH}
SELECT {rnd('avg(similarity)', 3)} AS mean, {rnd('median(similarity)', 3)} AS median, count(*) FILTER (WHERE similarity > 0.8) AS high,
  count(*) FILTER (WHERE similarity BETWEEN 0.6 AND 0.8) AS medium, count(*) FILTER (WHERE similarity < 0.6) AS low FROM results""")
def pr12_similarity(spark, sf):
    return E.diagnose_similarity(_found(spark, sf))


@query("pr12_examples", f"""{SEARCH},
judged AS (SELECT *, CASE WHEN similarity > 0.8 THEN 'success' WHEN similarity < 0.3 THEN 'failure' END AS outcome FROM results)
SELECT book_id, {rnd('similarity', 9)} AS similarity, strategy, j.authors_std IS NOT NULL AS author_found, outcome, m.title_std,
  m.authors_std AS author
FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY book_id) AS rn FROM judged WHERE outcome IS NOT NULL) j
JOIN missing m USING (book_id) WHERE rn <= 5""")
def pr12_examples(spark, sf):
    out = E.diagnose_examples(books_with_gaps(spark, sf), _found(spark, sf))
    return out.withColumn("similarity", rounded(F.col("similarity"), 9))


@query("pr12_report")
def pr12_report(spark, sf):
    return E.diagnose(books_with_gaps(spark, sf), reference_catalog(spark, sf))


@query("en07_stage", f"{SEARCH} SELECT * REPLACE ({rnd('similarity', 9)} AS similarity) FROM results")
def en07_stage(spark, sf):
    path = scratch_path(spark, "enrichment")
    staged = E.enrich_to_stage(books_with_gaps(spark, sf), reference_catalog(spark, sf), path, "edit", pieces=2)
    return staged.withColumn("similarity", rounded(F.col("similarity"), 9))


def _near(spark, sf):
    return E.enrich_missing(books_with_typos(spark, sf), reference_catalog(spark, sf), measure="edit", near=True)


@query("en02_near", f"{with_(BOOKS, TYPOS, MISSING, CATALOG, BOOK_KEYS, HITS[: HITS.index('cat_authors')].rstrip().rstrip(','), NEAR)} "
       "SELECT t, other, edits, CAST(n_found AS INTEGER) AS n_found FROM near JOIN near_found USING (t)")
def en02_near(spark, sf):
    return E.near_pairs(E.missing_records(books_with_typos(spark, sf)), reference_catalog(spark, sf))


@query("en04_near", f"{NEAR_SEARCH} SELECT book_id, key AS catalog_key, strategy, CAST(n_found AS INTEGER) AS n_found FROM ranked WHERE rn = 1")
def en04_near(spark, sf):
    hits = E.match_scores(E.missing_records(books_with_typos(spark, sf)), reference_catalog(spark, sf), measure="edit", near=True)
    return E.best_matches(hits).select("book_id", "catalog_key", "strategy", "n_found")


@query("en07_near", f"{NEAR_SEARCH} SELECT * REPLACE ({rnd('similarity', 9)} AS similarity) FROM results")
def en07_near(spark, sf):
    return _near(spark, sf).withColumn("similarity", rounded(F.col("similarity"), 9))


@query("pr12_sample")
def pr12_sample(spark, sf):
    sample = E.diagnosis_sample(books_with_gaps(spark, sf))
    return E.diagnose_strategies(E.find_metadata(sample, reference_catalog(spark, sf)))
