"""Shared SQL fragments of the DuckDB twins."""

from __future__ import annotations

BOOKS = """
books AS (
  SELECT p_partkey AS book_id, p_name || ' #' || p_partkey AS title_std, p_brand AS authors_std,
         'Publisher ' || p_size AS publisher_std, p_type || ', ' || p_name AS categories_std,
         CAST(1951 + p_partkey % 74 AS INTEGER) AS pub_year
  FROM part)"""

BOOKS_RAW = r"""
books_raw AS (
  SELECT p_partkey AS book_id,
    CASE WHEN p_partkey % 29 = 0 THEN NULL
         WHEN p_partkey % 3 = 0 THEN
           list_aggregate(list_transform(string_split(nm, ' '),
             lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')
         WHEN p_partkey % 7 = 0 THEN upper(nm) || '!'
         ELSE nm END AS title,
    CASE WHEN p_partkey % 13 = 0 THEN NULL
         WHEN p_partkey % 11 = 0 THEN p_brand
         WHEN p_partkey % 5 = 0 THEN '[''' || p_brand || ''', "' || lower(p_brand) || ' O''Neil"]'
         ELSE '[''' || p_brand || ''']' END AS authors,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'Publisher #' || p_size || ', Inc.' END AS publisher,
    CASE WHEN p_partkey % 19 = 0 THEN 'unknown'
         WHEN p_partkey % 3 = 0 THEN CAST(1951 + p_partkey % 74 AS VARCHAR)
         WHEN p_partkey % 3 = 1 THEN (1951 + p_partkey % 74) || '-07'
         ELSE (1951 + p_partkey % 74) || '-07-04' END AS published_date,
    CASE WHEN p_partkey % 23 = 0 THEN '[]'
         ELSE '[''' || upper(p_type[1]) || lower(p_type[2:]) || ''', ''' || p_name || ''']' END AS categories
  FROM (SELECT *, p_name || ' ' || (p_partkey % 400) AS nm FROM part))"""

_REVIEW_COLUMNS = """
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS review_id,
         p_name || ' #' || p_partkey AS title,
         1.0::DOUBLE + CAST(l_quantity AS INTEGER) % 5 AS score,
         CASE WHEN l_quantity >= 49 THEN 'n/a'
              WHEN l_quantity < 3 AND l_tax >= 0.08 THEN NULL
              WHEN l_returnflag = 'R' THEN 'negativo'
              WHEN l_returnflag = 'A' THEN 'positivo'
              ELSE 'neutro' END AS sentimento,
         CASE WHEN l_quantity < 49 THEN (round(l_discount * 100) - 5) / 5 END AS compound"""

REVIEWS = f"""
reviews AS (
  SELECT {_REVIEW_COLUMNS}
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

USER_REVIEWS = f"""
reviews AS (
  SELECT {_REVIEW_COLUMNS}, 'U' || o_custkey AS user_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

TEXT_REVIEWS = f"""
lines AS (SELECT *, l_orderkey % (SELECT count(*) FROM documents) AS text_key FROM lineitem),
texts AS MATERIALIZED (SELECT doc_id, text || '' AS text FROM documents),
reviews AS (
  SELECT {_REVIEW_COLUMNS}, d.text AS text
  FROM lines JOIN part ON l_partkey = p_partkey JOIN texts d ON d.doc_id = text_key)"""

BASE = """
base AS (
  SELECT b.*, r.* FROM books b JOIN reviews r ON b.title_std = r.title WHERE r.sentimento IS NOT NULL)"""

# Measures of a grouped base: counts as in the reports, polarity summed as whole millionths.
MEASURES = """
  count(DISTINCT title_std) AS t, count(sentimento) AS n,
  count(*) FILTER (WHERE sentimento = 'positivo') AS n_pos,
  count(*) FILTER (WHERE sentimento = 'negativo') AS n_neg,
  count(*) FILTER (WHERE sentimento = 'neutro') AS n_neu,
  sum(CAST(round(compound * 1e6) AS BIGINT))::DOUBLE / 1e6 / count(compound) AS a,
  1e2 * count(*) FILTER (WHERE sentimento = 'positivo') / count(sentimento) AS p,
  1e2 * count(*) FILTER (WHERE sentimento = 'negativo') / count(sentimento) AS g,
  count(sentimento)::DOUBLE / count(DISTINCT title_std) AS per_book"""


def rnd(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(30,12)), {digits}) AS DOUBLE)"


def metrics(keys: str, where: str = "TRUE") -> str:
    """CTE ``m``: measures of the base per ``keys`` ("expr AS name, ...")."""
    names = ", ".join(k.rsplit(" AS ", 1)[1] for k in keys.split("; "))
    exprs = keys.replace("; ", ", ")
    return f"""WITH {BOOKS}, {REVIEWS}, {BASE},
m AS (SELECT {exprs}, {MEASURES} FROM base WHERE {where} GROUP BY {names})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)
