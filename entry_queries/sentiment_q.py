"""Sentiment scoring and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from entry_queries import query
from entry_queries.sql import REVIEWS, rnd, with_
from reviewlens.functions.numeric import rounded
from reviewlens.operators import sentiment as S
from reviewlens.session import spread
from reviewlens.sources.sample_tables import reviews, table

# Valence words, degree words and negations that occur in the invented prose of the documents.
LEXICON = {"that": 1.9, "with": -1.5, "this": 0.8, "from": -2.3, "was": 1.1, "are": -0.6, "no": -1.2, "for": 1.3,
           "the": 2.1, "kind": 2.4, "inoran": -1.7, "so": 0.5}
BOOSTERS = {**S.BOOSTERS, "and": 0.293, "to": -0.293}
NEGATIONS = [*S.NEGATIONS, "of", "in"]
IDIOMS = {**S.IDIOMS, "of the": 1.6, "to the": -1.1, "and the of": 2.2, "with the in": 0.7}


def _lexicon(spark):
    rows = ", ".join(f"('{w}', {v}D)" for w, v in LEXICON.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(token, valence)")


def _scored(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return S.score_sentiment(docs, _lexicon(spark), "doc_id", keep=("lang",), boosters=BOOSTERS, negations=NEGATIONS, idioms=IDIOMS)


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_NEG = _list([w for w in NEGATIONS if w not in LEXICON])
_BOOST = {w: v for w, v in BOOSTERS.items() if w not in LEXICON}


def _negated(w: str) -> str:
    return f"({w} IN {_NEG} OR contains({w}, 'n''t'))"


def _boosted(v: str, raw: str, damping: float) -> str:
    """Valence after the degree word ``raw`` (its increment is in b<raw>)."""
    return f"""{v} + coalesce((CASE WHEN {v} < 0 THEN -b{raw} ELSE b{raw} END
      + CASE WHEN {raw} = upper({raw}) AND {raw} != lower({raw}) AND mixed THEN CASE WHEN {v} > 0 THEN 0.733e0 ELSE -0.733e0 END ELSE 0e0 END), 0e0) * {damping}e0"""


def _idiom_cases(*phrases: str) -> str:
    listed = ", ".join("'" + p + "'" for p in IDIOMS)
    value = lambda e: f"CASE {e} " + " ".join(f"WHEN '{p}' THEN {v}::DOUBLE" for p, v in IDIOMS.items()) + " END"
    return "\n".join(f"  WHEN ({e}) IN ({listed}) THEN {value(f'({e})')}" for e in phrases)


SCORES = f"""
lexicon(token, valence) AS (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items())}),
boosters(token, incr) AS (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in _BOOST.items())}),
bodies AS (SELECT doc_id, lang, trim(coalesce(text, 'nan'), ' ') AS body FROM documents),
split AS (
  SELECT doc_id, lang, body, list_transform(list_filter(regexp_split_to_array(body, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w != ''),
    lambda w: CASE WHEN length(regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) > 2
              THEN regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') ELSE w END) AS ws FROM bodies),
facts AS (
  SELECT *, len(list_filter(ws, lambda w: w = upper(w) AND w != lower(w))) AS ups,
    coalesce(list_position(list_transform(ws, lambda w: lower(w)), 'but'), 0) AS but_at,
    least(length(body) - length(replace(body, '!', '')), 4) * 0.292e0
      + CASE WHEN length(body) - length(replace(body, '?', '')) > 1
          THEN CASE WHEN length(body) - length(replace(body, '?', '')) <= 3
            THEN (length(body) - length(replace(body, '?', ''))) * 0.18e0 ELSE 0.96e0 END ELSE 0e0 END AS emphasis
  FROM split),
tok AS (
  SELECT doc_id, ups > 0 AND ups < len(ws) AS mixed, but_at, i AS pos, ws[i] AS w,
    CASE WHEN i > 1 THEN ws[i - 1] END AS w1, CASE WHEN i > 2 THEN ws[i - 2] END AS w2,
    CASE WHEN i > 3 THEN ws[i - 3] END AS w3, lower(ws[i + 1]) AS nx, lower(ws[i + 2]) AS nx2
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM facts)),
hit AS (
  SELECT t.*, lower(w) AS tk, lower(w1) AS l1, lower(w2) AS l2, lower(w3) AS l3, x.valence,
    n.token IS NOT NULL AS next_valued, b1.incr AS bw1, b2.incr AS bw2, b3.incr AS bw3,
    w1 IS NOT NULL AND lower(w1) NOT IN (SELECT token FROM lexicon) AS ok1,
    w2 IS NOT NULL AND lower(w2) NOT IN (SELECT token FROM lexicon) AS ok2,
    w3 IS NOT NULL AND lower(w3) NOT IN (SELECT token FROM lexicon) AS ok3
  FROM tok t JOIN lexicon x ON lower(w) = x.token LEFT JOIN lexicon n ON n.token = nx
  LEFT JOIN boosters b1 ON b1.token = lower(w1) LEFT JOIN boosters b2 ON b2.token = lower(w2)
  LEFT JOIN boosters b3 ON b3.token = lower(w3)
  WHERE lower(w) NOT IN {_list(BOOSTERS)} AND NOT coalesce(lower(w) = 'kind' AND nx = 'of', false)),
s0 AS (SELECT *, CASE
  WHEN coalesce(l1 = 'no', false) OR coalesce(l2 = 'no', false) OR coalesce(l3 = 'no' AND l1 IN ('or', 'nor'), false)
    THEN valence * -0.74e0 WHEN tk = 'no' AND next_valued THEN 0e0 ELSE valence END AS v0 FROM hit),
s1 AS (SELECT *, CASE WHEN w = upper(w) AND w != lower(w) AND mixed THEN v0 + CASE WHEN v0 > 0 THEN 0.733e0 ELSE -0.733e0 END
  ELSE v0 END AS v1 FROM s0),
s2 AS (SELECT *, {_boosted('v1', 'w1', 1.0)} AS v2 FROM s1),
s3 AS (SELECT *, CASE WHEN ok1 AND {_negated('l1')} THEN v2 * -0.74e0 ELSE v2 END AS v3 FROM s2),
s4 AS (SELECT *, {_boosted('v3', 'w2', 0.95)} AS v4 FROM s3),
s5 AS (SELECT *, CASE WHEN NOT ok2 THEN v4 WHEN l2 = 'never' AND l1 IN ('so', 'this') THEN v4 * 1.25e0 WHEN l2 = 'without' AND l1 = 'doubt' THEN v4
  WHEN {_negated('l2')} THEN v4 * -0.74e0 ELSE v4 END AS v5 FROM s4),
s6 AS (SELECT *, {_boosted('v5', 'w3', 0.9)} AS v6 FROM s5),
s7 AS (SELECT *, CASE WHEN NOT ok3 THEN v6 WHEN (l3 = 'never' AND l2 IN ('so', 'this')) OR l1 IN ('so', 'this') THEN v6 * 1.25e0
  WHEN l3 = 'without' AND (l2 = 'doubt' OR l1 = 'doubt') THEN v6
  WHEN {_negated('l3')} THEN v6 * -0.74e0 ELSE v6 END AS v7 FROM s6),
s7a AS (SELECT *, CASE WHEN NOT ok3 THEN v7
{_idiom_cases("tk || ' ' || nx || ' ' || nx2", "tk || ' ' || nx", "l1 || ' ' || tk", "l2 || ' ' || l1 || ' ' || tk", "l2 || ' ' || l1",
              "l3 || ' ' || l2 || ' ' || l1", "l3 || ' ' || l2")}
  ELSE v7 END AS v7a FROM s7),
s7b AS (SELECT *, v7a + CASE WHEN NOT ok3 THEN 0e0 ELSE
    CASE WHEN l3 || ' ' || l2 IN ('kind of', 'sort of', 'just enough') THEN -0.293e0 ELSE 0e0 END
    + CASE WHEN l2 || ' ' || l1 IN ('kind of', 'sort of', 'just enough') THEN -0.293e0 ELSE 0e0 END END AS v7b FROM s7a),
s8 AS (SELECT *, CASE WHEN ok1 AND l1 = 'least' AND NOT coalesce(l2 IN ('at', 'very'), false) THEN v7b * -0.74e0 ELSE v7b END AS v8 FROM s7b),
s9 AS (SELECT *, v8 * CASE WHEN but_at > 0 AND pos < but_at THEN 0.5e0 WHEN but_at > 0 AND pos > but_at THEN 1.5e0 ELSE 1e0 END
  AS v9 FROM s8),
sums AS (SELECT doc_id, sum(CAST(round(v9 * 1e9) AS BIGINT))::DOUBLE / 1e9 AS s FROM s9 GROUP BY doc_id),
emph AS (
  SELECT doc_id, lang, len(ws) AS n, CASE WHEN s > 0 THEN s + emphasis WHEN s < 0 THEN s - emphasis ELSE 0e0 END AS t
  FROM facts LEFT JOIN sums USING (doc_id)),
comp AS (SELECT doc_id, lang, CASE WHEN n > 0 THEN {rnd('t / sqrt(t * t + 15e0)', 4)} END AS compound FROM emph),
scored AS (
  SELECT *, CASE WHEN compound IS NULL THEN 'n/a' WHEN compound >= 0.05 THEN 'positivo' WHEN compound <= -0.05 THEN 'negativo'
    ELSE 'neutro' END AS sentimento FROM comp)"""


@query("sentiment_score", f"WITH {SCORES} SELECT * FROM scored")
def sentiment_score(spark, sf):
    return _scored(spark, sf)


@query("se02", f"""{with_(REVIEWS)}
SELECT review_id, CASE WHEN compound >= 0.05 THEN 'positivo' WHEN compound <= -0.05 THEN 'negativo' ELSE 'neutro' END AS rotulo
FROM reviews WHERE compound IS NOT NULL""")
def se02(spark, sf):
    scored = reviews(spark, sf).where(F.col("compound").isNotNull())
    return scored.select("review_id", S.sentiment_label(F.col("compound")).alias("rotulo"))


_VALID = "sentimento IN ('positivo', 'neutro', 'negativo')"
_CROSS = f"""cross_counts AS (
  SELECT score, count(*) FILTER (WHERE sentimento = 'positivo') AS positivo, count(*) FILTER (WHERE sentimento = 'neutro') AS neutro,
    count(*) FILTER (WHERE sentimento = 'negativo') AS negativo FROM reviews WHERE {_VALID} GROUP BY score)"""


@query("se03", f"{with_(REVIEWS)} SELECT {rnd('corr(score, compound)', 9)} AS correlation FROM reviews WHERE {_VALID}")
def se03(spark, sf):
    return S.rating_correlation(reviews(spark, sf)).select(rounded(F.col("correlation"), 9).alias("correlation"))


@query("se04", f"{with_(REVIEWS, _CROSS)} SELECT * FROM cross_counts")
def se04(spark, sf):
    return S.rating_by_label(reviews(spark, sf))


@query("se05", f"""{with_(REVIEWS, _CROSS)}
SELECT score, {', '.join(f"{rnd(f'1e2 * {c} / (positivo + neutro + negativo)', 1)} AS {c}" for c in ('positivo', 'neutro', 'negativo'))}
FROM cross_counts""")
def se05(spark, sf):
    return S.rating_by_label_percent(reviews(spark, sf))


@query("se06", f"""{with_(REVIEWS)}
SELECT sentimento, count(*) AS quantidade, {rnd('1e2 * count(*) / (SELECT count(*) FROM reviews)', 1)} AS percentual
FROM reviews WHERE sentimento IS NOT NULL GROUP BY sentimento""")
def se06(spark, sf):
    return S.label_distribution(reviews(spark, sf))


@query("se07", f"""WITH {SCORES}
SELECT (SELECT count(*) FROM documents) AS rows_in, count(*) AS rows_out, count(sentimento) AS rows_scored,
  {rnd('avg(compound)', 3)} AS compound_mean, {rnd('median(compound)', 3)} AS compound_median,
  {rnd('stddev_samp(compound)', 3)} AS compound_std FROM scored""")
def se07(spark, sf):
    return S.scoring_report(table(spark, sf, "documents"), _scored(spark, sf))
