"""Reports over the ranked queries, and summary inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from entry_queries import query
from entry_queries import reports_q as Q
from entry_queries.sql import BOOKS, TEXT_REVIEWS, rnd, with_
from reviewlens.plans import dashboard as D
from reviewlens.plans import reports as R
from reviewlens.plans import summaries as S
from reviewlens.sources.sample_tables import books, review_keys, reviews


def _over(sql: str) -> str:
    return f"WITH ranked AS ({sql})\n"


@query("rp01", _over(Q.Q01) + """SELECT count(*) FILTER (WHERE problema_score > 50) AS alto_risco,
  count(*) FILTER (WHERE problema_score > 25 AND problema_score <= 50) AS medio_risco,
  count(*) FILTER (WHERE problema_score <= 25) AS baixo_risco FROM ranked""")
def rp01(spark, sf):
    return D.risk_counts(R.problematic_books(books(spark, sf), reviews(spark, sf)))


@query("rp02", _over(Q.Q01) + """SELECT *, substr(titulo, 1, 60) || '...' AS titulo_curto,
  substr(autor, 1, 30) || '...' AS autor_curto FROM ranked WHERE problema_score >= 40""")
def rp02(spark, sf):
    return D.with_minimum_score(R.problematic_books(books(spark, sf), reviews(spark, sf)), 40)


@query("rp03", _over(Q.Q02 + " LIMIT 50") + "SELECT * FROM ranked WHERE segmento = 'Equilibrado' AND total_reviews >= 5")
def rp03(spark, sf):
    users = R.users_for_interview(books(spark, sf), reviews(spark, sf, user=True))
    return D.select_users(users, "Equilibrado", 5)


@query("rp03_before_limit", _over(Q.Q02) + """SELECT * FROM ranked WHERE segmento = 'Crítico' AND total_reviews >= 5
ORDER BY diversidade_score DESC, total_reviews DESC, user_id LIMIT 50""")
def rp03_before_limit(spark, sf):
    return D.select_users_before_limit(books(spark, sf), reviews(spark, sf, user=True), "Crítico", 5)


@query("rp04", _over(Q.Q02 + " LIMIT 50") + f"""SELECT count(*) AS total_selecionados,
  {rnd('avg(total_reviews)', 1)} AS media_reviews,
  {rnd('sum(CAST(diversidade_score AS DECIMAL(18,6)))::DOUBLE / count(diversidade_score)', 1)} AS score_medio,
  {rnd('sum(CAST(compound_medio AS DECIMAL(18,6)))::DOUBLE / count(compound_medio)', 3)} AS sentimento_medio
FROM ranked""")
def rp04(spark, sf):
    return D.user_profile(R.users_for_interview(books(spark, sf), reviews(spark, sf, user=True)))


@query("rp05", _over(Q.Q02 + " LIMIT 50") + "SELECT segmento, count(*) AS usuarios FROM ranked GROUP BY segmento")
def rp05(spark, sf):
    return D.segment_counts(R.users_for_interview(books(spark, sf), reviews(spark, sf, user=True)))


@query("rp06", _over(Q.Q03) + """SELECT (SELECT categoria FROM ranked ORDER BY roi_estimado DESC, categoria LIMIT 1) AS melhor,
  max(roi_estimado) AS melhor_roi, count(*) AS total FROM ranked""")
def rp06(spark, sf):
    return D.roi_headline(R.roi_by_category(books(spark, sf), reviews(spark, sf)), "categoria")


@query("rp06_author", _over(Q.Q04) + """SELECT (SELECT autor FROM ranked ORDER BY roi_estimado DESC, autor LIMIT 1) AS melhor,
  max(roi_estimado) AS melhor_roi, count(*) AS total FROM ranked""")
def rp06_author(spark, sf):
    return D.roi_headline(R.roi_by_author(books(spark, sf), reviews(spark, sf)), "autor")


@query("rp07", _over(Q.Q05) + """SELECT count(*) FILTER (WHERE nivel_discrepancia = 'Alto') AS alto,
  count(*) FILTER (WHERE nivel_discrepancia = 'Médio') AS medio,
  count(*) FILTER (WHERE nivel_discrepancia = 'Baixo') AS baixo, count(*) AS total FROM ranked""")
def rp07(spark, sf):
    return D.level_counts(R.sentiment_discrepancies(reviews(spark, sf, text=True)))


@query("rp07_critical", _over(Q.Q05) + """SELECT * FROM ranked WHERE nivel_discrepancia = 'Alto'
ORDER BY score_discrepancia DESC, titulo, review_preview, sentimento_classificado LIMIT 5""")
def rp07_critical(spark, sf):
    return D.critical_cases(R.sentiment_discrepancies(reviews(spark, sf, text=True)))


@query("rp08", f"""WITH best AS ({Q.Q10}), worst AS ({Q.Q11})
SELECT * FROM (SELECT tema, 'Melhores' AS categoria, performance_score AS score, sentimento_medio FROM best
  ORDER BY performance_score DESC, tema LIMIT 8)
UNION ALL
SELECT * FROM (SELECT tema, 'Piores' AS categoria, problema_score AS score, sentimento_medio FROM worst
  ORDER BY problema_score DESC, tema LIMIT 8)""")
def rp08(spark, sf):
    b, r = books(spark, sf), reviews(spark, sf)
    return D.theme_comparison(R.best_themes(b, r), R.worst_themes(b, r))


def _sign(c: str, up: str, down: str) -> str:
    return f"CASE WHEN {c} > 0 THEN '{up}' WHEN {c} < 0 THEN '{down}' ELSE 'Estável' END"


@query("rp09", _over(Q.Q15) + f"""SELECT {_sign('sentimento_trend', 'Melhorando', 'Piorando')} AS sentimento,
  {_sign('reviews_trend', 'Aumentando', 'Diminuindo')} AS engajamento,
  {_sign('positivo_trend', 'Melhorando', 'Piorando')} AS positivo FROM ranked""")
def rp09(spark, sf):
    return D.trend_wording(R.recency_trend(books(spark, sf), reviews(spark, sf)))


@query("rp10", _over(Q.Q05) + """SELECT *, CASE nivel_discrepancia WHEN 'Alto' THEN 'Revisar classificação manualmente'
  WHEN 'Médio' THEN 'Validar com mais dados' ELSE 'Monitorar tendência' END AS acao,
  substr(review_preview, 1, 100) || '...' AS review_curto FROM ranked""")
def rp10(spark, sf):
    return D.with_action(R.sentiment_discrepancies(reviews(spark, sf, text=True)))


@query("rp11", _over(Q.Q12) + """SELECT periodo, 'pct_positivo' AS tipo, pct_positivo AS percentual FROM ranked
UNION ALL SELECT periodo, 'pct_negativo', pct_negativo FROM ranked""")
def rp11(spark, sf):
    return D.share_by_period(R.reviews_by_period(books(spark, sf), reviews(spark, sf)))


@query("rp12", _over(Q.Q06) + """SELECT titulo, autor, performance_score, sentimento_medio FROM ranked
ORDER BY performance_score DESC, titulo LIMIT 5""")
def rp12(spark, sf):
    ranking = R.best_books(books(spark, sf), reviews(spark, sf))
    order = [F.desc("performance_score"), "titulo"]
    return D.head_of(ranking, order, 5, ["titulo", "autor", "performance_score", "sentimento_medio"])


@query("rp12_years", _over(Q.Q13) + "SELECT * FROM ranked ORDER BY ano DESC LIMIT 15")
def rp12_years(spark, sf):
    yearly = R.reviews_by_year(books(spark, sf), reviews(spark, sf))
    return D.head_of(yearly, [F.desc("ano")], 15, yearly.columns)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_case() -> str:
    arms = []
    for name, (kind, requests) in S._KINDS.items():
        head, tail = S._OPENING.format(kind=kind), S._REQUEST + requests + S._CLOSING
        arms.append(f"WHEN '{name}' THEN {_quoted(head)} || body || {_quoted(tail)}")
    return "CASE sentimento " + " ".join(arms) + " END"


PROMPTS = f"""{with_(BOOKS, TEXT_REVIEWS)},
picked AS (
  SELECT title, sentimento, substr(text, 1, 200) AS head,
    row_number() OVER (PARTITION BY title, sentimento ORDER BY abs(compound) DESC NULLS LAST, review_id) AS pos
  FROM reviews
  WHERE title IS NOT NULL AND sentimento IN ('positivo', 'negativo', 'neutro') AND length(trim(text)) > 20),
grouped AS (
  SELECT title, sentimento, count(*) AS total_reviews,
    string_agg('- ' || head || '...', chr(10) || chr(10) ORDER BY pos) FILTER (WHERE pos <= 8) AS body,
    list(head ORDER BY pos) AS shown
  FROM picked WHERE pos <= CASE sentimento WHEN 'neutro' THEN 5 ELSE 10 END GROUP BY title, sentimento),
prompts AS (SELECT title, sentimento, total_reviews, {_prompt_case()} AS prompt, shown FROM grouped)"""

_REC = """CASE WHEN s > 0.3 AND pos > 70 THEN {0} WHEN s > 0.1 AND pos > 60 THEN {1}
  WHEN s < -0.1 OR pos < 40 THEN {2} ELSE {3} END"""
_TIER = _REC.format(*map(_quoted, (S.PROMOTE, S.KEEP, S.REVIEW, S.MONITOR)))
_PRIORITY = _REC.format(*map(_quoted, (S.HIGH, S.MEDIUM, S.HIGH, S.LOW)))
INSIGHTS = f"""
info AS ({Q.metrics(Q._BOOK_YEAR)} {Q.INFO}),
rates AS (SELECT *, sentimento_medio AS s, total_positivos / total_reviews::DOUBLE * 1e2 AS pos,
  total_negativos / total_reviews::DOUBLE * 1e2 AS neg FROM info),
insights AS (
  SELECT * EXCLUDE (s, pos, neg), pos AS positive_rate, neg AS negative_rate,
    {_TIER} || CASE WHEN total_reviews < 10 THEN {_quoted(S.FEW_REVIEWS)}
      WHEN total_reviews > 100 THEN {_quoted(S.MANY_REVIEWS)} ELSE '' END AS recommendation,
    {_PRIORITY} AS business_priority FROM rates)"""


@query("ai_prompt", PROMPTS + " SELECT * FROM prompts")
def ai_prompt(spark, sf):
    return S.prompts_by_key(**review_keys(spark, sf))


@query("ai_recommendation", f"WITH {INSIGHTS} SELECT * FROM insights")
def ai_recommendation(spark, sf):
    return S.recommendations(R.books_info(books(spark, sf), reviews(spark, sf)))


_LABELS = ("positivo", "negativo", "neutro")


@query("ai_report", PROMPTS + f""", {INSIGHTS},
wide AS (
  SELECT title, {', '.join(f"max(prompt) FILTER (WHERE sentimento = '{x}') AS prompt_{x}" for x in _LABELS)},
    {', '.join(f"max(total_reviews) FILTER (WHERE sentimento = '{x}') AS reviews_{x}" for x in _LABELS)},
    {', '.join(f"max(shown) FILTER (WHERE sentimento = '{x}') AS texts_{x}" for x in _LABELS)}
  FROM prompts GROUP BY title)
SELECT i.*, {', '.join(f"CASE WHEN prompt_{x} IS NULL THEN 'Nenhum review {x}s encontrado' END AS message_{x}" for x in _LABELS)},
  {', '.join(f"texts_{x}, prompt_{x}, coalesce(reviews_{x}, 0) AS reviews_{x}" for x in _LABELS)},
  {', '.join(f"CASE WHEN prompt_{x} IS NULL THEN 'no_data' ELSE 'ready' END AS status_{x}" for x in _LABELS)},
  CAST(NULL AS VARCHAR) AS summary
FROM insights i LEFT JOIN wide ON titulo = title""")
def ai_report(spark, sf):
    return S.reports_by_key(books(spark, sf), reviews(spark, sf), **review_keys(spark, sf))
