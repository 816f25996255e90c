"""Analytical queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from entry_queries import ORACLES, query
from entry_queries.sql import BOOKS, REVIEWS, TEXT_REVIEWS, USER_REVIEWS, metrics, rnd, with_
from reviewlens.plans import reports as R
from reviewlens.plans.review_fold import add_reviews, read_fold
from reviewlens.session import scratch_path
from reviewlens.sources.sample_tables import books, reviews

_BOOK = "title_std AS titulo; authors_std AS autor; categories_std AS categoria"
_FIRST = "trim(split_part(categories_std, ',', 1))"


def _score(expr: str, name: str) -> str:
    return f"{rnd(expr, 1)} AS {name}"


Q01 = f"""{metrics(_BOOK)}
SELECT titulo, autor, categoria, n AS total_reviews, n_neg AS reviews_negativos, {rnd('g', 1)} AS pct_negativo,
  {rnd('a', 3)} AS compound_medio,
  {rnd('g * 0.6e0 + (CASE WHEN a < 0 THEN abs(a) * 1e2 ELSE 0e0 END) * 0.4e0', 1)} AS problema_score
FROM m WHERE n >= 5 ORDER BY problema_score DESC, titulo, autor, categoria LIMIT 20"""


@query("q01", Q01)
def q01(spark, sf):
    return R.problematic_books(books(spark, sf), reviews(spark, sf))


Q02 = f"""{with_(BOOKS, USER_REVIEWS)},
joined AS (
  SELECT r.*, CASE WHEN b.categories_std IS NOT NULL AND b.categories_std != ''
              THEN split_part(b.categories_std, ',', 1) END AS theme
  FROM reviews r LEFT JOIN books b ON r.title = b.title_std
  WHERE user_id IS NOT NULL AND sentimento IS NOT NULL),
m AS (
  SELECT user_id, count(*) AS n, count(DISTINCT sentimento) AS labels, count(DISTINCT theme) AS themes,
    count(*) FILTER (WHERE sentimento = 'positivo') AS n_pos,
    count(*) FILTER (WHERE sentimento = 'negativo') AS n_neg,
    count(*) FILTER (WHERE sentimento = 'neutro') AS n_neu,
    sum(CAST(round(compound * 1e6) AS BIGINT))::DOUBLE / 1e6 / count(compound) AS a
  FROM joined GROUP BY user_id HAVING count(*) >= 3)
SELECT user_id,
  CASE WHEN a > 0.3 THEN 'Otimista' WHEN a < -0.1 THEN 'Crítico' WHEN labels >= 3 THEN 'Equilibrado'
       WHEN n > 20 THEN 'Ativo' ELSE 'Regular' END AS segmento,
  n AS total_reviews, labels AS sentimentos_diversos, themes AS categorias_diversas,
  n_pos AS reviews_positivos, n_neg AS reviews_negativos, n_neu AS reviews_neutros,
  {rnd('a', 3)} AS compound_medio, {rnd('n * 0.3e0 + labels * 10 + themes * 5', 1)} AS diversidade_score
FROM m ORDER BY diversidade_score DESC, total_reviews DESC, user_id"""


@query("q02", Q02 + " LIMIT 50")
def q02(spark, sf):
    return R.users_for_interview(books(spark, sf), reviews(spark, sf, user=True))


def _roi(keys: str, name: str, where: str, having: str) -> str:
    return f"""{metrics(keys, where)}
SELECT {name}, t AS total_livros, n AS total_reviews, {rnd('per_book', 2)} AS reviews_por_livro,
  {rnd('a', 3)} AS sentimento_medio, {rnd('p', 1)} AS pct_positivo,
  {rnd('per_book * (a + 1e0) * ln(t + 1) / 1e1', 2)} AS roi_estimado
FROM m WHERE {having} AND {name} IS NOT NULL AND {name} != ''
ORDER BY roi_estimado DESC, {name} LIMIT 20"""


Q03 = _roi(f"{_FIRST} AS categoria", "categoria", "categories_std IS NOT NULL AND categories_std != ''", "t >= 5")
Q04 = _roi("authors_std AS autor", "autor", "authors_std IS NOT NULL AND authors_std != ''", "t >= 2")


@query("q03", Q03)
def q03(spark, sf):
    return R.roi_by_category(books(spark, sf), reviews(spark, sf))


@query("q04", Q04)
def q04(spark, sf):
    return R.roi_by_author(books(spark, sf), reviews(spark, sf))


# Written from the rule: what a label says is -1, 0 or 1; a polarity of the other sign, or any beside 0, contradicts it from
# the limits of this list on, the gravest level first.
_LEVELS = [("Alto", 0.3, None), ("Médio", 0.1, 0.3), ("Baixo", None, 0.05)]
_LEVEL_ROWS = ", ".join(f"({k}, '{name}', {'NULL' if signed is None else f'{signed}e0'}, {'NULL' if beside is None else f'{beside}e0'})"
                        for k, (name, signed, beside) in enumerate(_LEVELS))
Q05 = f"""{with_(TEXT_REVIEWS)},
levels(place, name, signed, beside) AS (VALUES {_LEVEL_ROWS}),
said AS (
  SELECT title, text, compound, sentimento, list_position(['negativo', 'neutro', 'positivo'], sentimento) - 2 AS says FROM reviews
  WHERE compound IS NOT NULL AND length(text) > 10),
judged AS (
  SELECT *, (SELECT min(place) FROM levels WHERE CASE says WHEN 0 THEN abs(compound) >= beside ELSE -says * compound >= signed END) AS place
  FROM said WHERE says IS NOT NULL)
SELECT title AS titulo, left(text, 200) AS review_preview, sentimento AS sentimento_classificado,
  ['negativo', 'neutro', 'positivo'][2 + (compound >= 0.05e0)::INT - (compound <= -0.05e0)::INT] AS sentimento_esperado,
  {rnd('compound', 3)} AS compound_score, name AS nivel_discrepancia, {rnd('abs(compound - says * 0.5e0)', 3)} AS score_discrepancia
FROM judged JOIN levels USING (place)
ORDER BY place, score_discrepancia DESC, titulo, review_preview, sentimento_classificado LIMIT 50"""


@query("q05", Q05)
def q05(spark, sf):
    return R.sentiment_discrepancies(reviews(spark, sf, text=True))


# Points for the number of reviews.
_TIER6 = "CASE WHEN n <= 10 THEN 5 WHEN n <= 50 THEN 15 WHEN n <= 100 THEN 25 ELSE 35 END"
_TIER7 = "CASE WHEN n <= 10 THEN 2 WHEN n <= 50 THEN 6 WHEN n <= 100 THEN 10 ELSE 14 END"
Q06 = f"""{metrics(_BOOK)}
SELECT titulo, autor, categoria, n AS total_reviews, {rnd('a', 3)} AS sentimento_medio, {rnd('p', 1)} AS pct_positivo,
  {_score(f'(a + 1e0) * 5e1 + p * 0.3e0 + {_TIER6}', 'performance_score')}
FROM m WHERE n >= 10 ORDER BY performance_score DESC, titulo, autor, categoria LIMIT 20"""
Q07 = f"""{metrics(_BOOK)}
SELECT titulo, autor, categoria, n AS total_reviews, {rnd('a', 3)} AS sentimento_medio, {rnd('g', 1)} AS pct_negativo,
  {_score(f'(1e0 - a) * 5e1 + g * 0.5e0 + {_TIER7}', 'problema_score')}
FROM m WHERE n >= 10 ORDER BY problema_score DESC, titulo, autor, categoria LIMIT 20"""


@query("q06", Q06)
def q06(spark, sf):
    return R.best_books(books(spark, sf), reviews(spark, sf))


@query("q07", Q07)
def q07(spark, sf):
    return R.worst_books(books(spark, sf), reviews(spark, sf))


def _ranking(keys: str, name: str, where: str, having: str, best: bool, score: str) -> str:
    share, pct, out = ("p", "pct_positivo", "performance_score") if best else ("g", "pct_negativo", "problema_score")
    return f"""{metrics(keys, where)}
SELECT {name}, t AS total_livros, n AS total_reviews, {rnd('per_book', 1)} AS reviews_por_livro,
  {rnd('a', 3)} AS sentimento_medio, {rnd(share, 1)} AS {pct}, {_score(score, out)}
FROM m WHERE {having} ORDER BY {out} DESC, {name} LIMIT 15"""


_PUB = ("publisher_std AS editora", "editora", "publisher_std IS NOT NULL AND publisher_std != ''", "t >= 3 AND n >= 20")
_THEME = (f"{_FIRST} AS tema", "tema", "categories_std IS NOT NULL AND categories_std != ''",
          "t >= 5 AND n >= 30 AND tema IS NOT NULL AND tema != ''")
Q08 = _ranking(*_PUB, True, """(a + 1e0) * 4e1 + p * 0.4e0
    + CASE WHEN t <= 3 THEN 10 WHEN t <= 10 THEN 20 WHEN t <= 20 THEN 30 ELSE 40 END
    + CASE WHEN n <= 20 THEN 5 WHEN n <= 100 THEN 15 WHEN n <= 500 THEN 25 ELSE 35 END""")
Q09 = _ranking(*_PUB, False, """(1e0 - a) * 4e1 + g * 0.6e0
    + CASE WHEN t <= 3 THEN 5 WHEN t <= 10 THEN 10 WHEN t <= 20 THEN 15 ELSE 20 END""")
Q10 = _ranking(*_THEME, True, "(a + 1e0) * 45e0 + p * 0.3e0 + ln(t + 1) * 8e0 + per_book * 2e0")
Q11 = _ranking(*_THEME, False, "(1e0 - a) * 45e0 + g * 0.5e0 + ln(t + 1) * 5e0")


@query("q08", Q08)
def q08(spark, sf):
    return R.best_publishers(books(spark, sf), reviews(spark, sf))


@query("q09", Q09)
def q09(spark, sf):
    return R.worst_publishers(books(spark, sf), reviews(spark, sf))


@query("q10", Q10)
def q10(spark, sf):
    return R.best_themes(books(spark, sf), reviews(spark, sf))


@query("q11", Q11)
def q11(spark, sf):
    return R.worst_themes(books(spark, sf), reviews(spark, sf))


# Names of the periods.
PERIOD = """CASE WHEN pub_year >= 2020 THEN '2020+' WHEN pub_year >= 2015 THEN '2015-2019'
  WHEN pub_year >= 2010 THEN '2010-2014' WHEN pub_year >= 2005 THEN '2005-2009'
  WHEN pub_year >= 2000 THEN '2000-2004' WHEN pub_year >= 1990 THEN '1990-1999' ELSE 'Antes de 1990' END"""
RECENCY = """CASE WHEN pub_year >= 2015 THEN 'Recente (2015+)' WHEN pub_year >= 2000 THEN 'Médio (2000-2014)'
  ELSE 'Antigo (antes 2000)' END"""

Q12 = f"""{metrics(f'{PERIOD} AS periodo', 'pub_year > 1950')}
SELECT periodo, t AS total_livros, n AS total_reviews, {rnd('per_book', 1)} AS reviews_por_livro,
  {rnd('a', 3)} AS sentimento_medio, {rnd('p', 1)} AS pct_positivo, {rnd('g', 1)} AS pct_negativo
FROM m WHERE t >= 10"""
Q13 = f"""{metrics('pub_year AS ano', 'pub_year BETWEEN 2000 AND 2024')}
SELECT ano, t AS total_livros, n AS total_reviews, a AS sentimento_medio, n_pos AS reviews_positivos,
  n_neg AS reviews_negativos, n_neu AS reviews_neutros, {rnd('per_book', 1)} AS reviews_por_livro
FROM m WHERE t >= 5"""
_Q14 = f"""{metrics(f'{RECENCY} AS categoria_periodo', 'pub_year > 1980')},
bands AS (
  SELECT categoria_periodo, t AS total_livros, n AS total_reviews, a AS sentimento_medio, p AS pct_positivo,
    {rnd('per_book', 1)} AS reviews_por_livro FROM m)"""
Q14 = _Q14 + " SELECT * FROM bands"
Q15 = _Q14 + """ SELECT r.sentimento_medio - o.sentimento_medio AS sentimento_trend,
  r.reviews_por_livro - o.reviews_por_livro AS reviews_trend, r.pct_positivo - o.pct_positivo AS positivo_trend
FROM bands r, bands o
WHERE r.categoria_periodo = 'Recente (2015+)' AND o.categoria_periodo = 'Antigo (antes 2000)'"""


@query("q12", Q12)
def q12(spark, sf):
    return R.reviews_by_period(books(spark, sf), reviews(spark, sf))


@query("q13", Q13)
def q13(spark, sf):
    return R.reviews_by_year(books(spark, sf), reviews(spark, sf), end_year=2024)


@query("q14", Q14)
def q14(spark, sf):
    return R.recency_comparison(books(spark, sf), reviews(spark, sf))


@query("q15", Q15)
def q15(spark, sf):
    return R.recency_trend(books(spark, sf), reviews(spark, sf))


_BOOK_YEAR = _BOOK + "; pub_year AS ano"
Q16 = f"""{metrics(_BOOK_YEAR, "contains(lower(title_std), 'red') OR contains(lower(authors_std), 'red')")}
SELECT titulo, autor, categoria, ano, n AS total_reviews, n_pos AS positivos, n_neg AS negativos, n_neu AS neutros,
  {rnd('a', 3)} AS sentimento_medio
FROM m WHERE n >= 5 ORDER BY n DESC, titulo, autor, categoria, ano LIMIT 10"""
INFO = f"""SELECT titulo, autor, categoria, ano AS ano_publicacao, n AS total_reviews, n_pos AS total_positivos,
  n_neg AS total_negativos, n_neu AS total_neutros, {rnd('a', 3)} AS sentimento_medio FROM m"""
ONE_TITLE = "red widget #1"


@query("q16", Q16)
def q16(spark, sf):
    return R.search_books(books(spark, sf), reviews(spark, sf), "Red")


@query("q17", f"{metrics(_BOOK_YEAR, f'''title_std = '{ONE_TITLE}' ''')} {INFO}")
def q17(spark, sf):
    return R.book_info(books(spark, sf), reviews(spark, sf), ONE_TITLE)


@query("q18", f"""{with_(TEXT_REVIEWS)}
SELECT text AS review_text, compound, sentimento FROM reviews
WHERE title = '{ONE_TITLE}' AND sentimento = 'positivo' AND length(trim(text)) > 20
ORDER BY abs(compound) DESC NULLS LAST, review_id LIMIT 10""")
def q18(spark, sf):
    return R.reviews_by_sentiment(reviews(spark, sf, text=True), ONE_TITLE, "positivo")


@query("q19", f"""{with_(TEXT_REVIEWS)},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sentimento ORDER BY abs(compound) DESC NULLS LAST, review_id) AS posicao
  FROM reviews WHERE title = '{ONE_TITLE}' AND length(trim(text)) > 20
    AND sentimento IN ('positivo', 'negativo', 'neutro'))
SELECT sentimento, CAST(posicao AS INTEGER) AS posicao, text AS review_text, compound FROM ranked
WHERE posicao <= CASE sentimento WHEN 'neutro' THEN 5 ELSE 10 END""")
def q19(spark, sf):
    return R.reviews_for_book(reviews(spark, sf, text=True), ONE_TITLE)


@query("q20", f"""{with_(USER_REVIEWS)}
SELECT (SELECT count(*) FROM part) AS total_books, count(sentimento) AS total_reviews,
  count(DISTINCT user_id) AS total_users,
  coalesce({rnd('sum(CAST(round(compound * 1e6) AS BIGINT))::DOUBLE / 1e6 / count(compound)', 3)}, 0e0) AS avg_sentiment
FROM reviews""")
def q20(spark, sf):
    return R.summary_stats(books(spark, sf), reviews(spark, sf, user=True))


@query("q21", f"""{with_(REVIEWS)}
SELECT sentimento, count(*) AS quantidade,
  {rnd('1e2 * count(*) / (SELECT count(sentimento) FROM reviews)', 1)} AS percentual
FROM reviews WHERE sentimento IS NOT NULL GROUP BY sentimento""")
def q21(spark, sf):
    return R.sentiment_distribution(reviews(spark, sf))


@query("q22", f"""{metrics(_BOOK)}
SELECT titulo, autor, categoria, n AS total_reviews, n_pos AS positivos, n_neg AS negativos,
  {rnd('a', 3)} AS sentimento_medio
FROM m WHERE n >= 10 ORDER BY n DESC, titulo, autor, categoria LIMIT 20""")
def q22(spark, sf):
    return R.books_to_summarise(books(spark, sf), reviews(spark, sf))


@query("q23", f"""{with_(BOOKS)}
SELECT authors_std AS autor, count(*) AS num_livros FROM books WHERE authors_std IS NOT NULL
GROUP BY authors_std ORDER BY num_livros DESC, autor LIMIT 5""")
def q23(spark, sf):
    return R.top_authors(books(spark, sf))


@query("q24", f"""{with_(REVIEWS)}
SELECT sentimento, count(*) AS count FROM reviews WHERE sentimento IS NOT NULL GROUP BY sentimento""")
def q24(spark, sf):
    return R.sentiment_counts(reviews(spark, sf))


@query("q25", f"""{with_(BOOKS)}
SELECT CAST(pub_year // 10 * 10 AS INTEGER) AS decada, count(*) AS num_livros FROM books WHERE pub_year > 1900
GROUP BY decada ORDER BY decada DESC LIMIT 5""")
def q25(spark, sf):
    return R.books_by_decade(books(spark, sf))


# The same reports from the review fold, into which the reviews came in two batches. --------------------------


def _folded(spark, sf):
    rows, path = reviews(spark, sf), scratch_path(spark, "fold")
    late = F.pmod(F.xxhash64("review_id"), F.lit(3)) == 0
    add_reviews(rows.where(~late), path, "1")
    add_reviews(rows.where(late), path, "2")
    return read_fold(spark, path)


FOLDED = {
    "q01": R.problematic_books, "q03": R.roi_by_category, "q04": R.roi_by_author, "q06": R.best_books, "q07": R.worst_books,
    "q08": R.best_publishers, "q09": R.worst_publishers, "q10": R.best_themes, "q11": R.worst_themes, "q12": R.reviews_by_period,
    "q13": partial(R.reviews_by_year, end_year=2024), "q14": R.recency_comparison, "q15": R.recency_trend,
    "q16": lambda b, r: R.search_books(b, r, "Red"), "q17": lambda b, r: R.book_info(b, r, ONE_TITLE), "q22": R.books_to_summarise,
}
for _name in ("q01", "q04", "q12", "q16", "q22"):
    query(f"{_name}_fold", ORACLES[_name])(lambda spark, sf, report=FOLDED[_name]: report(books(spark, sf), _folded(spark, sf)))
