"""The analytical query library.

Each function takes a catalogue (``book_id, title_std, authors_std, publisher_std, categories_std, pub_year``) and/or
reviews (``review_id, title, user_id, text, score, sentimento, compound``) and returns a lazy DataFrame. Ranked
reports are ordered by the rounded score and then by their natural key, so ties are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.functions.numeric import (
    percent,
    polarity_mean,
    polarity_units,
    rounded,
)
from reviewlens.functions.text import (
    PERIOD_BANDS,
    PERIOD_OLDEST,
    RECENCY_BANDS,
    RECENCY_OLDEST,
    band_rank,
    decade,
    first_category,
    period_band,
    preview,
    recency_band,
)
from reviewlens.operators.lookup import frequent_keys, having_key
from reviewlens.operators.ranking import top_per_group
from reviewlens.plans.metrics import (
    NEGATIVE,
    NEUTRAL,
    POSITIVE,
    review_metrics,
    tier,
)


def _book_keys() -> dict[str, Column]:
    return {"titulo": F.col("title_std"), "autor": F.col("authors_std"), "categoria": F.col("categories_std")}


def _present(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def _count(name: str, alias: str) -> Column:
    return F.col(name).alias(alias)


# Books ----------------------------------------------------------------------------------------------------


def problematic_books(books: DataFrame, reviews: DataFrame, limit: int = 20) -> DataFrame:
    m = review_metrics(books, reviews, _book_keys()).where(F.col("n") >= 5)
    penalty = F.when(F.col("a") < 0, F.abs(F.col("a")) * 100.0).otherwise(0.0)
    return (
        m.select(
            "titulo",
            "autor",
            "categoria",
            _count("n", "total_reviews"),
            _count("n_neg", "reviews_negativos"),
            rounded(F.col("g"), 1).alias("pct_negativo"),
            rounded(F.col("a"), 3).alias("compound_medio"),
            rounded(F.col("g") * 0.6 + penalty * 0.4, 1).alias("problema_score"),
        )
        .orderBy(F.desc("problema_score"), "titulo", "autor", "categoria")
        .limit(limit)
    )


def best_books(books: DataFrame, reviews: DataFrame, limit: int = 20) -> DataFrame:
    m = review_metrics(books, reviews, _book_keys()).where(F.col("n") >= 10)
    volume = tier(F.col("n"), [(10, 5), (50, 15), (100, 25)], 35)
    score = (F.col("a") + 1.0) * 50.0 + F.col("p") * 0.3 + volume
    return (
        m.select(
            "titulo",
            "autor",
            "categoria",
            _count("n", "total_reviews"),
            rounded(F.col("a"), 3).alias("sentimento_medio"),
            rounded(F.col("p"), 1).alias("pct_positivo"),
            rounded(score, 1).alias("performance_score"),
        )
        .orderBy(F.desc("performance_score"), "titulo", "autor", "categoria")
        .limit(limit)
    )


def worst_books(books: DataFrame, reviews: DataFrame, limit: int = 20) -> DataFrame:
    m = review_metrics(books, reviews, _book_keys()).where(F.col("n") >= 10)
    volume = tier(F.col("n"), [(10, 2), (50, 6), (100, 10)], 14)
    score = (1.0 - F.col("a")) * 50.0 + F.col("g") * 0.5 + volume
    return (
        m.select(
            "titulo",
            "autor",
            "categoria",
            _count("n", "total_reviews"),
            rounded(F.col("a"), 3).alias("sentimento_medio"),
            rounded(F.col("g"), 1).alias("pct_negativo"),
            rounded(score, 1).alias("problema_score"),
        )
        .orderBy(F.desc("problema_score"), "titulo", "autor", "categoria")
        .limit(limit)
    )


# Users ----------------------------------------------------------------------------------------------------


def interview_candidates(books: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every user with at least three labelled reviews, scored and segmented.

    Reviews fold to (user, title, label) and the catalogue to (title, theme) with a row count before they meet, so
    neither a popular title nor a title listed many times multiplies single reviews.
    """
    folded = (
        reviews.where(F.col("user_id").isNotNull() & F.col("sentimento").isNotNull())
        .groupBy("user_id", "title", "sentimento")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(polarity_units(F.col("compound"))).alias("polarity_sum"),
            F.count("compound").alias("polarity_n"),
        )
    )
    themes = (
        books.where(F.col("title_std").isNotNull())
        .select(
            "title_std",
            F.when(_present("categories_std"), first_category(F.col("categories_std"), trim=False)).alias("theme"),
        )
        .groupBy("title_std", "theme")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # Rows without a title match nothing: a key of their own per user keeps them off one reducer.
    key = F.coalesce("title", F.concat(F.lit("\u0000"), F.col("user_id")))
    weighted = folded.join(themes, key == F.col("title_std"), "left").withColumn(
        "w", F.coalesce(F.col("copies"), F.lit(1))
    )

    def volume(condition: Column | None = None) -> Column:
        rows = F.col("n") * F.col("w")
        return F.sum(rows if condition is None else F.when(condition, rows).otherwise(0))

    label = F.col("sentimento")
    activity = weighted.groupBy("user_id").agg(
        volume().alias("total_reviews"),
        F.size(F.collect_set("sentimento")).cast("long").alias("sentimentos_diversos"),
        F.count_distinct("theme").alias("categorias_diversas"),
        volume(label == POSITIVE).alias("reviews_positivos"),
        volume(label == NEGATIVE).alias("reviews_negativos"),
        volume(label == NEUTRAL).alias("reviews_neutros"),
        F.sum(F.col("polarity_sum") * F.col("w")).alias("polarity_sum"),
        F.sum(F.col("polarity_n") * F.col("w")).alias("polarity_n"),
    )
    a = F.col("compound_raw")
    return (
        activity.where(F.col("total_reviews") >= 3)
        .withColumn("compound_raw", polarity_mean(F.col("polarity_sum"), F.col("polarity_n")))
        .select(
            "user_id",
            F.when(a > 0.3, "Otimista")
            .when(a < -0.1, "Crítico")
            .when(F.col("sentimentos_diversos") >= 3, "Equilibrado")
            .when(F.col("total_reviews") > 20, "Ativo")
            .otherwise("Regular")
            .alias("segmento"),
            "total_reviews",
            "sentimentos_diversos",
            "categorias_diversas",
            "reviews_positivos",
            "reviews_negativos",
            "reviews_neutros",
            rounded(a, 3).alias("compound_medio"),
            rounded(
                F.col("total_reviews") * 0.3
                + F.col("sentimentos_diversos") * 10
                + F.col("categorias_diversas") * 5,
                1,
            ).alias("diversidade_score"),
        )
    )


def users_for_interview(books: DataFrame, reviews: DataFrame, limit: int = 50) -> DataFrame:
    return (
        interview_candidates(books, reviews)
        .orderBy(F.desc("diversidade_score"), F.desc("total_reviews"), "user_id")
        .limit(limit)
    )


# Return estimates -----------------------------------------------------------------------------------------


def _roi(books: DataFrame, reviews: DataFrame, key: Column, name: str, min_books: int) -> DataFrame:
    m = review_metrics(books, reviews, {name: key}).where((F.col("t") >= min_books) & _present(name))
    roi = F.col("per_book") * (F.col("a") + 1.0) * F.log(F.col("t") + 1.0) / 10.0
    return m.select(
        name,
        _count("t", "total_livros"),
        _count("n", "total_reviews"),
        rounded(F.col("per_book"), 2).alias("reviews_por_livro"),
        rounded(F.col("a"), 3).alias("sentimento_medio"),
        rounded(F.col("p"), 1).alias("pct_positivo"),
        rounded(roi, 2).alias("roi_estimado"),
    )


def roi_by_category(books: DataFrame, reviews: DataFrame, limit: int = 20) -> DataFrame:
    rated = books.where(_present("categories_std"))
    out = _roi(rated, reviews, first_category(F.col("categories_std")), "categoria", 5)
    return out.orderBy(F.desc("roi_estimado"), "categoria").limit(limit)


def roi_by_author(books: DataFrame, reviews: DataFrame, limit: int = 20) -> DataFrame:
    rated = books.where(_present("authors_std"))
    out = _roi(rated, reviews, F.col("authors_std"), "autor", 2)
    return out.orderBy(F.desc("roi_estimado"), "autor").limit(limit)


# Label against polarity -----------------------------------------------------------------------------------

DISCREPANCY_LEVELS = ["Alto", "Médio", "Baixo"]  # fixed values, gravest first


def expected_label(compound: Column) -> Column:
    return F.when(compound >= 0.05, POSITIVE).when(compound <= -0.05, NEGATIVE).otherwise(NEUTRAL)


def discrepancy_level(compound: Column, label: Column) -> Column:
    """How far the label contradicts the polarity; NULL when it does not."""
    against = F.when(label == NEGATIVE, compound).when(label == POSITIVE, -compound)
    neutral = F.when(label == NEUTRAL, F.abs(compound))
    return (
        F.when(against >= 0.3, "Alto")
        .when((against >= 0.1) | (neutral >= 0.3), "Médio")
        .when(neutral >= 0.05, "Baixo")
    )


def sentiment_discrepancies(reviews: DataFrame, limit: int = 50) -> DataFrame:
    c, label = F.col("compound").cast("double"), F.col("sentimento")
    distance = (
        F.when(label == POSITIVE, c - 0.5).when(label == NEGATIVE, c + 0.5).when(label == NEUTRAL, c).otherwise(0.0)
    )
    return (
        reviews.where(label.isNotNull() & c.isNotNull())
        .withColumn("nivel_discrepancia", discrepancy_level(c, label))
        .where(F.col("nivel_discrepancia").isNotNull() & (F.length("text") > 10))
        .select(
            F.col("title").alias("titulo"),
            preview(F.col("text"), 200).alias("review_preview"),
            label.alias("sentimento_classificado"),
            expected_label(c).alias("sentimento_esperado"),
            rounded(c, 3).alias("compound_score"),
            "nivel_discrepancia",
            rounded(F.abs(distance), 3).alias("score_discrepancia"),
        )
        .orderBy(
            F.array_position(F.array(*[F.lit(x) for x in DISCREPANCY_LEVELS]), F.col("nivel_discrepancia")),
            F.desc("score_discrepancia"),
            "titulo",
            "review_preview",
            "sentimento_classificado",
        )
        .limit(limit)
    )


# Publishers and themes ------------------------------------------------------------------------------------


def _publisher_metrics(books: DataFrame, reviews: DataFrame) -> DataFrame:
    rated = books.where(_present("publisher_std"))
    m = review_metrics(rated, reviews, {"editora": F.col("publisher_std")})
    return m.where((F.col("t") >= 3) & (F.col("n") >= 20))


def _theme_metrics(books: DataFrame, reviews: DataFrame) -> DataFrame:
    rated = books.where(_present("categories_std"))
    m = review_metrics(rated, reviews, {"tema": first_category(F.col("categories_std"))})
    return m.where((F.col("t") >= 5) & (F.col("n") >= 30) & _present("tema"))


def _ranking(m: DataFrame, name: str, score: Column, best: bool, limit: int) -> DataFrame:
    share, score_name = ("p", "performance_score") if best else ("g", "problema_score")
    share_name = "pct_positivo" if best else "pct_negativo"
    return (
        m.select(
            name,
            _count("t", "total_livros"),
            _count("n", "total_reviews"),
            rounded(F.col("per_book"), 1).alias("reviews_por_livro"),
            rounded(F.col("a"), 3).alias("sentimento_medio"),
            rounded(F.col(share), 1).alias(share_name),
            rounded(score, 1).alias(score_name),
        )
        .orderBy(F.desc(score_name), name)
        .limit(limit)
    )


def best_publishers(books: DataFrame, reviews: DataFrame, limit: int = 15) -> DataFrame:
    size = tier(F.col("t"), [(3, 10), (10, 20), (20, 30)], 40)
    reach = tier(F.col("n"), [(20, 5), (100, 15), (500, 25)], 35)
    score = (F.col("a") + 1.0) * 40.0 + F.col("p") * 0.4 + size + reach
    return _ranking(_publisher_metrics(books, reviews), "editora", score, True, limit)


def worst_publishers(books: DataFrame, reviews: DataFrame, limit: int = 15) -> DataFrame:
    size = tier(F.col("t"), [(3, 5), (10, 10), (20, 15)], 20)
    score = (1.0 - F.col("a")) * 40.0 + F.col("g") * 0.6 + size
    return _ranking(_publisher_metrics(books, reviews), "editora", score, False, limit)


def best_themes(books: DataFrame, reviews: DataFrame, limit: int = 15) -> DataFrame:
    score = (
        (F.col("a") + 1.0) * 45.0 + F.col("p") * 0.3 + F.log(F.col("t") + 1.0) * 8.0 + F.col("per_book") * 2.0
    )
    return _ranking(_theme_metrics(books, reviews), "tema", score, True, limit)


def worst_themes(books: DataFrame, reviews: DataFrame, limit: int = 15) -> DataFrame:
    score = (1.0 - F.col("a")) * 45.0 + F.col("g") * 0.5 + F.log(F.col("t") + 1.0) * 5.0
    return _ranking(_theme_metrics(books, reviews), "tema", score, False, limit)


# Time -----------------------------------------------------------------------------------------------------


def reviews_by_period(books: DataFrame, reviews: DataFrame) -> DataFrame:
    dated = books.where(F.col("pub_year") > 1950)
    m = review_metrics(dated, reviews, {"periodo": period_band(F.col("pub_year"))})
    return (
        m.where(F.col("t") >= 10)
        .select(
            "periodo",
            _count("t", "total_livros"),
            _count("n", "total_reviews"),
            rounded(F.col("per_book"), 1).alias("reviews_por_livro"),
            rounded(F.col("a"), 3).alias("sentimento_medio"),
            rounded(F.col("p"), 1).alias("pct_positivo"),
            rounded(F.col("g"), 1).alias("pct_negativo"),
        )
        .orderBy(band_rank(F.col("periodo"), PERIOD_BANDS, PERIOD_OLDEST))
    )


def reviews_by_year(books: DataFrame, reviews: DataFrame, start_year: int = 2000, end_year: int | None = None) -> DataFrame:
    dated = books.where(F.col("pub_year") >= start_year)
    if end_year is not None:
        dated = dated.where(F.col("pub_year") <= end_year)
    m = review_metrics(dated, reviews, {"ano": F.col("pub_year")})
    return (
        m.where(F.col("t") >= 5)
        .select(
            "ano",
            _count("t", "total_livros"),
            _count("n", "total_reviews"),
            F.col("a").alias("sentimento_medio"),
            _count("n_pos", "reviews_positivos"),
            _count("n_neg", "reviews_negativos"),
            _count("n_neu", "reviews_neutros"),
            rounded(F.col("per_book"), 1).alias("reviews_por_livro"),
        )
        .orderBy(F.desc("ano"))
    )


def recency_comparison(books: DataFrame, reviews: DataFrame) -> DataFrame:
    dated = books.where(F.col("pub_year") > 1980)
    m = review_metrics(dated, reviews, {"categoria_periodo": recency_band(F.col("pub_year"))})
    return m.select(
        "categoria_periodo",
        _count("t", "total_livros"),
        _count("n", "total_reviews"),
        F.col("a").alias("sentimento_medio"),
        F.col("p").alias("pct_positivo"),
        rounded(F.col("per_book"), 1).alias("reviews_por_livro"),
    ).orderBy(band_rank(F.col("categoria_periodo"), RECENCY_BANDS, RECENCY_OLDEST))


def recency_trend(books: DataFrame, reviews: DataFrame) -> DataFrame:
    """Recent minus old, one row; empty unless both bands occur."""
    band, newest = F.col("categoria_periodo"), RECENCY_BANDS[0][1]

    def delta(measure: str) -> Column:
        return F.max(F.when(band == newest, F.col(measure))) - F.max(F.when(band == RECENCY_OLDEST, F.col(measure)))

    return (
        recency_comparison(books, reviews)
        .agg(
            delta("sentimento_medio").alias("sentimento_trend"),
            delta("reviews_por_livro").alias("reviews_trend"),
            delta("pct_positivo").alias("positivo_trend"),
            F.count_if(band.isin(newest, RECENCY_OLDEST)).alias("bands"),
        )
        .where(F.col("bands") == 2)
        .drop("bands")
    )


# Book lookup ----------------------------------------------------------------------------------------------


def _book_rows(books: DataFrame, reviews: DataFrame) -> DataFrame:
    return review_metrics(books, reviews, {**_book_keys(), "ano": F.col("pub_year")})


def search_books(books: DataFrame, reviews: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Books whose title or author contains ``text``, read literally and without regard to case."""
    needle = F.lower(F.lit(text))
    hits = books.where(
        F.contains(F.lower("title_std"), needle) | F.contains(F.lower("authors_std"), needle)
    )
    return (
        _book_rows(hits, reviews)
        .where(F.col("n") >= 5)
        .select(
            "titulo",
            "autor",
            "categoria",
            "ano",
            _count("n", "total_reviews"),
            _count("n_pos", "positivos"),
            _count("n_neg", "negativos"),
            _count("n_neu", "neutros"),
            rounded(F.col("a"), 3).alias("sentimento_medio"),
        )
        .orderBy(F.desc("total_reviews"), "titulo", "autor", "categoria", "ano")
        .limit(limit)
    )


def books_info(books: DataFrame, reviews: DataFrame) -> DataFrame:
    """The single-book summary for every catalogue row that has reviews."""
    return _book_rows(books, reviews).select(
        "titulo",
        "autor",
        "categoria",
        F.col("ano").alias("ano_publicacao"),
        _count("n", "total_reviews"),
        _count("n_pos", "total_positivos"),
        _count("n_neg", "total_negativos"),
        _count("n_neu", "total_neutros"),
        rounded(F.col("a"), 3).alias("sentimento_medio"),
    )


def book_info(books: DataFrame, reviews: DataFrame, title: str) -> DataFrame:
    one = books_info(books.where(F.col("title_std") == title), reviews.where(F.col("title") == title))
    return one.orderBy("titulo", "autor", "categoria", "ano_publicacao").limit(1)


def readable() -> Column:
    return F.length(F.trim("text")) > 20


def _readable(reviews: DataFrame) -> DataFrame:
    return reviews.where(readable())


def reviews_by_sentiment(reviews: DataFrame, title: str, label: str, limit: int = 10) -> DataFrame:
    """The most extreme readable reviews of one book and label."""
    return (
        _readable(reviews.where((F.col("title") == title) & (F.col("sentimento") == label)))
        .orderBy(F.desc(F.abs("compound")), "review_id")
        .limit(limit)
        .select(F.col("text").alias("review_text"), "compound", "sentimento")
    )


# How many reviews of each label a book page shows.
REVIEWS_PER_LABEL = {POSITIVE: 10, NEGATIVE: 10, NEUTRAL: 5}


def top_reviews(reviews: DataFrame, per_label: dict[str, int] = REVIEWS_PER_LABEL, **texts: Column) -> DataFrame:
    """The most extreme readable reviews of every (title, label), ranked.

    ``texts`` replaces the review text, e.g. by its first 200 characters, before rows are ranked, which keeps
    long texts out of the sort. The reviews of a single label are dealt by title alone, where the title's other rows meet.
    """
    label = F.col("sentimento")
    picked = _readable(reviews.where(label.isin(*per_label) & F.col("title").isNotNull())).select(
        "title", "review_id", label, "compound", *(c.alias(n) for n, c in (texts or {"text": F.col("text")}).items())
    )
    ranked = top_per_group(
        picked,
        ["title", "sentimento"] if len(per_label) > 1 else ["title"],
        [F.desc(F.abs("compound")), F.asc("review_id")],
        max(per_label.values()),
        "posicao",
    )
    return ranked.where(F.col("posicao") <= quota(per_label)) if len(per_label) > 1 else ranked  # one label is cut at its own quota


def quota(per_label: dict[str, int] = REVIEWS_PER_LABEL) -> Column:
    return F.coalesce(*[F.when(F.col("sentimento") == name, F.lit(k)) for name, k in per_label.items()])


def top_review_keys(
    reviews: DataFrame, texts: DataFrame, review_id: Column, text_key: Column, per_label: dict[str, int] = REVIEWS_PER_LABEL
) -> DataFrame:
    """(item, sentimento, posicao, text_key): the reviews of :func:`top_reviews` by their keys alone.

    Reviews are (item, sentimento, compound) and the columns that ``review_id`` and ``text_key`` are made of; texts are (text_key, text).
    Reviews move once, before their ids are worded. Those of frequent items are cut in every task first.
    """
    picked = reviews.where(F.col("sentimento").isin(*per_label) & F.col("item").isNotNull())
    hot = F.broadcast(frequent_keys(picked, "item"))
    picked = having_key(picked, text_key, texts, "text_key", readable())
    dealt = picked.join(hot, F.col("item") == F.col("_hot"), "left_anti").repartition("item")
    popular = picked.join(hot, F.col("item") == F.col("_hot"), "left_semi")

    def ranked(rows: DataFrame) -> DataFrame:
        keys = rows.select("item", "sentimento", "compound", review_id.alias("review_id"), text_key.alias("text_key"))
        order = [F.desc(F.abs("compound")), F.asc("review_id")]
        top = top_per_group(keys, ["item", "sentimento"], order, max(per_label.values()), "posicao")
        return top.where(F.col("posicao") <= quota(per_label)).select("item", "sentimento", "posicao", "text_key")

    return ranked(dealt).unionByName(ranked(popular))


def reviews_for_book(reviews: DataFrame, title: str) -> DataFrame:
    return top_reviews(reviews.where(F.col("title") == title)).select(
        "sentimento", "posicao", F.col("text").alias("review_text"), "compound"
    )


# Overview -------------------------------------------------------------------------------------------------


def summary_stats(books: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: books, labelled reviews, distinct users, mean polarity (0 where nothing can be counted)."""
    total = books.agg(F.count(F.lit(1)).alias("n")).scalar()
    return reviews.agg(
        F.count("sentimento").alias("total_reviews"),
        F.count_distinct("user_id").alias("total_users"),
        F.sum(polarity_units(F.col("compound"))).alias("polarity_sum"),
        F.count("compound").alias("polarity_n"),
    ).select(
        total.alias("total_books"),
        "total_reviews",
        "total_users",
        F.coalesce(
            rounded(polarity_mean(F.col("polarity_sum"), F.col("polarity_n")), 3), F.lit(0.0)
        ).alias("avg_sentiment"),
    )


def sentiment_distribution(reviews: DataFrame) -> DataFrame:
    counts = sentiment_counts(reviews).withColumnRenamed("count", "quantidade")
    total = F.sum("quantidade").over(Window.partitionBy())  # over a handful of counted labels
    return counts.withColumn("percentual", rounded(percent(F.col("quantidade"), total), 1)).orderBy(
        F.desc("quantidade"), "sentimento"
    )


def books_to_summarise(books: DataFrame, reviews: DataFrame, query: str = "", limit: int = 20) -> DataFrame:
    """Books with ten or more reviews by volume; a non-blank query searches instead."""
    if query.strip():
        return search_books(books, reviews, query, limit)
    return (
        review_metrics(books, reviews, _book_keys())
        .where(F.col("n") >= 10)
        .select(
            "titulo",
            "autor",
            "categoria",
            _count("n", "total_reviews"),
            _count("n_pos", "positivos"),
            _count("n_neg", "negativos"),
            rounded(F.col("a"), 3).alias("sentimento_medio"),
        )
        .orderBy(F.desc("total_reviews"), "titulo", "autor", "categoria")
        .limit(limit)
    )


def top_authors(books: DataFrame, limit: int = 5) -> DataFrame:
    return (
        books.where(F.col("authors_std").isNotNull())
        .groupBy(F.col("authors_std").alias("autor"))
        .agg(F.count(F.lit(1)).alias("num_livros"))
        .orderBy(F.desc("num_livros"), "autor")
        .limit(limit)
    )


def sentiment_counts(reviews: DataFrame) -> DataFrame:
    return (
        reviews.where(F.col("sentimento").isNotNull())
        .groupBy("sentimento")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "sentimento")
    )


def books_by_decade(books: DataFrame, limit: int = 5) -> DataFrame:
    return (
        books.where(F.col("pub_year") > 1900)
        .groupBy(decade(F.col("pub_year")).alias("decada"))
        .agg(F.count(F.lit(1)).alias("num_livros"))
        .orderBy(F.desc("decada"))
        .limit(limit)
    )
