"""The one aggregate most reports share.

Reviews are folded to one row per title before they meet the catalogue. The fold combines on the map side, so
a title that holds a third of all reviews still sends one row per task into the shuffle, and the join that
follows works on rows the size of the catalogue instead of the size of the review table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.functions.numeric import count_where, percent, polarity_mean, polarity_units, ratio

# The labels a review can carry.
POSITIVE, NEGATIVE, NEUTRAL = "positivo", "negativo", "neutro"
NOT_SCORED, FAILED = "n/a", "erro"
VALID_LABELS = [POSITIVE, NEUTRAL, NEGATIVE]


def label_totals() -> list[Column]:
    label = F.col("sentimento")
    return [
        F.count(label).alias("n"),
        count_where(label == POSITIVE).alias("n_pos"),
        count_where(label == NEGATIVE).alias("n_neg"),
        count_where(label == NEUTRAL).alias("n_neu"),
        F.sum(polarity_units(F.col("compound"))).alias("polarity_sum"),
        F.count("compound").alias("polarity_n"),
    ]


def fold_totals() -> list[Column]:
    """Second level of :func:`label_totals`."""
    return [F.sum(c).alias(c) for c in TOTALS]


TOTALS = ["n", "n_pos", "n_neg", "n_neu", "polarity_sum", "polarity_n"]


def title_totals(reviews: DataFrame) -> DataFrame:
    """One row per reviewed title; reviews without a label do not count.

    Rows that are such totals already, of several batches of reviews (``review_fold``), are added up instead.
    """
    if set(TOTALS) <= set(reviews.columns):
        return reviews.groupBy("title").agg(*fold_totals())
    rated = reviews.where(F.col("sentimento").isNotNull() & F.col("title").isNotNull())
    return rated.groupBy("title").agg(*label_totals())


def review_metrics(books: DataFrame, reviews: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Per key: books ``t``, reviews ``n`` by label, mean polarity ``a``, shares ``p`` and ``g``, ``per_book``.

    A title that occurs on several catalogue rows counts its reviews once per row, as a join would.
    """
    joined = books.join(title_totals(reviews), F.col("title_std") == F.col("title"))
    grouped = (
        joined.select(*[expr.alias(name) for name, expr in keys.items()], "title_std", "n", "n_pos", "n_neg",
                      "n_neu", "polarity_sum", "polarity_n")
        .groupBy(*keys)
        .agg(F.count_distinct("title_std").alias("t"), *fold_totals())
    )
    return with_rates(grouped)


def with_rates(totals: DataFrame) -> DataFrame:
    n = F.col("n")
    columns = {
        "a": polarity_mean(F.col("polarity_sum"), F.col("polarity_n")),
        "p": percent(F.col("n_pos"), n),
        "g": percent(F.col("n_neg"), n),
    }
    if "t" in totals.columns:
        columns["per_book"] = ratio(n, F.col("t"))
    return totals.withColumns(columns)


def tier(value: Column, steps: list[tuple[int, int]], above: int) -> Column:
    """Points by size: the first step whose limit is not exceeded, else ``above``."""
    chain = F.when(value <= steps[0][0], steps[0][1])
    for limit, points in steps[1:]:
        chain = chain.when(value <= limit, points)
    return chain.otherwise(above)
