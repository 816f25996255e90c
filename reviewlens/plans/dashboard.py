"""Second-level reports computed from the ranked query results (see :mod:`reviewlens.plans.reports`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.functions.numeric import count_where, rounded
from reviewlens.functions.text import preview
from reviewlens.plans.reports import DISCREPANCY_LEVELS, interview_candidates

# Wording of the trend signs, and what to do about a discrepancy of each level.
UP, DOWN, STABLE, GROWING, SHRINKING = "Melhorando", "Piorando", "Estável", "Aumentando", "Diminuindo"
ACTIONS = {
    "Alto": "Revisar classificação manualmente",
    "Médio": "Validar com mais dados",
    "Baixo": "Monitorar tendência",
}


def risk_level(score: Column) -> Column:
    return F.when(score > 50, "alto").when(score > 25, "medio").otherwise("baixo")


def risk_counts(problematic: DataFrame) -> DataFrame:
    """One row: how many ranked books are at high, medium and low risk."""
    level = risk_level(F.col("problema_score"))
    return problematic.agg(*[count_where(level == name).alias(f"{name}_risco") for name in ("alto", "medio", "baixo")])


def with_minimum_score(problematic: DataFrame, minimum: float) -> DataFrame:
    return problematic.where(F.col("problema_score") >= minimum).withColumns(
        {
            "titulo_curto": preview(F.col("titulo"), 60, ellipsis=True),
            "autor_curto": preview(F.col("autor"), 30, ellipsis=True),
        }
    )


def select_users(
    users: DataFrame, segment: str | None = None, min_reviews: int = 3
) -> DataFrame:
    """Filter an interview list that has already been cut to its limit."""
    kept = users.where(F.col("total_reviews") >= min_reviews)
    return kept if segment is None else kept.where(F.col("segmento") == segment)


def select_users_before_limit(
    books: DataFrame, reviews: DataFrame, segment: str | None = None, min_reviews: int = 3, limit: int = 50
) -> DataFrame:
    """As :func:`select_users`, but the limit applies to the users that pass the filter."""
    return (
        select_users(interview_candidates(books, reviews), segment, min_reviews)
        .orderBy(F.desc("diversidade_score"), F.desc("total_reviews"), "user_id")
        .limit(limit)
    )


def user_profile(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count(F.lit(1)).alias("total_selecionados"),
        rounded(F.avg("total_reviews"), 1).alias("media_reviews"),
        rounded(F.avg(F.col("diversidade_score").cast("decimal(18,6)")), 1).alias("score_medio"),
        rounded(F.avg(F.col("compound_medio").cast("decimal(18,6)")), 3).alias("sentimento_medio"),
    )


def segment_counts(users: DataFrame) -> DataFrame:
    return users.groupBy("segmento").agg(F.count(F.lit(1)).alias("usuarios")).orderBy(F.desc("usuarios"), "segmento")


def roi_headline(ranking: DataFrame, name: str) -> DataFrame:
    """Best row of a return ranking, its estimate, and the number of rows."""
    best = F.min(F.struct((-F.col("roi_estimado")).alias("r"), F.col(name).alias("k")))
    return ranking.agg(best.alias("b"), F.count(F.lit(1)).alias("total")).select(
        F.col("b.k").alias("melhor"), (-F.col("b.r")).alias("melhor_roi"), "total"
    )


def of_level(discrepancies: DataFrame, level: str) -> DataFrame:
    return discrepancies.where(F.col("nivel_discrepancia") == level)


def level_counts(discrepancies: DataFrame) -> DataFrame:
    level = F.col("nivel_discrepancia")
    high, medium, low = DISCREPANCY_LEVELS
    return discrepancies.agg(
        count_where(level == high).alias("alto"),
        count_where(level == medium).alias("medio"),
        count_where(level == low).alias("baixo"),
        F.count(F.lit(1)).alias("total"),
    )


def critical_cases(discrepancies: DataFrame, k: int = 5) -> DataFrame:
    return (
        of_level(discrepancies, DISCREPANCY_LEVELS[0])
        .orderBy(F.desc("score_discrepancia"), "titulo", "review_preview", "sentimento_classificado")
        .limit(k)
    )


def theme_comparison(best: DataFrame, worst: DataFrame, k: int = 8) -> DataFrame:
    def side(ranking: DataFrame, tag: str, score: str) -> DataFrame:
        head = ranking.orderBy(F.desc(score), "tema").limit(k)
        return head.select("tema", F.lit(tag).alias("categoria"), F.col(score).alias("score"), "sentimento_medio")

    return side(best, "Melhores", "performance_score").unionByName(side(worst, "Piores", "problema_score"))


def trend_wording(trend: DataFrame) -> DataFrame:
    def say(delta: str, up: str, down: str) -> Column:
        return F.when(F.col(delta) > 0, up).when(F.col(delta) < 0, down).otherwise(STABLE)

    return trend.select(
        say("sentimento_trend", UP, DOWN).alias("sentimento"),
        say("reviews_trend", GROWING, SHRINKING).alias("engajamento"),
        say("positivo_trend", UP, DOWN).alias("positivo"),
    )


def with_action(discrepancies: DataFrame) -> DataFrame:
    level = F.col("nivel_discrepancia")
    action = F.coalesce(*[F.when(level == name, F.lit(text)) for name, text in ACTIONS.items()])
    return discrepancies.withColumns(
        {"acao": action, "review_curto": preview(F.col("review_preview"), 100, ellipsis=True)}
    )


def share_by_period(periods: DataFrame) -> DataFrame:
    """Positive and negative share of each period in long form."""
    return periods.unpivot(["periodo"], ["pct_positivo", "pct_negativo"], "tipo", "percentual")


def head_of(ranking: DataFrame, order: list[Column | str], k: int, columns: list[str]) -> DataFrame:
    """The first k rows of a ranked list, some columns only."""
    return ranking.orderBy(*order).limit(k).select(*columns)
