"""The review fold: totals per title, kept beside the reviews and added to as reviews arrive.

A batch of reviews is read once and leaves one row per title: counts by label and the polarity as a whole number, all of
which add up. Every report over titles, authors, categories and periods takes the fold in place of the reviews, so it reads
rows the size of the catalogue, and a new batch never touches the reviews of the ones before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from reviewlens.plans.metrics import TOTALS, fold_totals, title_totals

SCHEMA = "title string, " + ", ".join(f"{c} long" for c in TOTALS)


def _done(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.format("binaryFile").load(f"{folder}/_SUCCESS").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def add_reviews(reviews: DataFrame, path: str, batch: str) -> None:
    """Fold a batch of reviews (title, sentimento, compound) into the table under ``path``.

    A batch counts once however often it is added under its name; one that was cut off is written again.
    """
    folder = f"{path.rstrip('/')}/batch={batch}"
    if not _done(reviews.sparkSession, folder):
        title_totals(reviews).write.mode("overwrite").parquet(folder)


def read_fold(spark: SparkSession, path: str, batches: list[str] | None = None) -> DataFrame:
    """The totals of all batches under ``path``, or of some; a title has one row per batch that names it."""
    root = path.rstrip("/")
    if batches is not None:
        return spark.read.schema(SCHEMA).parquet(*[f"{root}/batch={b}" for b in batches])
    return spark.read.schema(SCHEMA).parquet(f"{root}/batch=*")


def compact(spark: SparkSession, path: str, target: str, batch: str = "all") -> None:
    """The same totals with one row per title, as one batch under ``target``."""
    folder = f"{target.rstrip('/')}/batch={batch}"
    read_fold(spark, path).groupBy("title").agg(*fold_totals()).write.mode("overwrite").parquet(folder)
