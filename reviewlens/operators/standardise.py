"""Canonical spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def most_frequent_spelling(df: DataFrame, norm: str, original: str, out: str) -> DataFrame:
    """Add ``out``: per normal form, the spelling used most often (the lowest on ties); NULL for a NULL form.

    Spellings are counted before they are compared, so a form that covers a third of all rows is a handful of
    counted spellings by the time it meets its group. Rows without a form get a key each that no form has.
    """
    spellings = (
        df.where(F.col(norm).isNotNull() & F.col(original).isNotNull())
        .groupBy(norm, original)
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    standard = spellings.groupBy(F.col(norm).alias("_form")).agg(
        F.min(F.struct((-F.col("uses")).alias("u"), F.col(original).alias("s")))["s"].alias(out)
    )
    key = F.coalesce(F.col(norm), F.concat(F.lit("\u0000"), F.xxhash64(*df.columns).cast("string")))
    return df.join(standard, key == F.col("_form"), "left").drop("_form")
