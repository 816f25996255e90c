"""Profiling: every function is one aggregation over its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.functions.numeric import count_where, percent, rounded
from reviewlens.operators.quantiles import quantile_columns
from reviewlens.session import cut_lineage


def _stack(row: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn one wide row of per-column measures into one row per column."""
    items = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{prefix}{i}").alias(name) for name, prefix in fields.items()])
        for i, c in enumerate(columns)
    ]
    return row.select("rows", F.explode(F.array(*items)).alias("_i")).select("_i.*", "rows")


def overview(df: DataFrame) -> DataFrame:
    """Shape, type and non-null count per column."""
    columns = df.columns
    types = dict(df.dtypes)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    stacked = _stack(row, columns, {"non_null": "v"})
    dtype = F.coalesce(*[F.when(F.col("column") == c, F.lit(types[c])) for c in columns])
    return stacked.select("column", dtype.alias("dtype"), "non_null", "rows", F.lit(len(columns)).alias("columns"))


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL count and share per column, most incomplete first."""
    columns = columns or df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[count_where(F.isnull(c)).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    return (
        _stack(row, columns, {"missing": "v"})
        .select("column", "missing", rounded(percent(F.col("missing"), F.col("rows")), 2).alias("missing_pct"))
        .orderBy(F.desc("missing_pct"), "column")
    )


def row_digest(columns: list[str]) -> Column:
    """256-bit digest of a whole row, NULLs included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier one. Rows are compared by digest, so long texts are not shuffled."""
    return (
        df.groupBy(row_digest(df.columns).alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        )
    )


def empty_records(df: DataFrame) -> DataFrame:
    """Columns without any value, and rows without any value."""
    all_null = F.lit(True)
    for c in df.columns:
        all_null = all_null & F.isnull(c)
    values = [F.count(F.col(c)).alias(f"v{i}") for i, c in enumerate(df.columns)]
    empty = F.lit(0)
    for i in range(len(df.columns)):
        empty = empty + (F.col(f"v{i}") == 0).cast("int")
    return df.agg(*values, count_where(all_null).alias("all_null_rows")).select(
        empty.alias("all_null_columns"), "all_null_rows"
    )


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, distinct values, repeated rows, NULLs, non-NULLs."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    # Counting per (column, value) first keeps a frequent value from overloading one reducer.
    per_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_value.groupBy("column")
        .agg(
            F.sum("n").alias("total"),
            F.count("value").alias("unique_values"),
            F.sum(F.col("n") - 1).alias("repeated"),
            F.sum(F.when(F.isnull("value"), F.col("n")).otherwise(0)).alias("nulls"),
            F.sum(F.when(F.isnull("value"), 0).otherwise(F.col("n"))).alias("non_null"),
        )
    )


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(k)
    )


def numeric_summary(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """count, mean, sample standard deviation, minimum, quartiles (linear), maximum.

    Quartiles are exact however many values there are (``quantiles``); ``accuracy`` asks for the sketch instead, in one scan.
    """
    v = F.col(column).cast("double")
    quartiles = [0.25, 0.5, 0.75]
    found = quantile_columns(df, v, quartiles) if accuracy is None else [F.percentile_approx(v, q, accuracy) for q in quartiles]
    return df.agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        *[c.alias(name) for name, c in zip(("q25", "median", "q75"), found)],
        F.max(v).alias("max"),
    )


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width bins between the smallest and largest value kept; the last bin includes its right edge."""
    v = F.col(column).cast("double")
    kept = df.where(v.isNotNull())
    if low is not None:
        kept = kept.where(v >= low)
    if high is not None:
        kept = kept.where(v <= high)
    uses = kept.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = kept.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias("ends")).scalar()
    first = ends["low"]
    width = (ends["high"] - first) / F.lit(float(bins))
    slot = F.when(width > 0, F.least(F.floor((F.col("v") - first) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = uses.groupBy(slot.alias("bin")).agg(F.sum("n").alias("n"))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return axis.join(counted, "bin", "left").select(
        "bin",
        (first + F.col("bin") * width).alias("bin_from"),
        (first + (F.col("bin") + 1) * width).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def text_coverage(df: DataFrame, column: str = "text") -> DataFrame:
    return df.agg(
        F.count(F.col(column)).alias("with_text"),
        count_where(F.isnull(column)).alias("without_text"),
        F.count(F.lit(1)).alias("rows"),
    ).select("with_text", "without_text", rounded(percent(F.col("with_text"), F.col("rows")), 1).alias("pct_with_text"))


def compare_missing(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values per field before and after enrichment, with the share filled; last row is the total."""
    b = missing_profile(before, columns).select("column", F.col("missing").alias("before"))
    a = missing_profile(after, columns).select("column", F.col("missing").alias("after"))
    fields = b.join(a, "column")
    both = fields.unionByName(
        fields.agg(F.lit("total").alias("column"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    )
    filled = F.col("before") - F.col("after")
    rate = F.when(F.col("before") > 0, filled.cast("double") / F.col("before") * 100.0).otherwise(0.0)
    return both.select("column", "before", "after", filled.alias("filled"), rounded(rate, 1).alias("success_pct"))


def filled_rows(before: DataFrame, after: DataFrame, column: str, key: str = "book_id") -> DataFrame:
    """Rows whose field was NULL and no longer is."""
    gaps = before.where(F.isnull(column)).select(key)
    return after.where(F.col(column).isNotNull()).join(gaps.hint("merge"), key, "left_semi")


def first_filled(before: DataFrame, after: DataFrame, column: str, k: int = 5, key: str = "book_id") -> DataFrame:
    return filled_rows(before, after, column, key).orderBy(key).limit(k)


def filled_summary(before: DataFrame, after: DataFrame, column: str, key: str = "book_id") -> DataFrame:
    """Count, minimum, maximum and median of a numeric field over the rows that were filled."""
    filled = cut_lineage(filled_rows(before, after, column, key).select(column))  # quantiles read it more than once
    return numeric_summary(filled, column).select("count", "min", "max", "median")
