"""Serving tables: load-time cleaning, loading, parameterised SQL and health."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from reviewlens.functions.text import strip_space
from reviewlens.session import cut_lineage

NULL_TOKENS = ["nan", "None", "null", ""]  # fixed values: spellings of a missing value
CATALOGUE, REVIEW_TABLE = "books_data_processed", "books_rating_modified"  # fixed values: expected tables
MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def drop_sparse_columns(df: DataFrame, share: float = 0.1) -> DataFrame:
    """Keep the columns whose non-null count reaches ``int(share * rows)``; one aggregation decides."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    least = int(counts["_rows"] * share)
    return df.select(*[c for c in df.columns if counts[c] >= least])


def clean_strings(df: DataFrame) -> DataFrame:
    """Strip every string column and turn the spelled-out missing values into NULL."""

    def clean(name: str):
        stripped = strip_space(F.col(name))
        return F.when(~stripped.isin(NULL_TOKENS), stripped).alias(name)

    return df.select(*[clean(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema])


def clean_for_load(df: DataFrame) -> DataFrame:
    """Distinct rows, sparse columns dropped, strings cleaned; the distinct rows are written once and counted there."""
    return clean_strings(drop_sparse_columns(cut_lineage(df.dropDuplicates())))


def load_tables(
    spark: SparkSession, inputs: dict[str, str], if_exists: str = "replace", location: str | None = None
) -> list[str]:
    """Clean Parquet stages and save them as tables; inputs that are missing or empty are skipped.

    Returns the names of the tables written.
    """
    loaded = []
    for name, path in inputs.items():
        try:
            stage = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if stage.isEmpty():
            continue
        writer = clean_for_load(stage).write.mode(MODES[if_exists])
        if location:
            writer = writer.option("path", f"{location.rstrip('/')}/{name}")
        writer.saveAsTable(name)
        loaded.append(name)
    return loaded


def run_sql(spark: SparkSession, statement: str, args: list | dict | None = None) -> DataFrame:
    """A statement with ``?`` or ``:name`` parameters."""
    return spark.sql(statement, args=args)


def table_health(spark: SparkSession, expected: tuple[str, ...] = (CATALOGUE, REVIEW_TABLE)) -> DataFrame:
    """Rows, columns and state of every expected table and of every other table in the current schema."""
    present = [t.name for t in spark.catalog.listTables()]
    reports = []
    for name in dict.fromkeys([*expected, *present]):
        if name in present:
            frame = spark.table(name)
            base = frame.agg(F.count(F.lit(1)).alias("rows"))
            n_columns = len(frame.columns)
        else:
            base, n_columns = spark.range(1).select(F.lit(0).cast("long").alias("rows")), 0
        reports.append(
            base.select(
                F.lit(name).alias("table_name"),
                "rows",
                F.lit(n_columns).alias("columns"),
                F.lit(name in present).alias("table_exists"),
                (F.col("rows") > 0).alias("has_data"),
                F.lit(name in expected).alias("expected"),
            )
        )
    return reduce(DataFrame.unionByName, reports)
