"""File sources and sinks. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from reviewlens.session import spread

_CSV = {"header": "true", "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """CSV, by default with quoted line breaks. Such a file cannot be split: convert it once with :func:`csv_to_parquet`.

    Where no field holds a line break, ``multi_line=False`` lets Spark split the file.
    """
    return spark.read.schema(schema).options(multiLine=str(multi_line).lower(), **_CSV).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.options(ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **_CSV).mode(mode).csv(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def csv_to_parquet(
    spark: SparkSession, src: str, dst: str, schema: StructType, id_column: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Convert once and read the result. ``id_column`` gives rows an identity in input order, fixed by the write.

    A file that is read whole by one task is dealt to all of them before the write.
    """
    rows = read_csv(spark, src, schema, multi_line)
    if id_column:
        rows = rows.select(F.monotonically_increasing_id().alias(id_column), "*")
    write_parquet(spread(rows), dst)
    return read_parquet(spark, dst)


def read_raw_pair(
    spark: SparkSession, books_path: str, reviews_path: str, books_schema: StructType, reviews_schema: StructType,
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    return read_csv(spark, books_path, books_schema, multi_line), read_csv(spark, reviews_path, reviews_schema, multi_line)
