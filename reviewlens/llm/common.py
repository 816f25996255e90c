"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlens.session import scratch_path

#: White space between words, as in the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add: its own columns replace others of the same name."""
    return df.drop(*names)


#: Bytes of a batch that a Python worker gets. Spark's own bound is eight times as high, and is held on either side of the pipe.
BATCH_BYTES = 8 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, after telling its session to hand whole texts to Python workers in batches of bounded size.

    Batches stay bounded by rows as well; a text longer than the bound is a batch of its own.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker function that hands unused memory back when its task ends; idle workers would keep it beside the JVM's."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library, which has its own way
            pass

    return run


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: recovery never goes further back than here."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(*stages: DataFrame | None) -> None:
    """Delete the files of stages that nothing reads any more; frames that are no stage are left alone."""
    for df in stages:
        path = getattr(df, "_stage_path", None)
        if path is not None:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
