"""Joins of a large frame against a table with few rows per key, safe for a key that owns a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 32
TRACKED = 4096  # keys that the summary of frequent keys keeps at a time
FREQUENT = 64  # keys that are salted at most; no more than these can each have the share below
SHARE = 1 / 64  # of all rows that makes a key frequent
WORDS = 1_000_000  # of 64 keys each, that a set of keys may have to be sent to every task
LEAST = 10_000  # and the rows that it must have; fewer are no burden to a task


def frequent_keys(df: DataFrame, key: str) -> DataFrame:
    """(_hot): the keys of ``df`` with at least ``SHARE`` of its rows, by a mergeable frequent-items summary of bounded size.

    A summary that tracks m keys is wrong by less than 2 / m of the rows, so a key with twice that share is never missed.
    """
    summary = df.agg(F.expr(f"approx_top_k({key}, {FREQUENT}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("rows"))
    each = summary.select("rows", F.inline("top").alias("item", "n"))
    return each.where((F.col("n") >= F.col("rows") * SHARE) & (F.col("n") >= LEAST) & F.col("item").isNotNull()).select(F.col("item").alias("_hot"))


def counted_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(_hot): the same read off a table that already counts its keys; no other key can have the share."""
    return counts.where(F.col(n) >= LEAST).orderBy(F.desc(n), key).limit(FREQUENT).select(F.col(key).alias("_hot"))


def repeated(table: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``table`` with ``_salt``: rows of frequent keys once per salt, all others as they are."""
    marked = table.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    salts = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return marked.select(*[table[c] for c in table.columns], F.explode(salts).alias("_salt"))


def salted_lookup(df: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join ``table`` to ``df``, spreading the frequent keys of ``df`` over ``SALTS`` reducers each.

    ``spread`` is any row-level hash; ``hot`` are the frequent keys where they are known. Only lookup rows of frequent keys
    are repeated. ``table`` grows with the input, so it is never broadcast: Spark would judge it by the bytes of its files,
    which can be a hundredth of its rows' size.
    """
    hot = frequent_keys(df, key) if hot is None else hot
    marked = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # Rows without a key meet nothing; they are spread as well, not sent to one task.
    salt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.pmod(spread, F.lit(SALTS)).cast("int"))
    left = marked.withColumn("_salt", salt).drop("_hot")
    return left.join(repeated(table, hot, key).hint("merge"), [key, "_salt"], how).drop("_salt")


def having_key(df: DataFrame, key: Column, table: DataFrame, column: str, only: Column) -> DataFrame:
    """The rows of ``df`` whose whole-number ``key`` is in ``column`` of a row of ``table`` that ``only`` holds for.

    The keys are sent as one bit each, 64 to a word, so no row of ``df`` moves. The range and the number of all keys bound the
    words; with more than ``WORDS`` the words are joined by a shuffle.
    """
    keys = table.select(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    words = min(keys["n"], (keys["hi"] >> 6) - (keys["lo"] >> 6) + 1) if keys["n"] else 0
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    bits = table.where(only & F.col(column).isNotNull()).groupBy(F.shiftright(column, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = df.withColumn("_key", key).join(
        bits.hint("broadcast" if words <= WORDS else "merge"), F.shiftright("_key", 6) == F.col("_word")
    )
    return marked.where(F.getbit("_bits", F.col("_key").bitwiseAND(F.lit(63)).cast("int")) == 1).select(*df.columns)
