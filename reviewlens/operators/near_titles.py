"""Near titles: pairs of strings a few edits apart, found without an equality key.

Two strings of which the longer has n letters are near when at most ``allowed_edits(n)`` letters have to be inserted, deleted
or replaced.

Up to two edits, both strings are equal once up to as many letters are left out of each, so strings are filed under all they can
become that way: some hundred files a title, and a file holds few strings but near ones, however much of their text they share
with others. Only strings whose length the other side can reach are filed.

With three edits that would be thousands of files. An edit spoils at most ``GRAM`` of a string's runs of ``GRAM`` letters, so with
k edits two of the first ``GRAM * k + 2`` runs of both strings agree, in any order of runs that holds for all strings (prefix
filter; runs that tie with the last one count as well). Rare runs come first, and long strings are filed under pairs of their
first runs. Strings that meet are compared by length, by the place of the run and by their marks: one of 64 bits is set for
every run, and an edit changes at most ``2 * GRAM`` of them.

Only what passes has its edit distance computed, which stops at the bound. Nothing is gathered per run: a file is a join key,
and adaptive execution splits a frequent one. Runs are counted on the right side; a run it lacks is the rarest of all and
meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3
EDITS = [(32, 3), (16, 2), (8, 1)]  # letters of the longer string, edits; shorter strings are near only when equal
LONG, MOST = EDITS[0]  # strings of so many letters are filed by runs, shorter ones by what is left of them
BROADCAST_GRAMS = 500_000  # distinct runs of letters up to which their counts are broadcast


def allowed_edits(length: Column) -> Column:
    bound = F.lit(0)
    for least, edits in reversed(EDITS):
        bound = F.when(length >= least, edits).otherwise(bound)
    return bound


def _tokens(text: Column) -> Column:
    """(gram, place) of every run of letters."""
    last = F.length(text) - GRAM
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.substring(text, i + 1, F.lit(GRAM)).alias("gram"), i.alias("place"))))


def _filed(strings: DataFrame, counts: DataFrame) -> DataFrame:
    """(text, size, marks, key, low, high): distinct ``text`` under pairs of its first grams, with the places of the first of them."""
    size = F.length("text")
    tokens = strings.select("text", F.inline(_tokens(F.col("text")))).join(counts, "gram", "left")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(gram), 64L) AS int))")
    ordered = tokens.groupBy("text").agg(
        F.bit_or(bit).alias("marks"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram", "place"))).alias("v"))
    needed = GRAM * allowed_edits(size + MOST) + 2
    edge = F.element_at("v", F.least(needed, F.size("v")))
    first = F.filter("v", lambda t: F.struct(t["uses"], t["gram"]) <= F.struct(F.col("edge")["uses"], F.col("edge")["gram"]))

    def with_later(t: Column, i: Column) -> Column:
        later = F.slice(F.col("v"), i + 2, F.greatest(F.size("v") - i - 1, F.lit(0)))
        return F.transform(later, lambda u: F.struct(F.xxhash64(t["gram"], u["gram"]).alias("key"), t["place"].alias("place")))

    pairs = ordered.withColumn("edge", edge).withColumn("v", first).select("text", "marks", F.inline(F.flatten(F.transform("v", with_later))))
    return pairs.groupBy("text", "marks", "key").agg(F.min("place").alias("low"), F.max("place").alias("high")).withColumn("size", size)


def _long_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(text, other) of which the longer has at least ``LONG`` letters."""
    size = F.length("text")
    left, right = left.where(size >= LONG - MOST), right.where(size >= LONG - MOST)
    grams = right.select(F.explode(_tokens(F.col("text"))["gram"]).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_GRAMS else counts.hint("merge")
    a = _filed(left, counts)
    b = _filed(right, counts).select("key", *[F.col(c).alias(f"{c}_b") for c in ("text", "size", "marks", "low", "high")])
    bound = allowed_edits(F.greatest("size", "size_b"))
    near_in_place = (F.col("low") <= F.col("high_b") + bound) & (F.col("low_b") <= F.col("high") + bound)
    alike = F.bit_count(F.col("marks").bitwiseXOR(F.col("marks_b"))) <= 2 * GRAM * bound
    met = a.join(b.hint("merge"), "key").where(alike & (F.abs(F.col("size") - F.col("size_b")) <= bound) & near_in_place)
    return met.where(F.greatest("size", "size_b") >= LONG).select("text", F.col("text_b").alias("other"))


def _left_out(size: Column) -> Column:
    """Letters to leave out of a string so that it meets all shorter than ``LONG`` that are near it."""
    letters = F.lit(0)
    for least, edits in reversed(EDITS[1:]):
        letters = F.when(size >= least - edits, edits).otherwise(letters)
    return letters


def _remains(text: Column) -> Column:
    """Hashes of all that one can become by leaving out none, one or two letters, as many as ``_left_out`` says."""
    size = F.length(text)
    last = size - 1
    one = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.concat(F.substring(text, F.lit(1), i), F.substring(text, i + 2, size))))

    def later(i: Column) -> Column:
        head = F.substring(text, F.lit(1), i)
        return F.transform(F.sequence(i, last - 1), lambda j: F.xxhash64(F.concat(head, F.substring(text, i + 2, j - i), F.substring(text, j + 3, size))))

    two = F.when(_left_out(size) > 1, F.flatten(F.transform(F.sequence(F.lit(0), last - 1), later))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(F.array(F.xxhash64(text)), one, two))


def _short_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(text, other) of which the longer has less than ``LONG`` letters."""
    size = F.length("text")
    sized = lambda df: df.withColumn("size", size).where((size < LONG) & (_left_out(size) > 0))
    left, right = sized(left), sized(right)

    def within_reach(df: DataFrame, of: DataFrame) -> DataFrame:
        reach = of.select(F.explode(F.sequence(F.col("size") - _left_out(F.col("size")), F.col("size") + _left_out(F.col("size")))).alias("size")).distinct()
        return df.join(F.broadcast(reach), "size", "left_semi")  # less than LONG + MOST rows

    a = within_reach(left, right).select("text", "size", F.explode(_remains(F.col("text"))).alias("key"))
    b = within_reach(right, left).select(F.col("text").alias("other"), F.col("size").alias("size_b"), F.explode(_remains(F.col("text"))).alias("key"))
    met = a.join(b.hint("merge"), "key").where(F.abs(F.col("size") - F.col("size_b")) <= allowed_edits(F.greatest("size", "size_b")))
    return met.select("text", "other")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(text, other): strings that meet in a file and pass the filters, once per file they meet in. Both sides have distinct ``text``."""
    met = _short_candidates(left, right).unionByName(_long_candidates(left, right))
    return met.where(F.col("text") != F.col("other"))


def near_titles(left: DataFrame, right: DataFrame, column: str = "t") -> DataFrame:
    """(``column``, other, edits) of all strings of ``left`` and ``right`` that are near but not equal; nulls are near nothing."""
    cores = left.sparkSession.sparkContext.defaultParallelism  # titles are few bytes that become many, whatever their size says
    once = lambda df: df.select(F.col(column).alias("text")).where("text IS NOT NULL").repartition(cores, "text").distinct()
    met = candidates(once(left), once(right)).withColumn("edits", F.levenshtein("text", "other", MOST))
    longest = F.greatest(F.length("text"), F.length("other"))
    near = met.where((F.col("edits") >= 0) & (F.col("edits") <= allowed_edits(longest)))
    return near.distinct().withColumnRenamed("text", column)
