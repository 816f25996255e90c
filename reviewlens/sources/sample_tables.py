"""Views of the order tables in the shape of a catalogue and its reviews.

Every view is a lazy projection; a review view joins only the tables its requested columns need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item_title():
    return F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("book_id"),
        _item_title().alias("title_std"),
        F.col("p_brand").alias("authors_std"),
        F.concat(F.lit("Publisher "), F.col("p_size").cast("string")).alias("publisher_std"),
        F.concat(F.col("p_type"), F.lit(", "), F.col("p_name")).alias("categories_std"),
        (F.lit(1951) + F.col("p_partkey") % 74).cast("int").alias("pub_year"),
    )


def books_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue as it arrives: mixed spellings, list literals, partial dates and gaps."""
    key = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.lit(" "), (key % 400).cast("string"))
    brand = F.lower(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        key.alias("book_id"),
        F.when(key % 29 == 0, F.lit(None))
        .when(key % 3 == 0, F.initcap(name))
        .when(key % 7 == 0, F.concat(F.upper(name), F.lit("!")))
        .otherwise(name)
        .cast("string")
        .alias("title"),
        F.when(key % 13 == 0, F.lit(None))
        .when(key % 11 == 0, F.col("p_brand"))
        .when(key % 5 == 0, F.concat(F.lit("['"), F.col("p_brand"), F.lit("', \""), brand, F.lit(" O'Neil\"]")))
        .otherwise(F.concat(F.lit("['"), F.col("p_brand"), F.lit("']")))
        .cast("string")
        .alias("authors"),
        F.when(key % 17 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("Publisher #"), F.col("p_size").cast("string"), F.lit(", Inc.")))
        .cast("string")
        .alias("publisher"),
        F.when(key % 19 == 0, F.lit("unknown"))
        .when(key % 3 == 0, (F.lit(1951) + key % 74).cast("string"))
        .when(key % 3 == 1, F.concat((F.lit(1951) + key % 74).cast("string"), F.lit("-07")))
        .otherwise(F.concat((F.lit(1951) + key % 74).cast("string"), F.lit("-07-04")))
        .alias("published_date"),
        F.when(key % 23 == 0, F.lit("[]"))
        .otherwise(F.concat(F.lit("['"), F.initcap(F.col("p_type")), F.lit("', '"), F.col("p_name"), F.lit("']")))
        .alias("categories"),
    )


def books_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardised catalogue with missing fields, as enrichment receives it."""
    key = F.col("book_id")
    full = books(spark, sf_dir)
    return full.select(
        "book_id",
        "title_std",
        F.when(key % 4 != 0, F.col("authors_std")).alias("authors_std"),
        F.when(key % 6 == 0, F.lit("")).otherwise(F.when(key % 5 != 0, F.col("publisher_std"))).alias("publisher_std"),
        F.when(key % 7 != 0, F.col("categories_std")).alias("categories_std"),
        F.when(key % 9 != 0, F.col("pub_year")).alias("pub_year"),
    )


def books_with_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with gaps, a letter of the first word wrong in a third of the titles and missing in another third."""
    title, kind = F.col("title_std"), F.col("book_id") % 3
    wrong = F.concat(F.substring(title, 1, 1), F.lit("q"), F.expr("substring(title_std, 3)"))
    missing = F.concat(F.substring(title, 1, 1), F.expr("substring(title_std, 3)"))
    return books_with_gaps(spark, sf_dir).withColumn("title_std", F.when(kind == 1, wrong).when(kind == 2, missing).otherwise(title))


def reference_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second catalogue of the same items with reworded titles, for enrichment."""
    key = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .where(key % 10 != 9)
        .select(
            F.concat(F.lit("OL"), key.cast("string")).alias("key"),
            F.when(key % 3 == 0, _item_title())
            .when(key % 3 == 1, F.concat(F.lit("The "), F.initcap(F.col("p_name")), F.lit(", #"), key.cast("string")))
            .otherwise(F.concat(_item_title(), F.lit(" and other stories of the old trade")))
            .alias("title"),
            F.array(F.col("p_brand"), F.concat(F.lit("Editor "), F.col("p_size").cast("string"))).alias("author_name"),
            F.array(F.concat(F.lit("House "), F.col("p_size").cast("string"))).alias("publisher"),
            F.array(F.concat(F.lit("May "), (F.lit(1951) + key % 74).cast("string"))).alias("publish_date"),
            F.array(F.col("p_type"), F.col("p_name")).alias("subject"),
            F.when(key % 2 == 0, (F.lit(1951) + key % 74).cast("int")).alias("first_publish_year"),
        )
    )


def _review_id(item: str = "l_partkey"):
    return F.concat_ws("-", "l_orderkey", "l_linenumber", item, "l_suppkey").alias("review_id")


def _label():
    return (
        F.when(F.col("l_quantity") >= 49, F.lit("n/a"))
        .when((F.col("l_quantity") < 3) & (F.col("l_tax") >= 0.08), F.lit(None))
        .when(F.col("l_returnflag") == "R", F.lit("negativo"))
        .when(F.col("l_returnflag") == "A", F.lit("positivo"))
        .otherwise(F.lit("neutro"))
        .alias("sentimento")
    )


def _polarity():
    return F.when(~(F.col("l_quantity") >= 49), (F.round(F.col("l_discount") * 100) - 5) / 5).alias("compound")


def reviews(
    spark: SparkSession,
    sf_dir: str,
    user: bool = False,
    text: bool = False,
) -> DataFrame:
    """Reviews from order lines: title, polarity, label and rating, plus the user and the text on request."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", _item_title().alias("title"))
    out = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    columns = [
        _review_id(),
        F.col("title"),
        (F.lit(1.0) + F.col("l_quantity").cast("int") % 5).alias("score"),
        _label(),
        _polarity(),
    ]
    if user:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        columns.append(F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("user_id"))
    if text:
        docs = table(spark, sf_dir, "documents")
        total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
        out = out.withColumn("text_key", F.col("l_orderkey") % total).join(
            docs.select("doc_id", "text"), F.col("text_key") == F.col("doc_id")
        )
        columns.append(F.col("text"))
    return out.select(*columns)


def review_keys(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame | Column]:
    """The reviews with text of :func:`reviews` before anything is joined, as :func:`summaries.prompts_by_key` takes them.

    A title ends with the key of its item, so no two items share one.
    """
    parts, docs = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return {
        "reviews": table(spark, sf_dir, "lineitem").select(
            F.col("l_partkey").alias("item"), "l_orderkey", "l_linenumber", "l_suppkey", _label(), _polarity()
        ),
        "items": parts.select(F.col("p_partkey").alias("item"), _item_title().alias("title")),
        "texts": docs.select(F.col("doc_id").alias("text_key"), "text"),
        "review_id": _review_id("item"),
        "text_key": F.col("l_orderkey") % total,
    }
