"""Explicit schemas of the raw files and of the standardised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


S, L, D, I = StringType(), LongType(), DoubleType(), IntegerType()

# Columns of the public catalogue and review files.
BOOKS_CSV = _struct(Title=S, description=S, authors=S, image=S, previewLink=S, publisher=S, publishedDate=S, infoLink=S,
                    categories=S, ratingsCount=D)
REVIEWS_CSV = StructType(
    [
        StructField(name, D if name in ("Price", "review/score") else S, True)
        for name in ("Id", "Title", "Price", "User_id", "profileName", "review/helpfulness", "review/score",
                     "review/time", "review/summary", "review/text")
    ]
)
RENAMES = {
    "Title": "title",
    "publishedDate": "published_date",
    "User_id": "user_id",
    "review/score": "score",
    "review/text": "text",
    "Title_padrao": "title_std",
    "authors_padrao": "authors_std",
    "publisher_padrao": "publisher_std",
    "categories_padrao": "categories_std",
    "publishedDate_padrao": "pub_year",
}

BOOKS_RAW = _struct(book_id=L, title=S, authors=S, publisher=S, published_date=S, categories=S)
BOOKS = _struct(book_id=L, title_std=S, authors_std=S, publisher_std=S, categories_std=S, pub_year=I)
REVIEWS = _struct(review_id=S, title=S, user_id=S, text=S, score=D, title_norm=S, sentimento=S, compound=D)
CATALOG = _struct(key=S, title=S, author_name=ArrayType(S), publisher=ArrayType(S), publish_date=ArrayType(S),
                  subject=ArrayType(S), first_publish_year=I)


def with_standard_names(df: DataFrame) -> DataFrame:
    """Rename the columns of the public files to the names used here; other columns stay."""
    return df.select(*[F.col(f"`{c}`").alias(RENAMES.get(c, c)) for c in df.columns])
