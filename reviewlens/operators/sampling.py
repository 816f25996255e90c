"""Exact-size, repeatable samples.

A sample is the set of rows with the smallest seeded hash of their identifying columns. The cut-off row is found by
selection: one scan of the identifying columns counts the rows of equal ranges of hash values, and a second one reads the
range that holds the cut-off (ranges that are still large are counted once more, each time 65,536 times finer). Drawing 10%
of a large table is then a filter on its scan: no row is sorted or moved, and repeating the draw under another
partitioning gives the same rows. ``keys`` must identify a row.

The hash is XXH64, or with ``digest="md5"`` the first 60 bits of the MD5 sum of ``seed|key|...``, which other engines have too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.operators.lookup import salted_lookup
from reviewlens.session import cut_lineage

BUCKET_BITS = 16  # a scan counts 65,536 ranges of hash values, of the table or of every stratum
ROWS_PER_BUCKET = 100_000  # a range with fewer rows is ranked as it is


def _hash(keys: list[str], seed: int, digest: str = "xxhash64") -> Column:
    """A long whose order is that of the draw."""
    if digest == "xxhash64":
        return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    if digest != "md5":
        raise ValueError("digest must be 'xxhash64' or 'md5'")
    told = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    value = F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.shiftleft(value - F.lit(1 << 59), 4)


def _order(keys: list[str], hashed: Column) -> Column:
    return F.struct(hashed.alias("h"), *[F.col(k) for k in keys])


def _range(h: Column | str, shift: Column | int) -> Column:
    """Number of the range of ``h`` that is left when ``shift`` low bits go; there is one range for 64."""
    h = F.col(h) if isinstance(h, str) else h
    shift = F.lit(shift) if isinstance(shift, int) else shift
    return F.when(shift >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", h, F.least(shift, F.lit(63))))


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def take_sample(
    df: DataFrame, n: int | None, keys: list[str], seed: int = 42, fraction: float | None = None, digest: str = "xxhash64"
) -> DataFrame:
    """Exactly ``n`` rows, or all of them when there are fewer; with ``fraction`` that share of the rows instead.

    The driver reads the counts of at most 65,536 ranges per scan, and one row.
    """
    narrow = df.select(*keys).withColumn("h", _hash(keys, seed, digest))
    inside, shift = narrow, 64
    while True:
        shift -= BUCKET_BITS
        counts = sorted(tuple(r) for r in inside.groupBy(_range("h", shift).alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).collect())
        if n is None:
            n = _share(sum(rows for _, rows in counts), fraction)
        if n <= 0:
            return df.where(F.lit(False))
        need = n if shift == 64 - BUCKET_BITS else need
        for bucket, rows in counts:
            if need <= rows:
                break
            need -= rows
        else:
            return df  # no more rows than asked for
        inside = narrow.where(_range("h", shift) == bucket)
        if rows <= ROWS_PER_BUCKET or shift == 0:
            break
    cut = inside.orderBy("h", *keys).limit(need).agg(F.max(_order(keys, F.col("h"))).alias("cut")).first()["cut"]
    types = {f.name: f.dataType for f in narrow.schema.fields}
    limit = F.struct(*[F.lit(cut[c]).cast(types[c]).alias(c) for c in ("h", *keys)])
    return df.where(_order(keys, _hash(keys, seed, digest)) <= limit)


def _share(total: int, fraction: float) -> int:
    return round(total * fraction)  # half to even


def sample_percent(df: DataFrame, percent: int, keys: list[str], seed: int = 42, digest: str = "xxhash64") -> DataFrame:
    if not 1 <= percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    return take_sample(df, None, keys, seed, fraction=percent / 100, digest=digest)


def sample_before_scoring(
    df: DataFrame, keys: list[str], frac: float | None = None, n: int | None = None, seed: int = 42
) -> DataFrame:
    """A fraction, else a number of rows, else everything."""
    if frac:
        return take_sample(df, None, keys, seed, fraction=frac)
    return take_sample(df, n, keys, seed) if n else df


def stratum_quotas(counts: DataFrame, size: int, total: int, seed: int, digest: str = "xxhash64") -> DataFrame:
    """Rows to draw per stratum: proportional share, largest remainders rounded up, ties by hash.

    ``counts`` holds (stratum, rows). A draw is only stratified when it has at least one row per stratum, so this
    table never has more than ``size`` rows and one window over it is safe.
    """
    product = f"(CAST(rows AS DECIMAL(19, 0)) * CAST({size} AS DECIMAL(19, 0)))"  # beyond 64 bits for large strata
    share = counts.withColumns(
        {
            "base": F.expr(f"CAST({product} div {total} AS BIGINT)"),
            "rest": F.expr(f"CAST({product} % {total} AS BIGINT)"),
        }
    )
    missing = F.lit(size) - F.sum("base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), _hash(["stratum"], seed, digest), "stratum"))
    return share.select(
        "stratum", "rows", (F.col("base") + F.when(place <= missing, 1).otherwise(0)).alias("quota")
    )


def sample_stratified(
    df: DataFrame, size: int, column: str, keys: list[str], seed: int = 42, report_only: bool = False, digest: str = "xxhash64"
) -> DataFrame:
    """A proportional sample by ``column``; NULL becomes the stratum ``'missing'`` and stays visible as such.

    The whole input is returned when it is no larger than ``size``. As a proportional split needs two rows in every
    stratum and one per stratum on either side, anything else falls back to a plain draw of ``size`` rows. With
    ``report_only`` the strata and their quotas are returned instead of the rows.
    """
    if column not in df.columns:
        return df if row_total(df) <= size else take_sample(df, size, keys, seed, digest=digest)
    filled = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("missing")))
    counts = filled.groupBy(F.col(column).alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))
    shape = counts.agg(F.sum("rows").alias("total"), F.count(F.lit(1)).alias("strata"), F.min("rows").alias("least")).first()
    total = shape["total"] or 0
    if size >= total:
        return counts.withColumn("quota", F.col("rows")) if report_only else df
    drawn = int(size / total * total)  # the split is asked for a fraction, so the size passes through a division
    if shape["least"] < 2 or drawn < shape["strata"] or total - drawn < shape["strata"]:
        return take_sample(df, size, keys, seed, digest=digest)
    quotas = stratum_quotas(counts, drawn, total, seed, digest)
    if report_only:
        return quotas
    return _take_quotas(filled, column, quotas, keys, seed, digest)


def row_total(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def _take_quotas(df: DataFrame, column: str, quotas: DataFrame, keys: list[str], seed: int, digest: str) -> DataFrame:
    """The ``quota`` rows with the smallest hash in every stratum, by the same selection as take_sample.

    ``edges`` has for every stratum the range of hash values that holds its cut-off row, the rows in it and how many of them
    are still to be drawn. A round narrows the ranges that have too many rows to be ranked.
    """
    edges = cut_lineage(quotas.where(F.col("quota") > 0).select(
        "stratum", F.lit(0).cast("long").alias("bucket"), F.lit(64).alias("shift"), F.col("rows").cast("long").alias("rows"),
        F.col("quota").cast("long").alias("need")))
    narrow = df.select(F.col(column).alias("stratum"), *keys).withColumn("h", _hash(keys, seed, digest))

    def inside(wanted: DataFrame) -> DataFrame:
        met = salted_lookup(narrow, wanted, "stratum", F.col("h"), "inner")
        return met.where(_range("h", F.col("shift")) == F.col("bucket"))

    large = (F.col("rows") > ROWS_PER_BUCKET) & (F.col("shift") > 0)
    while not edges.where(large).isEmpty():
        finer = inside(edges.where(large)).withColumn("shift", F.col("shift") - BUCKET_BITS).withColumn("bucket", _range("h", F.col("shift")))
        counts = finer.groupBy("stratum", "shift", "need", "bucket").agg(F.count(F.lit(1)).alias("rows"))
        before = F.sum("rows").over(Window.partitionBy("stratum").orderBy("bucket")) - F.col("rows")
        narrowed = counts.withColumn("before", before).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("rows") >= F.col("need")))
        narrowed = narrowed.select("stratum", "bucket", "shift", "rows", (F.col("need") - F.col("before")).alias("need"))
        edges = cut_lineage(edges.where(~large).unionByName(narrowed))
    order = _order(keys, F.col("h"))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(order))
    cuts = inside(edges).withColumn("rank", rank).where(F.col("rank") == F.col("need")).select("stratum", order.alias("cut"))
    rows = df.withColumns({"h": _hash(keys, seed, digest), "stratum": F.col(column)})
    return (
        salted_lookup(rows, cut_lineage(cuts), "stratum", F.col("h"), "inner")
        .where(order <= F.col("cut"))
        .select(*df.columns)
    )


def reviews_of_sample(reviews: DataFrame, books: DataFrame, key: str = "title") -> DataFrame:
    """Reviews whose title occurs in the sampled catalogue; a NULL title matches a NULL title."""
    titles = books.select(F.col(key).alias("_t")).distinct()
    return reviews.join(titles, F.col(key).eqNullSafe(F.col("_t")), "left_semi")


def sample_pair(
    books: DataFrame,
    reviews: DataFrame,
    use_sample: bool = True,
    mode: str = "percentage",
    books_percentage: int = 5,
    reviews_percentage: int = 2,
    sample_size: int = 10_000,
    stratify_column: str = "categories",
    seed: int = 42,
    book_keys: tuple[str, ...] = ("book_id",),
    review_keys: tuple[str, ...] = ("review_id",),
    digest: str = "xxhash64",
) -> tuple[DataFrame, DataFrame]:
    """Sample catalogue and reviews together: independently by percentage, or a fixed-size stratified catalogue
    with the reviews of its titles."""
    if not use_sample:
        return books, reviews
    if mode == "percentage":
        return (
            sample_percent(books, books_percentage, list(book_keys), seed, digest),
            sample_percent(reviews, reviews_percentage, list(review_keys), seed, digest),
        )
    if mode == "fixed":
        if row_total(books) <= sample_size:
            return books, reviews
        picked = sample_stratified(books, sample_size, stratify_column, list(book_keys), seed, digest=digest)
        return picked, reviews_of_sample(reviews, picked) if "title" in reviews.columns else reviews
    raise ValueError(f"mode must be 'fixed' or 'percentage', got {mode!r}")
