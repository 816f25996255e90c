"""Filling missing catalogue fields from a reference catalogue.

The reference catalogue is a DataFrame ``(key, title, author_name[], publisher[], publish_date[], subject[],
first_publish_year)``. A book is looked up by up to four search strategies; each strategy is an equality key on both
sides, and a search returns every catalogue row of the key. With ``near``, a fifth one returns the rows whose title is a few
edits away (``near_titles``). Rows are judged as they are joined: a book and strategy keep
one best hit per task, so nothing per key is gathered or ordered.

Both sides of every join grow with the catalogue and are shuffled (``merge``): their files are small beside their rows, and
a broadcast chosen by the size of the files would gather the catalogue in the driver.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from reviewlens.functions.numeric import count_where, percent, rounded
from reviewlens.functions.text import search_author, search_title, year_in_text
from reviewlens.operators.lookup import counted_keys, salted_lookup
from reviewlens.operators.near_titles import near_titles
from reviewlens.operators.quantiles import quantile_columns
from reviewlens.operators.ranking import top_per_group
from reviewlens.operators.sampling import row_count, take_sample
from reviewlens.session import cut_lineage, spread

# Strategies in the order they are tried, the single default strategy, and the matching rule.
STRATEGIES = ["titulo_autor", "titulo_completo", "busca_geral", "palavras_chave"]
DEFAULT_STRATEGY = "padrao"
NEAR_STRATEGY = "titulo_proximo"  # titles a few edits apart, tried after all equality keys when it is asked for
AUTHOR_BONUS, AUTHOR_MATCH = 0.2, 0.7
ACCEPT, GOOD_ENOUGH, CERTAIN = 0.6, 0.8, 0.9
FIELDS = ["authors_std", "publisher_std", "categories_std", "pub_year"]


def _ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two lower-case strings; 0 if either is empty."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)])


@pandas_udf(DoubleType())
def best_matching_ratio(a: pd.Series, many: pd.Series) -> pd.Series:
    """The highest similarity of one string with any of several."""
    return pd.Series(
        [max((_ratio(x, y) for y in ys), default=0.0) if x and ys is not None else 0.0 for x, ys in zip(a, many)]
    )


def edit_ratio(a: Column, b: Column) -> Column:
    """Native alternative: 1 - edit distance / length of the longer string."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1.0 - F.levenshtein(a, b) / longest).otherwise(0.0)


def similarity(a: Column, b: Column, measure: str = "matching") -> Column:
    a, b = F.lower(a), F.lower(b)
    return edit_ratio(a, b) if measure == "edit" else matching_ratio(a, b)


def missing_records(books: DataFrame) -> DataFrame:
    """Books lacking any of publisher, authors, categories or year; an empty string counts as lacking."""
    lacking = F.col("pub_year").isNull()
    for c in ("publisher_std", "authors_std", "categories_std"):
        lacking = lacking | F.col(c).isNull() | (F.col(c) == "")
    return books.where(lacking)


def _strategy_keys(title: Column, authors: Column, multiple: bool) -> Column:
    """Array of (rank, strategy, search key) of a normalised title and an array of normalised authors."""
    words = F.split(title, " ")
    head = F.array_join(F.slice(words, 1, 3), " ")

    def entry(rank: int, name: str, key: Column) -> Column:
        return F.struct(F.lit(rank).alias("strategy_rank"), F.lit(name).alias("strategy"), key.alias("search_key"))

    if not multiple:
        return F.array(entry(1, DEFAULT_STRATEGY, title))
    with_author = F.transform(authors, lambda a: entry(1, STRATEGIES[0], F.concat(title, F.lit(" | "), a)))
    without = F.array(
        entry(2, STRATEGIES[1], title),
        entry(3, STRATEGIES[2], F.array_join(F.array_sort(F.array_distinct(words)), " ")),
        entry(4, STRATEGIES[3], F.when(F.length(head) > 5, head)),
    )
    return F.concat(with_author, F.filter(without, lambda k: k["search_key"].isNotNull()))


def _one_author(author: Column) -> Column:
    return F.filter(F.array(author), lambda a: a.isNotNull())


def search_keys(books: DataFrame, multiple: bool = True) -> DataFrame:
    """``(book_id, strategy_rank, strategy, search_key)`` for every book with a searchable title."""
    return (
        books.select(
            "book_id", search_title(F.col("title_std")).alias("t"), search_author(F.col("authors_std")).alias("a")
        )
        .where(F.col("t") != "")
        .select("book_id", F.inline(_strategy_keys(F.col("t"), _one_author(F.col("a")), multiple)))
    )


def _field_columns() -> dict[str, Column]:
    def joined(c: str, k: int) -> Column:
        return F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, k), ", "))

    first_year = F.when(F.col("first_publish_year") != 0, F.col("first_publish_year"))
    return {
        "authors_std": joined("author_name", 3),
        "publisher_std": F.get("publisher", F.lit(0)),
        "categories_std": joined("subject", 5),
        "pub_year": F.coalesce(first_year, year_in_text(F.get("publish_date", F.lit(0)))).cast("int"),
    }


def extract_fields(catalog: DataFrame) -> DataFrame:
    """Catalogue rows reduced to what an enriched book takes over."""
    return catalog.select("key", *[c.alias(name) for name, c in _field_columns().items()])


def _titled(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with a searchable title ``t``."""
    return catalog.select(
        "key", "title", "author_name", *[c.alias(n) for n, c in _field_columns().items()],
        search_title(F.col("title")).alias("t"),
    ).where(F.col("t") != "")


def _keyed(catalog: DataFrame, multiple: bool) -> DataFrame:
    """Catalogue rows once per search key, with the number of rows that share the key; see ``catalogue_index``."""
    rows = _titled(spread(catalog))
    authors = F.array_distinct(F.filter(F.transform("author_name", search_author), lambda a: a.isNotNull()))
    keyed = rows.withColumn("a", F.coalesce(authors, F.array().cast("array<string>"))).select(
        "key", "title", "author_name", *FIELDS, F.inline(_strategy_keys(F.col("t"), F.col("a"), multiple))
    )
    keyed = keyed.withColumn("_k", F.concat_ws(":", "strategy_rank", "search_key")).drop("search_key")
    counts = keyed.groupBy("_k").agg(F.count(F.lit(1)).cast("int").alias("n_found"))
    return salted_lookup(keyed, counts, "_k", F.xxhash64("key"), "inner", counted_keys(counts, "_k", "n_found"))


def _common_share(a: Column, b: Column) -> Column:
    """Upper bound of the matching ratio: letters the two share, whatever their order."""
    letters = F.array_distinct(F.split(a, ""))
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    shared = F.aggregate(letters, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    return F.coalesce(2.0 * shared / (F.length(a) + F.length(b)), F.lit(0.0))


def _wanted(books: DataFrame) -> DataFrame:
    """Books with a searchable title ``t``."""
    return books.select(
        "book_id",
        F.col("title_std").alias("book_title"),
        search_title(F.col("title_std")).alias("t"),
        search_author(F.col("authors_std")).alias("book_author"),
    ).where(F.col("t") != "")


def near_pairs(books: DataFrame, catalog: DataFrame) -> DataFrame:
    """(t, other, edits, n_found): search titles of books, catalogue titles near them, and the catalogue rows near each book title."""
    rows = _titled(catalog)
    pairs = near_titles(_wanted(books), rows)
    uses = rows.groupBy(F.col("t").alias("other")).agg(F.count(F.lit(1)).alias("_uses"))
    counted = pairs.join(uses.hint("merge"), "other")
    found = counted.groupBy("t").agg(F.sum("_uses").cast("int").alias("n_found"))
    return pairs.join(found.hint("merge"), "t").select("t", "other", "edits", "n_found")


def _near_hits(books: DataFrame, catalog: DataFrame) -> DataFrame:
    """Hits of the near titles, in the shape of the other strategies' hits."""
    pairs = near_pairs(books, catalog).drop("edits")
    wanted = _wanted(books).join(pairs.hint("merge"), "t").drop("t")
    return wanted.join(_titled(catalog).withColumnRenamed("t", "other").hint("merge"), "other").drop("other").withColumns(
        {"strategy_rank": F.lit(len(STRATEGIES) + 1), "strategy": F.lit(NEAR_STRATEGY)})


def match_scores(
    books: DataFrame, catalog: DataFrame, multiple: bool = True, measure: str = "matching", above: float | None = None, near: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """Every search hit with its similarity: title similarity plus the bonus for a matching author.

    With ``above``, hits that cannot exceed it even with the bonus are dropped before the similarity is computed. With
    ``near``, titles a few edits apart are hits of a last strategy. ``index`` is a stored ``catalogue_index``.
    """
    rows = _keyed(catalog, multiple) if index is None else index
    wanted = (
        _wanted(spread(books))
        .select("book_id", "book_title", "book_author", F.inline(_strategy_keys(F.col("t"), _one_author(F.col("book_author")), multiple)))
        .withColumn("_k", F.concat_ws(":", "strategy_rank", "search_key"))
        .drop("search_key", "strategy_rank", "strategy")
    )
    hits = salted_lookup(wanted, rows, "_k", F.xxhash64("book_id"), "inner").drop("_k")
    if near:
        hits = hits.unionByName(_near_hits(books, catalog))
    if above is not None and measure == "matching":
        hits = hits.where(_common_share(F.lower("book_title"), F.lower("title")) + AUTHOR_BONUS > above)
    authors = F.transform("author_name", F.lower)
    if measure == "edit":
        author_score = F.coalesce(F.array_max(F.transform(authors, lambda x: edit_ratio(F.col("book_author"), x))), F.lit(0.0))
    else:
        author_score = best_matching_ratio(F.col("book_author"), authors)
    bonus = F.when(F.col("book_author").isNotNull() & (author_score > AUTHOR_MATCH), AUTHOR_BONUS).otherwise(0.0)
    return hits.withColumn("similarity", similarity(F.col("book_title"), F.col("title"), measure) + bonus)


def best_matches(hits: DataFrame) -> DataFrame:
    """One row per book with an accepted hit.

    Hits are judged in the order of strategy and key. The first certain hit wins outright; otherwise the search ends after
    the first strategy that offers a good enough hit, and the best hit so far wins, the earlier one on a tie.
    """
    s = F.col("similarity")
    payload = F.struct(*FIELDS, "strategy", "similarity", "n_found", "key")
    # Certain hits come first in search order, the rest by similarity; a minimum over one struct decides.
    certain = s > CERTAIN
    place = F.struct(
        F.when(certain, 0).otherwise(1).alias("class"),
        F.when(certain, 0.0).otherwise(-s).alias("worse"),
        "strategy_rank",
        "key",
        payload.alias("hit"),
    )
    # One row per book and strategy leaves every task; the few that meet per book then decide how far the search went.
    per_strategy = hits.where(s > ACCEPT).groupBy("book_id", "strategy_rank").agg(
        F.min(place).alias("place"), F.max(s > GOOD_ENOUGH).alias("good")
    )
    last = F.min(F.when(F.col("good"), F.col("strategy_rank"))).over(Window.partitionBy("book_id"))
    reached = per_strategy.withColumn("last", last).where(F.col("last").isNull() | (F.col("strategy_rank") <= F.col("last")))
    return (
        reached.groupBy("book_id")
        .agg(F.min("place")["hit"].alias("hit"))
        .select("book_id", "hit.*")
        .withColumnRenamed("key", "catalog_key")
    )


def find_metadata(
    books: DataFrame, catalog: DataFrame, multiple: bool = True, measure: str = "matching", near: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """``(book_id, fields, strategy, similarity, n_found)`` per book; no match gives NULL fields and similarity 0.

    Books with the same title and authors are searched once.
    """
    keyed = books.select(
        "book_id", "title_std", "authors_std", F.sha2(F.to_json(F.struct("title_std", "authors_std")), 256).alias("_q")
    )
    queries = keyed.groupBy("_q").agg(
        F.min("book_id").alias("rep"), F.any_value("title_std").alias("title_std"), F.any_value("authors_std").alias("authors_std")
    )
    hits = match_scores(queries.withColumnRenamed("rep", "book_id"), catalog, multiple, measure, ACCEPT, near, index)
    best = best_matches(hits).drop("catalog_key").withColumnRenamed("book_id", "rep")
    answers = queries.select("_q", "rep").join(best.hint("merge"), "rep").drop("rep")
    return salted_lookup(keyed.select("book_id", "_q"), answers, "_q", F.xxhash64("book_id")).select(
        "book_id",
        *FIELDS,
        "strategy",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("n_found", F.lit(0)).alias("n_found"),
    )


def apply_enrichment(books: DataFrame, found: DataFrame, fill_only: bool = False) -> DataFrame:
    """Take over found fields. They replace existing values as well unless ``fill_only``; unknown ids are ignored."""
    new = found.select("book_id", *[F.col(c).alias(f"_{c}") for c in FIELDS])

    def merged(c: str) -> Column:
        old, fresh = F.col(c), F.col(f"_{c}")
        return F.coalesce(old, fresh) if fill_only else F.coalesce(fresh, old)

    return books.join(new.hint("merge"), "book_id", "left").select(
        *[merged(c).alias(c) if c in FIELDS else F.col(c) for c in books.columns]
    )


def enrich_missing(
    books: DataFrame, catalog: DataFrame, limit: int | None = None, measure: str = "matching", near: bool = False
) -> DataFrame:
    """Search results for the books that lack a field, or for the first ``limit`` of them."""
    wanted = missing_records(books)
    if limit is not None:
        wanted = wanted.orderBy("book_id").limit(limit)
    return find_metadata(wanted, catalog, measure=measure, near=near)


def _written(df: DataFrame, path: str) -> None:
    """Write ``df`` under ``path`` unless that was done before: Spark marks a folder that was written whole."""
    try:
        # A folder without its mark is a write that was cut off.
        df.sparkSession.read.format("binaryFile").load(f"{path}/_SUCCESS").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("overwrite").parquet(path)


def catalogue_index(catalog: DataFrame, path: str, multiple: bool = True) -> DataFrame:
    """The catalogue under its search keys, written once under ``path`` and sorted by key; a second call reads it."""
    keyed = _keyed(catalog, multiple)
    _written(keyed.sortWithinPartitions("_k"), path)
    return catalog.sparkSession.read.schema(keyed.schema).parquet(path)


def enrich_to_stage(
    books: DataFrame, catalog: DataFrame, path: str, measure: str = "matching", pieces: int = 16, near: bool = False
) -> DataFrame:
    """:func:`enrich_missing` written piece by piece under ``path``; a second call goes on where the first one stopped.

    A piece holds the books whose id hashes to it. The catalogue is keyed and counted once for all of them.
    """
    root = path.rstrip("/")
    index = catalogue_index(catalog, f"{root}/index")
    wanted = cut_lineage(missing_records(books))
    folders = [f"{root}/found/piece={k}" for k in range(pieces)]
    for k, folder in enumerate(folders):
        part = wanted.where(F.pmod(F.xxhash64("book_id"), F.lit(pieces)) == k)
        _written(find_metadata(part, catalog, measure=measure, near=near, index=index), folder)
    return books.sparkSession.read.parquet(*folders)


def enrichment_summary(found: DataFrame) -> DataFrame:
    """Books searched, books with at least one field found, success rate."""
    success = F.lit(False)
    for c in FIELDS[:3]:
        success = success | (F.coalesce(F.col(c), F.lit("")) != "")
    success = success | (F.coalesce(F.col("pub_year"), F.lit(0)) != 0)
    return found.agg(F.count(F.lit(1)).alias("processed"), count_where(success).alias("succeeded")).withColumn(
        "success_pct", F.coalesce(percent(F.col("succeeded"), F.col("processed")), F.lit(0.0))
    )


# Search diagnosis -------------------------------------------------------------------------------------------


def diagnose_titles(books: DataFrame) -> DataFrame:
    """What may hinder a search: very short or long titles, no author, special characters."""
    title = F.coalesce("title_std", F.lit("nan"))
    author = F.trim(F.coalesce("authors_std", F.lit("")))
    return books.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(F.length(title) < 5).alias("too_short"),
        count_where(F.length(title) > 100).alias("too_long"),
        count_where(author.isin("", "nan")).alias("no_author"),
        count_where(title.rlike(r"[^\p{L}\p{N}_\s]")).alias("special_characters"),
    )


def diagnose_strategies(found: DataFrame) -> DataFrame:
    return (
        found.groupBy("strategy")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pct", rounded(percent(F.col("n"), row_count(found)), 1))
    )


def diagnose_similarity(found: DataFrame) -> DataFrame:
    s = F.col("similarity")
    found = cut_lineage(found.select(s))  # the median reads it more than once
    (median,) = quantile_columns(found, s, [0.5])
    return found.agg(
        rounded(F.avg(s), 3).alias("mean"),
        rounded(median, 3).alias("median"),
        count_where(s > 0.8).alias("high"),
        count_where((s >= 0.6) & (s <= 0.8)).alias("medium"),
        count_where(s < 0.6).alias("low"),
    )


def diagnose_examples(books: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """Up to ``k`` successes (similarity above 0.8) and ``k`` failures (below 0.3)."""
    outcome = F.when(F.col("similarity") > 0.8, "success").when(F.col("similarity") < 0.3, "failure")
    judged = found.select("book_id", "similarity", "strategy", F.col("authors_std").isNotNull().alias("author_found"), outcome.alias("outcome"))
    top = top_per_group(judged.where(F.col("outcome").isNotNull()), ["outcome"], [F.asc("book_id")], k)
    wanted = books.select("book_id", "title_std", F.col("authors_std").alias("author"))
    return wanted.join(F.broadcast(top.drop("rank")), "book_id").select(*[c for c in top.columns if c != "rank"], "title_std", "author")  # 2 * k rows


def diagnosis_sample(books: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    return take_sample(books, n, ["book_id"], seed)


def diagnose(books: DataFrame, catalog: DataFrame, n: int = 100, seed: int = 42, measure: str = "matching") -> DataFrame:
    """All parts of the search diagnosis of a sample in one row: titles, strategies, similarity, examples."""
    sample = cut_lineage(diagnosis_sample(books, n, seed))
    found = cut_lineage(find_metadata(sample, catalog, measure=measure))

    def listed(df: DataFrame, *order: str) -> Column:
        row = F.struct(*order, *[c for c in df.columns if c not in order])
        return df.agg(F.sort_array(F.collect_list(row)).alias("rows")).scalar()  # at most four strategies, or ten examples

    shape = diagnose_similarity(found)
    return diagnose_titles(sample).withColumns({
        "similarity": shape.select(F.struct(*shape.columns).alias("one")).scalar(),
        "strategies": listed(diagnose_strategies(found), "strategy"),
        "examples": listed(diagnose_examples(sample, found), "outcome", "book_id"),
    })
