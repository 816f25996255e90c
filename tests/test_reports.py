"""Reports on hand-made catalogues: every tier edge, labels without polarity, titles listed twice, gaps."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest

import oracle
from entry_queries import reports_q as Q
from entry_queries import sql
from reviewlens.plans import dashboard as D
from reviewlens.plans import reports as R
from reviewlens.plans import summaries as S

BOOK_SCHEMA = "book_id long, title_std string, authors_std string, publisher_std string, categories_std string, pub_year int"
REVIEW_SCHEMA = "review_id string, title string, user_id string, text string, score double, sentimento string, compound double"
VOLUMES = [0, 2, 4, 5, 9, 10, 11, 19, 20, 21, 50, 51, 100, 101, 501]
LABELS = ["positivo", "negativo", "neutro", "n/a", "erro", None]


def build():
    books, reviews = [], []
    for i, volume in enumerate(VOLUMES * 3):
        title = f"book {i}" if i % 11 else f"Book É 50% {i}"
        year = [1950, 1951, 1980, 1981, 1989, 1990, 1999, 2000, 2004, 2005, 2014, 2015, 2019, 2020, 2024, 2025, None][i % 17] if i < 32 else 2010
        author = [None, "", "ana, bo", "cy", f"solo {i}"][i % 5]
        publisher = [None, "", "P1", "P2", "P2", "P3"][i % 6]
        category = [None, "", " sci , x", "art", "sci", "art, y", ",z"][i % 7]
        books.append((i, title, author, publisher, category, year))
        for k in range(volume):
            label = LABELS[(i + k * k) % 6] if k % 3 else LABELS[k % 2]
            compound = None if label in ("n/a", "erro") else round(((i * 7 + k * 13) % 41 - 20) / 20, 4)
            if k % 10 == 1:
                compound = [0.05, -0.05, 0.1, -0.1, 0.3, -0.3, 0.0499][(k // 10 + i) % 7]
            text = [None, "short", "x" * 10, "y" * 11, "z" * 20, "w" * 21, "A long enough review text " * 12][(i + k) % 7]
            user = None if k % 13 == 0 else f"u{(i * 31 + k) % (7 if k % 2 else 60)}"
            reviews.append((f"{i:03d}-{k:04d}", title, user, text, float(1 + k % 5), label, compound))
    # One title on three catalogue rows, a book without title, reviews of unknown and missing titles.
    books += [(900, "book 14", "cy", "P2", "art", 2001), (901, "book 14", "dan", "P3", "sci", 2001), (902, None, "cy", "P1", "art", 1999)]
    for k in range(12):
        reviews.append((f"x{k}", None if k % 2 else "unknown", f"u{k % 3}", "A review of nothing we list here", 3.0, LABELS[k % 6], 0.2))
    return books, reviews


@pytest.fixture(scope="module")
def frames(spark):
    books, reviews = build()
    return spark.createDataFrame(books, BOOK_SCHEMA), spark.createDataFrame(reviews, REVIEW_SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def con():
    books, reviews = build()
    c = duckdb.connect()
    for name, rows, schema in (("fx_books", books, BOOK_SCHEMA), ("fx_reviews", reviews, REVIEW_SCHEMA)):
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        fields = [f.split() for f in schema.split(", ")]
        table = pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(fields)})
        c.register(f"{name}_arrow", table)
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return c


def on_fixture(statement: str) -> str:
    statement = statement.replace(sql.BOOKS, "books AS (SELECT * FROM fx_books)")
    for view in (sql.TEXT_REVIEWS, sql.USER_REVIEWS, sql.REVIEWS):
        statement = statement.replace(view, "reviews AS (SELECT * FROM fx_reviews)")
    statement = statement.replace("FROM part", "FROM fx_books")
    assert "lineitem" not in statement and "documents" not in statement
    return statement


def same(df, con, statement):
    got = oracle.canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(on_fixture(statement))
    want = oracle.canonical([d[0] for d in res.description], res.fetchall())
    assert got == want
    return len(got[1])


CASES = {
    "q01": lambda b, r: R.problematic_books(b, r),
    "q02": lambda b, r: R.users_for_interview(b, r),
    "q03": lambda b, r: R.roi_by_category(b, r),
    "q04": lambda b, r: R.roi_by_author(b, r),
    "q05": lambda b, r: R.sentiment_discrepancies(r),
    "q06": lambda b, r: R.best_books(b, r),
    "q07": lambda b, r: R.worst_books(b, r),
    "q08": lambda b, r: R.best_publishers(b, r),
    "q09": lambda b, r: R.worst_publishers(b, r),
    "q10": lambda b, r: R.best_themes(b, r),
    "q11": lambda b, r: R.worst_themes(b, r),
    "q12": lambda b, r: R.reviews_by_period(b, r),
    "q13": lambda b, r: R.reviews_by_year(b, r, end_year=2024),
    "q14": lambda b, r: R.recency_comparison(b, r),
    "q15": lambda b, r: R.recency_trend(b, r),
    "q20": lambda b, r: R.summary_stats(b, r),
    "q21": lambda b, r: R.sentiment_distribution(r),
    "q22": lambda b, r: R.books_to_summarise(b, r),
    "q23": lambda b, r: R.top_authors(b),
    "q24": lambda b, r: R.sentiment_counts(r),
    "q25": lambda b, r: R.books_by_decade(b),
    "ai_recommendation": lambda b, r: S.recommendations(R.books_info(b, r)),
    "ai_prompt": lambda b, r: S.summary_prompts(r),
    "ai_report": lambda b, r: S.book_reports(b, r),
}


@pytest.mark.parametrize("name", list(CASES))
def test_report(frames, con, name):
    assert same(CASES[name](*frames), con, oracle.entry.oracle_sql()[name]) > 0


@pytest.mark.parametrize("needle", ["50%", "BOOK 1", "é", "_", "Ana, B"])
def test_search_is_literal_and_ignores_case(frames, con, needle):
    low = needle.lower()
    statement = Q.Q16.replace("'red'", f"'{low}'")
    same(R.search_books(*frames, needle), con, statement)


def test_lookup_of_one_title(frames, con):
    for title in ("book 14", "book 3", "no such book"):
        info = R.book_info(*frames, title).collect()
        rows = con.execute(on_fixture(f"{Q.metrics(Q._BOOK_YEAR, f'''title_std = '{title}' ''')} {Q.INFO} ORDER BY titulo, autor, categoria, ano_publicacao")).fetchall()
        assert len(info) == min(len(rows), 1)
        if info:
            assert tuple(info[0]) == rows[0]
        for label in ("positivo", "negativo", "neutro"):
            got = [r["review_text"] for r in R.reviews_by_sentiment(frames[1], title, label).collect()]
            want = con.execute(
                "SELECT text FROM fx_reviews WHERE title = ? AND sentimento = ? AND length(trim(text)) > 20 "
                "ORDER BY abs(compound) DESC NULLS LAST, review_id LIMIT 10", [title, label]).fetchall()
            assert got == [w[0] for w in want]


def test_review_pages_keep_their_quota(frames):
    pages = R.top_reviews(frames[1]).groupBy("title", "sentimento").count().collect()
    assert max(r["count"] for r in pages if r["sentimento"] == "neutro") == 5
    assert max(r["count"] for r in pages if r["sentimento"] == "positivo") == 10


def test_result_does_not_depend_on_partitioning(spark, frames):
    books, reviews = frames
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = [tuple(r) for r in R.best_books(books, reviews).collect()]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert first == [tuple(r) for r in R.best_books(books.repartition(3), reviews.repartition(11)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shares_add_up(frames):
    total = sum(r["percentual"] for r in R.sentiment_distribution(frames[1]).collect())
    assert abs(total - 100) < 0.5
    for r in R.problematic_books(*frames, limit=1000).collect():
        assert r["reviews_negativos"] <= r["total_reviews"]


def test_filter_before_or_after_the_limit(frames):
    books, reviews = frames
    cut = D.select_users(R.users_for_interview(books, reviews, 10), "Regular", 3).count()
    whole = D.select_users_before_limit(books, reviews, "Regular", 3, 10).count()
    assert cut <= whole <= 10


def test_risk_levels(spark):
    frame = spark.createDataFrame([(50.1,), (50.0,), (25.1,), (25.0,), (0.0,)], "problema_score double")
    assert tuple(D.risk_counts(frame).first()) == (1, 2, 2)


def test_trend_needs_both_bands(frames):
    books, reviews = frames
    assert R.recency_trend(books.where("pub_year >= 2000"), reviews).count() == 0


def test_blank_query_lists_and_text_searches(frames):
    books, reviews = frames
    assert R.books_to_summarise(books, reviews, "  ").columns == R.books_to_summarise(books, reviews).columns
    assert "ano" in R.books_to_summarise(books, reviews, "book").columns


def test_recommendation_tiers(spark):
    rows = [("a", 9, 8, 0, 0.5), ("b", 101, 62, 3, 0.2), ("c", 50, 25, 5, -0.2), ("d", 50, 19, 5, 0.4), ("e", 50, 25, 5, 0.0)]
    frame = spark.createDataFrame(rows, "titulo string, total_reviews int, total_positivos int, total_negativos int, sentimento_medio double")
    got = {r["titulo"]: (r["recommendation"], r["business_priority"]) for r in S.recommendations(frame).collect()}
    assert got == {
        "a": (S.PROMOTE + S.FEW_REVIEWS, "Alta"),
        "b": (S.KEEP + S.MANY_REVIEWS, "Média"),
        "c": (S.REVIEW, "Alta"),
        "d": (S.REVIEW, "Alta"),
        "e": (S.MONITOR, "Baixa"),
    }


def write_tables(folder, documents, part, lineitem):
    import pyarrow.parquet as pq

    def put(name, schema, rows):
        names = [f.name for f in schema]
        pq.write_table(pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schema), folder / f"{name}.parquet")

    put("documents", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), documents)
    put("part", pa.schema([("p_partkey", pa.int64()), *((f"p_{n}", pa.string()) for n in ("name", "brand", "type")), ("p_size", pa.int32())]), [(*r, 1) for r in part])
    put("lineitem", pa.schema([*((f"l_{n}", pa.int64()) for n in ("orderkey", "partkey", "suppkey")), ("l_linenumber", pa.int32()),
                               *((f"l_{n}", pa.float64()) for n in ("quantity", "discount", "tax")), ("l_returnflag", pa.string())]), lineitem)


@pytest.mark.parametrize("words, per_task", [(1_000_000, 4_000_000), (0, 100)])
def test_prompts_by_key_on_odd_tables(spark, tmp_path, monkeypatch, words, per_task):
    """Items and texts listed twice, null or missing, and an item with most of the reviews."""
    from reviewlens.operators import lookup

    monkeypatch.setattr(lookup, "WORDS", words)
    monkeypatch.setattr(S, "REVIEWS_PER_TASK", per_task)
    texts = {0: None, 1: "", 2: "x" * 20, 3: "  " + "y" * 18 + "  ", 4: "é" * 500}
    documents = [(i, texts.get(i, f"text number {i} that is long enough")) for i in range(150) if i % 13 != 5] + [(7, "text number 7 that is long enough")] * 2
    part = [(i, f"item {i}", "brand", "type") for i in range(-2, 40)] + [(3, "item 3", "B", "t"), (4, "another 4", "b", "t"), (5, None, "b", "t"), (None, "no key", "b", "t")]
    lineitem = [
        (o, 1 if o % 3 else (None if o % 50 == 0 else o % 61 - 2), o % 7, o % 4, float(o % 50 + 1), (o % 11) / 100, (o % 9) / 100, "RAN"[o % 3 if o % 2 else 2])
        for o in range(16_000)
    ]
    write_tables(tmp_path, documents, part, lineitem)
    for name in ("ai_prompt", "ai_report"):
        ok, message = oracle.compare(spark, oracle.duck(str(tmp_path)), name, str(tmp_path))
        assert ok, message
    (tmp_path / "none").mkdir()
    write_tables(tmp_path / "none", [], part, lineitem)
    assert oracle.entry.queries()["ai_prompt"](spark, str(tmp_path / "none")).count() == 0


def test_keys_sent_as_bits(spark, monkeypatch):
    from pyspark.sql import functions as F
    from reviewlens.operators import lookup

    keys = [-(2**62), -65, -64, -1, 0, 63, 64, 2**62, None]
    table = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "key long, odd int")
    rows = spark.createDataFrame([(k,) for k in [*keys, 1, -2, 65, 65]], "k long")
    for words in (1_000_000, 0):
        monkeypatch.setattr(lookup, "WORDS", words)
        got = lookup.having_key(rows, F.col("k"), table, "key", F.col("odd") == 0)
        assert got.columns == ["k"]
        assert sorted(r["k"] for r in got.collect()) == [-(2**62), -64, 0, 64]
