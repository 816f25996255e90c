from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import enrich as E
from reviewlens.operators import profile as P
from reviewlens import schemas

HIT = "book_id long, strategy_rank int, strategy string, position int, n_found int, key string, similarity double, authors_std string, publisher_std string, categories_std string, pub_year int"


def hit(book, rank, position, similarity):
    key = f"{rank}-{position}"
    return (book, rank, f"s{rank}", position, 20, key, similarity, f"a{key}", None, None, None)


def walk(hits):
    """The lookup as a walk over strategies and result pages."""
    best, winner = 0.0, None
    for rank in sorted({h[1] for h in hits}):
        for h in sorted((h for h in hits if h[1] == rank), key=lambda h: h[3]):
            if h[6] > best and h[6] > 0.6:
                best, winner = h[6], h[5]
                if best > 0.9:
                    return winner
        if best > 0.8:
            break
    return winner


def test_best_match_equals_walk(spark):
    rng = random.Random(4)
    levels = [0.2, 0.6, 0.61, 0.7, 0.8, 0.81, 0.85, 0.9, 0.91, 0.95, 1.2]
    rows = []
    for book in range(300):
        for rank in range(1, 5):
            for position in range(1, rng.randint(1, 5)):
                rows.append(hit(book, rank, position, rng.choice(levels if book % 2 else levels[:7])))
    got = {r["book_id"]: r["catalog_key"] for r in E.best_matches(spark.createDataFrame(rows, HIT)).collect()}
    want = {b: walk([h for h in rows if h[0] == b]) for b in {h[0] for h in rows}}
    assert got == {b: k for b, k in want.items() if k is not None}


CATALOG = [
    ("k1", "Silent River", ["Ann Lee"], ["House A", "House B"], ["May 1999"], ["s1", "s2", "s3", "s4", "s5", "s6"], None),
    ("k2", "Silent River", ["Bob Ray", "C", "D", "E"], ["House C"], ["n.d."], [], 2001),
    ("k3", "River, Silent", ["Ann Lee"], [], [], ["s"], 0),
    ("k4", "Completely Different Thing", ["Zed"], ["H"], ["1950"], ["x"], 1950),
    ("k5", "Golden Apple Trees of the Northern Valley", None, ["H"], None, None, 1970),
]
BOOKS = [
    (1, "silent river", "ann lee", None, "c", 1990),
    (2, "silent river", "bob ray", "", "c", 1990),
    (3, "golden apple trees", None, "p", "c", 1990),
    (4, "no such title", "nobody", None, None, None),
    (5, None, "x", None, None, None),
    (6, "complete", "row", "p", "c", 1990),
    (7, "silent river", "ann lee", "p", None, None),
]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(BOOKS, schemas.BOOKS), spark.createDataFrame(CATALOG, schemas.CATALOG)


def test_missing_records(frames):
    assert sorted(r["book_id"] for r in E.missing_records(frames[0]).collect()) == [1, 2, 3, 4, 5, 7]


def test_extracted_fields(frames):
    got = {r["key"]: tuple(r)[1:] for r in E.extract_fields(frames[1]).collect()}
    assert got["k1"] == ("Ann Lee", "House A", "s1, s2, s3, s4, s5", 1999)
    assert got["k2"] == ("Bob Ray, C, D", "House C", None, 2001)
    assert got["k3"] == ("Ann Lee", None, "s", None)
    assert got["k5"] == (None, "H", None, 1970)


def test_metadata_and_author_bonus(frames):
    got = {r["book_id"]: r for r in E.enrich_missing(*frames).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 7]
    assert (got[1]["strategy"], got[1]["similarity"], got[1]["n_found"]) == ("titulo_autor", 1.2, 1)
    assert got[1]["pub_year"] == got[7]["pub_year"] == 1999
    assert (got[2]["authors_std"], got[2]["pub_year"]) == ("Bob Ray, C, D", 2001)
    expected = SequenceMatcher(None, "golden apple trees", "golden apple trees of the northern valley").ratio()
    assert got[3]["strategy"] == ("palavras_chave" if expected > 0.6 else None)
    assert (got[4]["strategy"], got[4]["similarity"], got[4]["n_found"]) == (None, 0.0, 0)
    assert got[5]["strategy"] is None


def test_a_search_sees_every_row_of_its_key(spark):
    rows = [(f"k{i:03d}", "Same Title" if i == 29 else "Title Same", ["A"], ["H"], ["1999"], ["s"], 1999) for i in range(30)]
    books = spark.createDataFrame([(1, "same title", "zz", None, None, None)], schemas.BOOKS)
    found = E.find_metadata(books, spark.createDataFrame(rows, schemas.CATALOG)).first()
    assert found["similarity"] == 1.0


def test_number_of_hits(spark):
    catalog = spark.createDataFrame([(f"k{i:03d}", "Same Title", ["A"], ["H"], ["1999"], ["s"], 1999) for i in range(50)], schemas.CATALOG)
    books = spark.createDataFrame([(i, "same title", f"zz {i}", None, None, None) for i in range(40)], schemas.BOOKS)
    found = E.find_metadata(books, catalog).collect()
    assert len(found) == 40 and {r["n_found"] for r in found} == {50}
    single = E.find_metadata(books, catalog, multiple=False).collect()
    assert {r["strategy"] for r in single} == {"padrao"}


def test_found_values_replace_or_only_fill(frames, spark):
    books = frames[0]
    found = spark.createDataFrame([(1, "new", "house", None, 2005), (99, "x", "y", "z", 1)], "book_id long, authors_std string, publisher_std string, categories_std string, pub_year int")
    over = {r["book_id"]: r for r in E.apply_enrichment(books, found).collect()}
    assert tuple(over[1])[2:] == ("new", "house", "c", 2005)
    fill = {r["book_id"]: r for r in E.apply_enrichment(books, found, fill_only=True).collect()}
    assert tuple(fill[1])[2:] == ("ann lee", "house", "c", 1990)
    assert len(over) == len(BOOKS)


def test_limit_and_summary(frames):
    found = E.enrich_missing(*frames, limit=2)
    assert sorted(r["book_id"] for r in found.collect()) == [1, 2]
    row = E.enrichment_summary(E.enrich_missing(*frames)).first()
    assert row["processed"] == 6 and row["succeeded"] >= 3
    assert row["success_pct"] == pytest.approx(100 * row["succeeded"] / 6)


def test_similarity_measures(spark):
    pairs = [("abcd", "bcde"), ("Same", "sAME"), ("", "x"), (None, "x"), ("a b c", "c b a"), ("x" * 250, "x" * 249 + "y")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in frame.select("i", E.similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    want = [SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0 for a, b in pairs]
    assert got == want
    edit = [r["s"] for r in frame.select("i", E.similarity(F.col("a"), F.col("b"), "edit").alias("s")).orderBy("i").collect()]
    assert edit[:4] == [0.5, 1.0, 0.0, 0.0]


def test_comparison_of_gaps(frames, spark):
    books = frames[0]
    after = E.apply_enrichment(books, E.enrich_missing(*frames))
    got = {r["column"]: (r["before"], r["after"], r["success_pct"]) for r in P.compare_missing(books, after, E.FIELDS + ["book_id"]).collect()}
    assert got["book_id"] == (0, 0, 0.0)
    assert got["total"][0] == sum(v[0] for k, v in got.items() if k != "total")
    filled = P.first_filled(books, after, "pub_year").collect()
    assert [r["book_id"] for r in filled] == [7]
    assert P.filled_summary(books, after, "pub_year").first()["median"] == 1999.0


def test_a_second_run_goes_on_where_the_first_stopped(frames, spark, tmp_path, monkeypatch):
    books, catalog = frames
    path = str(tmp_path / "run")
    searched = []
    monkeypatch.setattr(E, "_written", lambda df, p, write=E._written: (_ for _ in ()).throw(RuntimeError) if p.endswith("piece=2") and not searched else write(df, p))
    with pytest.raises(RuntimeError):
        E.enrich_to_stage(books, catalog, path, pieces=4)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("part-*")}
    searched.append(1)
    found = E.enrich_to_stage(books, catalog, path, pieces=4)
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("part-*")}
    assert before and all(after[name] == at for name, at in before.items())  # the index and the pieces that were done
    rows = lambda df: sorted(map(str, df.select("book_id", *E.FIELDS, "strategy", "similarity", "n_found").collect()))
    assert rows(found) == rows(E.enrich_missing(books, catalog))
