from __future__ import annotations

import random

import numpy as np
import pytest

from reviewlens.operators import enrich as E
from reviewlens.operators import near_titles as N
from reviewlens import schemas


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def allowed(n):
    return 3 if n >= 32 else 2 if n >= 16 else 1 if n >= 8 else 0


def plain(left, right):
    return {(a, b, d) for a in set(left) for b in set(right) if a is not None and b is not None and a != b and abs(len(a) - len(b)) <= 3
            for d in [distance(a, b)] if d <= allowed(max(len(a), len(b)))}


def changed(rng, text, letters):
    for _ in range(rng.randint(0, 4)):
        k = rng.randint(0, len(text))
        text = rng.choice([text[:k] + rng.choice(letters) + text[k:], text[:k] + text[k + 1 :], text[:k] + rng.choice(letters) + text[k + 1 :]])
    return text


@pytest.mark.parametrize("seed,letters,longest", [(1, "abcdefghij", 45), (2, "ab", 18), (3, "aé中 ", 34)])
def test_near_titles_equal_all_pairs(spark, seed, letters, longest):
    rng = random.Random(seed)
    right = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(90)] + ["a" * 30, "a" * 33, "", None]
    left = [changed(rng, t, letters) for t in right if t is not None] + ["a" * 31, None, right[0]]
    found = N.near_titles(spark.createDataFrame([(t,) for t in left], "t string"), spark.createDataFrame([(t, 1) for t in right], "t string, x int"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(left, right)


def test_work_grows_little_faster_than_the_titles(spark):
    """Words as titles use them: a few in most of them, most in a few, and new ones as titles are added."""
    draws = [list(dict.fromkeys(row))[:4] for row in np.exp(np.random.default_rng(5).uniform(0, np.log(20_000), (4000, 8))).astype(int).tolist()]

    def word(k):
        rng = random.Random(int(k))
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))

    def met(n):
        titles = {" ".join(map(word, row)) for row in draws[:n]}
        side = spark.createDataFrame([(t,) for t in titles], "text string")
        return N.candidates(side, side).count() + len(titles)

    assert met(4000) <= 4**1.3 * met(1000)


CATALOG = [("k1", "Silent River Crossing", ["Ann Lee"], ["House"], ["May 1999"], ["s"], 1999), ("k2", "Golden Apple", ["B"], ["H"], [], [], 2001),
           ("k3", "Silent River Crossing", ["Zoe Zed"], ["Other"], ["2004"], ["s"], 2004)]
BOOKS = [(1, "silemt river crossing", "ann lee", None, "c", 1990), (2, "Goldem Apple", None, None, None, None), (3, "nothing like it at all", None, None, None, None),
         (4, "silent river crossing", "ann lee", None, None, None), (5, None, None, None, None, None), (6, "xilent river crossing", "zoe zed", None, None, None)]


def test_a_typo_in_the_first_word_is_found(spark):
    books, catalog = spark.createDataFrame(BOOKS, schemas.BOOKS), spark.createDataFrame(CATALOG, schemas.CATALOG)
    assert {r["strategy"] for r in E.enrich_missing(books, catalog).collect() if r["book_id"] in (1, 2, 6)} == {None}
    got = {r["book_id"]: r for r in E.enrich_missing(books, catalog, near=True).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert (got[1]["strategy"], got[1]["pub_year"], got[1]["n_found"]) == (E.NEAR_STRATEGY, 1999, 2)
    assert (got[2]["strategy"], got[2]["pub_year"]) == (E.NEAR_STRATEGY, 2001)
    assert (got[6]["strategy"], got[6]["pub_year"]) == (E.NEAR_STRATEGY, 1999)  # the first certain hit wins, as in every strategy
    assert got[4]["strategy"] == "titulo_autor" and got[3]["strategy"] is None and got[5]["strategy"] is None


def test_titles_that_share_their_words_meet_by_what_differs(spark):
    """A few names with many numbers: runs of the names are common to all titles, so they must not decide who meets."""
    rng, names = random.Random(3), [f"{a} {b}" for a in ("large", "small", "cold", "red") for b in ("anvil", "plate", "ring", "bolt")]
    side = spark.createDataFrame([(f"{rng.choice(names)} {k}",) for k in range(10_000, 18_000)], "text string")
    assert N.candidates(side, side).count() <= 400 * 8_000
