from __future__ import annotations

import ast
import datetime

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import text as T
from reviewlens.operators.standardise import most_frequent_spelling


def apply(spark, fn, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in frame.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normal_form(spark):
    values = [None, "", "  ", "Café\tDel  Mar!", "!!!", "A  b\nC-3", "The 39 Steps"]
    assert apply(spark, T.normal_form, values) == [None, None, None, "cafdel mar", None, "a bc3", "the 39 steps"]


LITERALS = ["['Ann Lee', \"Dan O'Brien\"]", "['b', 'A', 'a ', 'B']", "[]", "['']", "['  ', 'x']", "'Quoted Name'", "123", "4.5", "None",
            "Jane Doe", "['a', 1]", "['it\\'s', 'tab\\there']", "['a', 'b',]", "[ 'a' ,\n 'b' ]", "['unclosed", None, "", "   ", "[\"a, b\", 'c']",
            "['A'] trailing", "['back\\\\slash']"]


def literal_rule(v):
    if v is None or not v.strip():
        return None
    try:
        parsed = ast.literal_eval(v)
    except Exception:
        return None
    if isinstance(parsed, list):
        try:
            names = {x.lower().strip() for x in parsed if x.strip()}
        except AttributeError:
            return None
        return ", ".join(sorted(names)) or None
    return v.lower().strip() or None


def test_list_literals_follow_the_literal_rules(spark):
    got = apply(spark, T.names_from_list_literal, LITERALS)
    assert dict(zip(LITERALS, got)) == {v: literal_rule(v) for v in LITERALS}


def test_dates(spark):
    values = ["1999", "2004-05", "2001-02-03", "2001-13", "2001-02-30", "May 1999", "", None, "99"]
    assert apply(spark, T.publication_year, values) == [1999, 2004, 2001, None, None, None, None, None, None]
    assert apply(spark, T.parse_partial_date, ["2004-05"]) == [datetime.date(2004, 5, 1)]
    assert apply(spark, T.year_in_text, ["May 1999, 2003", "n.d.", None, "12345"]) == [1999, None, None, 1234]


def test_search_keys(spark):
    titles = ["The Lord of the Rings: The Two Towers & More Words Here", None, "A an of", "Été à la mer", "it-is an Ox"]
    assert apply(spark, T.search_title, titles) == ["lord rings two towers more", "", "", "été mer", "itis"]
    authors = ["Jane  Doe, John Roe", "J.", None, " ", "O'Neil", "a, b"]
    assert apply(spark, T.search_author, authors) == ["jane doe", None, None, None, "oneil", None]


def test_categories_and_previews(spark):
    assert apply(spark, T.first_category, [" a , b", "solo", "", None, ",x"]) == ["a", "solo", "", None, ""]
    assert apply(spark, lambda c: T.first_category(c, trim=False), [" a , b"]) == [" a "]
    assert apply(spark, lambda c: T.preview(c, 3, ellipsis=True), ["abcdef", "ab", None]) == ["abc...", "ab...", None]


@pytest.mark.parametrize("year,period,recency,decade", [
    (2025, "2020+", "Recente (2015+)", 2020), (2020, "2020+", "Recente (2015+)", 2020), (2019, "2015-2019", "Recente (2015+)", 2010),
    (2014, "2010-2014", "Médio (2000-2014)", 2010), (2005, "2005-2009", "Médio (2000-2014)", 2000), (2000, "2000-2004", "Médio (2000-2014)", 2000),
    (1999, "1990-1999", "Antigo (antes 2000)", 1990), (1989, "Antes de 1990", "Antigo (antes 2000)", 1980)])
def test_bands(spark, year, period, recency, decade):
    y = F.lit(year)
    row = spark.range(1).select(T.period_band(y), T.recency_band(y), T.decade(y)).first()
    assert tuple(row) == (period, recency, decade)


def test_most_frequent_spelling(spark):
    rows = [(1, "n", "B"), (2, "n", "B"), (3, "n", "A"), (4, "m", "y"), (5, "m", "x"), (6, None, "z"), (7, None, None)]
    frame = spark.createDataFrame(rows, "id int, norm string, orig string")
    got = {r["id"]: r["std"] for r in most_frequent_spelling(frame, "norm", "orig", "std").collect()}
    assert got == {1: "B", 2: "B", 3: "B", 4: "x", 5: "x", 6: None, 7: None}


def test_random_list_literals(spark):
    import random

    random.seed(11)
    letters = ["a", "B", " ", "\xa0", "\\", "'", '"', "\n", "\t", "\r", "’", "é", "\x07", ",", "　"]
    lists = [["".join(random.choice(letters) for _ in range(random.randint(0, 8))) for _ in range(random.randint(0, 4))] for _ in range(200)]
    values = [repr(v) for v in lists] + [ascii(v) for v in lists[:100]]
    got = apply(spark, T.names_from_list_literal, values)
    want = [literal_rule(v) for v in values]
    assert [(v, g, w) for v, g, w in zip(values, got, want) if g != w] == []


def test_other_literals_keep_their_text(spark):
    values = ["('A', 'b')", "{'Name': 'X', 'n': 1}", "{'A'}", "()", "('A' 'b'", "(A, b)", "['Jo\\xa0Ann']", "['a\\\\n b']"]
    assert apply(spark, T.names_from_list_literal, values) == [
        "('a', 'b')", "{'name': 'x', 'n': 1}", "{'a'}", "()", None, None, "jo\xa0ann", "a\\n b"]
