"""Text standardisation as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Words ignored when a title is turned into a search key.
SEARCH_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]

# Publication bands, newest first, as (first year, label); and the label of anything older.
PERIOD_BANDS = [
    (2020, "2020+"),
    (2015, "2015-2019"),
    (2010, "2010-2014"),
    (2005, "2005-2009"),
    (2000, "2000-2004"),
    (1990, "1990-1999"),
]
PERIOD_OLDEST = "Antes de 1990"
RECENCY_BANDS = [(2015, "Recente (2015+)"), (2000, "Médio (2000-2014)")]
RECENCY_OLDEST = "Antigo (antes 2000)"

_SINGLE = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ITEM = f"(?:{_SINGLE}|{_DOUBLE})"
_LIST = rf"(?s)^[ \t]*\[\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*+,?\s*)?\]\s*$"
_ATOM = rf"(?:{_ITEM}|[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|None|True|False)"
_PAIR = rf"{_ATOM}\s*(?::\s*{_ATOM}\s*)?"
_OTHER = rf"(?s)^[ \t]*(?:\(\s*(?:{_PAIR}(?:,\s*{_PAIR})*+,?\s*)?\)|\{{\s*(?:{_PAIR}(?:,\s*{_PAIR})*+,?\s*)?\}})\s*$"
# Single-character escapes of a string literal (a backslash before a line end joins the lines), and the
# characters that count as blank.
_ESCAPES = {
    "\\n": "\n", "\\t": "\t", "\\r": "\r", "\\\\": "\\", "\\'": "'", '\\"': '"', "\\a": "\a", "\\b": "\b", "\\f": "\f", "\\v": "\v",
    "\\0": "\0", "\\\n": "",
}
_BLANK = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SCALAR = rf"(?s)^[ \t]*(?:{_ITEM}|[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|None|True|False)\s*$"


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_form(c: Column) -> Column:
    """Lower case, ASCII letters, digits and single spaces only; NULL when nothing is left."""
    kept = F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")
    return F.nullif(F.trim(F.regexp_replace(kept, " +", " ")), F.lit(""))


def _decoded(body: Column) -> Column:
    """The text that the inside of a quoted literal stands for; escapes are read once, from left to right."""
    pieces = F.regexp_extract_all(
        body, F.lit(r"(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]+"), F.lit(0)
    )
    plain = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])

    def read(p: Column) -> Column:
        code = F.when(p.startswith("\\x"), F.concat(F.lit("00"), F.substring(p, 3, 2))).when(p.startswith("\\u"), F.substring(p, 3, 4))
        spelled = F.when(F.length(p) > 2, F.decode(F.unhex(code), "UTF-16BE"))
        return F.when(p.startswith("\\"), F.coalesce(spelled, F.element_at(plain, p), p)).otherwise(p)

    return F.when(F.instr(body, "\\") > 0, F.array_join(F.transform(pieces, read), "")).otherwise(body)


def names_from_list_literal(c: Column) -> Column:
    """``"['B', 'a ']"`` -> ``"a, b"``: lower case, trimmed, distinct, sorted.

    A quoted, numeric or keyword scalar, and a flat tuple, set or dictionary, is returned lower-cased as written; anything
    that is not a literal, or a list holding something other than strings, gives NULL.
    """
    quoted = F.regexp_extract_all(c, F.lit(f"(?s){_ITEM}"), F.lit(0))

    def unquote(item: Column) -> Column:
        body = _decoded(F.substring(item, F.lit(2), F.length(item) - 2))
        return F.regexp_replace(F.lower(body), f"^[{_BLANK}]+|[{_BLANK}]+$", "")

    names = F.array_sort(F.array_distinct(F.filter(F.transform(quoted, unquote), lambda x: x != "")))
    return (
        F.when(c.rlike(_LIST), F.nullif(F.array_join(names, ", "), F.lit("")))
        .when(c.rlike(_SCALAR) | c.rlike(_OTHER), F.nullif(strip_space(F.lower(c)), F.lit("")))
    )


def parse_partial_date(c: Column) -> Column:
    """DATE from ``yyyy-MM-dd``, ``yyyy-MM`` or ``yyyy``; NULL for anything else."""
    text = F.trim(c)
    full = (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
        .when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01")))
        .when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
    )
    return full.try_cast("date")


def publication_year(c: Column) -> Column:
    return F.year(parse_partial_date(c))


def year_in_text(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).cast("int")


def pair_key(title: Column, authors: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("_"), F.coalesce(authors, F.lit("")))


def _without_punctuation(c: Column) -> Column:
    words = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def search_title(c: Column) -> Column:
    """Up to five significant words of a title; '' for NULL."""
    words = F.split(_without_punctuation(F.coalesce(c, F.lit(""))), " ")
    stop = F.array(*[F.lit(w) for w in SEARCH_STOP_WORDS])
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.array_join(F.slice(kept, 1, 5), " ")


def search_author(c: Column) -> Column:
    """First author of a comma list without punctuation; NULL when two characters or fewer remain."""
    name = _without_punctuation(F.substring_index(c, ",", 1))
    return F.when(F.length(name) > 2, name)


def first_category(c: Column, trim: bool = True) -> Column:
    head = F.substring_index(c, ",", 1)
    return F.trim(head) if trim else head


def preview(c: Column, size: int, ellipsis: bool = False) -> Column:
    head = F.substring(c, 1, size)
    return F.concat(head, F.lit("...")) if ellipsis else head


def _band(year: Column, bands: list[tuple[int, str]], oldest: str) -> Column:
    return reduce(
        lambda chain, band: chain.when(year >= band[0], F.lit(band[1])),
        bands[1:],
        F.when(year >= bands[0][0], F.lit(bands[0][1])),
    ).otherwise(F.lit(oldest))


def period_band(year: Column) -> Column:
    return _band(year, PERIOD_BANDS, PERIOD_OLDEST)


def recency_band(year: Column) -> Column:
    return _band(year, RECENCY_BANDS, RECENCY_OLDEST)


def band_rank(label: Column, bands: list[tuple[int, str]], oldest: str) -> Column:
    """Chronological position of a band label, oldest = 1."""
    ordered = [oldest] + [name for _, name in reversed(bands)]
    return F.array_position(F.array(*[F.lit(n) for n in ordered]), label)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def null_cells(columns: list[str]) -> Column:
    """Number of NULL cells of the row."""
    return reduce(lambda a, b: a + b, [F.isnull(F.col(c)).cast("int") for c in columns])
