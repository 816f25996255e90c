"""Secret scan: a keyword automaton first, anchored expressions only at its hits, then checksums inside the match.

The Aho-Corasick automaton runs once over the folded text and reports where a keyword starts. Only there is the
expression of the keyword tried, anchored. Formats that carry their own checksum are kept only when it fits.

The kind ``hex`` has no keyword. Its runs are 24 characters or longer, so every 24th position of the text is probed and
a run is measured only where the probe falls on a hexadecimal digit.

A null text is an empty one and has no span. Nulls in other columns, repeated rows, empty tables and extra columns need
no care: a row is scanned by itself and only ``doc_id`` and ``text`` are read. A text of any length is scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns and least lengths of the contract, and public token formats.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("github", "npm", "jwt", "card")
KINDS = BASE_KINDS + ADDED_KINDS
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
CARD = re.compile(r"(?i:card)[^0-9\n]{0,12}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.ASCII)
LEAST = {"assign": 6, "access": 20, "hex": 24}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "card": ("card",),
}
FOLD = {c: c + 32 for c in range(65, 91)}


def crc_fits(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before, in base 62."""
    value, out = zlib.crc32(match[1].encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out.rjust(6, "0") == match[2]


def header_fits(match: re.Match) -> bool:
    """The first part decodes to an object that names an algorithm."""
    try:
        header = json.loads(base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(header, dict) and "alg" in header


def luhn_fits(match: re.Match) -> bool:
    digits = [int(c) for c in match[1] if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


#: kind: (expression, check of a match)
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= LEAST["assign"]),
    "access": (ACCESS, lambda m: len(m[0]) >= LEAST["access"]),
    "github": (GITHUB, crc_fits),
    "npm": (NPM, crc_fits),
    "jwt": (JWT, header_fits),
    "card": (CARD, luhn_fits),
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for keyword in keywords:
            found.add_word(keyword, (kind, len(keyword)))
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """``text`` with the same length and A-Z in lower case; other letters may fold too, the expressions decide."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(FOLD)


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of 24 or more lower-case hexadecimal digits."""
    least = LEAST["hex"]
    done = 0
    for probe in re.finditer(r"[0-9a-f]", text[least - 1 :: least]):
        at = (probe.start() + 1) * least - 1
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in "0123456789abcdef":
            start -= 1
        end = HEX.match(text, at).end()
        done = end
        if end - start >= least:
            yield start, end


def scan(text: str, keywords) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed; per kind leftmost and not overlapping."""
    spans = [("hex", a, b) for a, b in hex_runs(text)]
    after = dict.fromkeys(RULES, 0)
    for last, (kind, length) in keywords.iter(folded(text)):
        start = last - length + 1
        if start < after[kind]:
            continue
        expression, fits = RULES[kind]
        match = expression.match(text, start)
        if match:
            after[kind] = match.end()
            if fits(match):
                spans.append((kind, match.start(), match.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, value) per row of ``docs``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            spans = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                spans.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in scan(text, keywords)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {doc_id}, spans array<struct<kind string, start long, end long, value string>>"
    )


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()
