"""Benchmark decontamination by templates: numbers, names and units become typed placeholders before texts are compared.

A document repeats a benchmark item when it holds the item's windows of canonical words in the same places relative to
each other, and when the values behind the placeholders go together: wherever the item repeats a number or a name, so does
the document. So a question with other numbers is caught, a text of the same shape whose
values contradict the item's is not.

Every capitalised word is a name, at the start of a sentence too, so a word's slot never depends on what stands before the
item. Windows with names are filed a second time with the words themselves, case folded, for copies in other case. Words
that the item has capitalised at the start of sentences only may be no names: their values need not go together.

Names that stand side by side, and the words of a spelled-out number, are one slot. The windows of an item at one distance
from its own places are a stretch; stretches whose distances differ by a few words and that follow in order are
joined, so a word more or less does not hide a copy.

Windows are found by a hash join. Before it, each task drops windows whose hash is not in a bitmap of the items' hashes;
the bitmap has a fixed size, and lets no true window be lost. The items' side is broadcast only after its windows have
been counted; beyond the bound the join shuffles both sides.

Nulls and ties: a null text, of a document or an item, has no word and matches nothing. Rows without doc_id are kept and
reported as null; documents that tie on the id are reported together; items that tie on item_id count as one item per text.
An item shorter than a window is one window of its own length. Windows of numbers and units for the most part are compared
with their values, so only verbatim copies of them are found; an item of one or two words with a number in it matches nothing. Empty tables give empty results. Texts of any length are
read whole. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewlens.llm.common import bound_batches, trimmed

WINDOW = 8  # canonical words
SHARE = 0.6  # of an item's words that a document must hold, in place
PLAIN_WORDS = 3  # a window with fewer words besides placeholders is compared with its values; one with fewer words at all says nothing
DRIFT = 8  # words by which the distances of joined stretches differ, or a quarter of the item's words when that is more
BITMAP_BITS = 24  # 2 MB
BROADCAST_WINDOWS = 200_000
# Units of measure, money and time.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces ton tons ml l liter "
    "liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years percent % $ € £ dollar dollars cent cents euro euros pound pounds mph kmh degree degrees watt watts".split()
)
NUMBERS = {w: n for n, w in enumerate(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBERS |= {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
NUMBERS |= {"hundred": 100, "thousand": 1000, "million": 1_000_000, "half": None}
NUMERIC = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
PUNCTUATION = ".,;:!?\"'()[]"
STRIP = ".,;:!?\"'()[]{}<>|#*&%$+=~`_-–—…«»“”‘’"
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
SEED = 9
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CACHE = 1 << 18  # raw words a worker remembers


#: Properties of a word as bits: kind in the lowest two, starts with a capital, ends a sentence, no sign before it, none
#: after it, spelled-out number.
KIND, CAPITAL, ENDS, OPENS, CLOSES, SPELLED = 3, 4, 8, 16, 32, 64
PLAIN = OPENS | CLOSES


class Lexicon(dict):
    """Raw word to the number of its properties; a word is looked at once. Signs alone get negative numbers below -1.

    A worker process keeps its lexicon from task to task.
    """

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[tuple[int, int]] = []  # properties that are not in the table yet
        self.size = 0
        self.hashes, self.flags = np.zeros(1024, "<u8"), np.zeros(1024, np.uint8)

    def __missing__(self, raw: str) -> int:
        found = look(raw)
        if found is None:
            row = -2 - sign_hash(raw)
        else:
            row = self.size + len(self.fresh)
            self.fresh.append(found)
        self[raw] = row
        return row

    def __reduce__(self):
        return Lexicon, ()  # a worker starts with an empty one

    def properties(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, flags)."""
        if self.fresh:
            end = self.size + len(self.fresh)
            while len(self.hashes) < end:  # by doubling: a copy now and then, not one per text
                self.hashes, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.flags))
            self.hashes[self.size : end] = [h for h, _ in self.fresh]
            self.flags[self.size : end] = [f for _, f in self.fresh]
            self.size, self.fresh = end, []
        return self.hashes[ids], self.flags[ids]


def look(raw: str) -> tuple[int, int] | None:
    """(hash, properties) of a raw word; None for one of signs alone.

    Kind is 1 for a number, 2 for what would be a unit, otherwise 0.
    """
    last = raw[-1]
    word = raw[:-1] if last in ".,;:!?" else raw
    if word.isalpha():  # most words: letters, and at most one sign after them
        low = word.lower()
        if low not in UNITS and low not in NUMBERS:
            flags = PLAIN if word is raw else OPENS | ENDS if last in ".!?" else OPENS
            return xxhash.xxh64_intdigest(low, SEED), flags | CAPITAL if word[0].isupper() and not word.isupper() else flags
    word = raw.strip(STRIP)
    low = word.lower()
    flags = ENDS if raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?") else 0
    flags |= (OPENS if raw[0].isalnum() else 0) | (CLOSES if raw[-1].isalnum() else 0)
    spelled = bool(low) and all(part in NUMBERS for part in low.split("-"))
    if spelled or not word.isalpha() and NUMERIC.fullmatch(raw.strip(PUNCTUATION)):
        return xxhash.xxh64_intdigest(NUMBER, SEED), flags | 1 | (SPELLED if spelled else 0)
    if not word and raw not in UNITS:
        return None
    if not word or low in UNITS:
        return xxhash.xxh64_intdigest(low or raw, SEED), flags | 2
    return xxhash.xxh64_intdigest(low, SEED), flags | (CAPITAL if word[:1].isupper() and not word.isupper() else 0)


def number_value(words: list[str]) -> str:
    """Digits of a number of spelled-out words, possibly after one in digits; the words as they are when they make none."""
    total = current = 0
    for k, part in enumerate(p for w in words for p in w.split("-")):
        value = NUMBERS.get(part)
        if value is None:
            if k or not part.isdigit() or len(words) == 1:
                return " ".join(words)
            current = int(part)
        elif value >= 1000:
            total, current = total + max(current, 1) * value, 0
        elif value == 100 and current < 100:
            current = max(current, 1) * 100
        elif k and (value == 0 or current % (10 if value < 10 else 100) or value < 10 and current % 100 == 10):
            return " ".join(words)
        else:
            current += value
    return str(total + current)


def sign_hash(raw: str) -> int:
    """62 bits of signs that stand alone; 0 for punctuation."""
    signs = raw.strip(PUNCTUATION)
    return xxhash.xxh64_intdigest(signs, SEED) >> 2 if signs else 0


class Words(NamedTuple):
    """Canonical words: hashes with names as they are, raw words, slots (0 none, 1 number, 2 unit, 3 name), kinds as of
    ``look``, which begin no sentence, and which share the slot of the word before, and hashes of the
    signs between a word and the one before. A unit is one only after a number."""

    hashes: np.ndarray
    raws: list[str]
    slot: np.ndarray
    kind: np.ndarray
    inside: np.ndarray
    joined: np.ndarray
    signs: np.ndarray


def canonical(text: str, lexicon: Lexicon) -> Words:
    raws = text.split()
    ids = np.fromiter(map(lexicon.__getitem__, raws), np.int64, len(raws))
    apart, signs = np.zeros(len(ids), bool), np.zeros(len(ids), "<u8")  # signs stand before the word
    if len(ids) and ids.min() < 0:
        raws = [r for r, k in zip(raws, ids.tolist()) if k >= 0]
        places = np.flatnonzero(ids >= 0)
        apart = np.diff(places, prepend=-1) > 1
        signs = np.zeros(len(places), "<u8")
        lone = np.flatnonzero(ids < -2)
        after = np.searchsorted(places, lone)
        for k, sign in zip(after.tolist(), (-2 - ids[lone]).tolist()):
            if k < len(places):
                signs[k] = (int(signs[k]) * 31 + sign) & 0xFFFFFFFFFFFFFFFF
        ids = ids[places]
    if not len(ids):
        return Words(np.zeros(0, "<u8"), [], np.zeros(0, np.int8), np.zeros(0, np.int8), *[np.zeros(0, bool)] * 2, np.zeros(0, "<u8"))
    hashes, flags = lexicon.properties(ids)
    kind = flags & KIND
    inside, after_number = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    inside[1:] = flags[:-1] & ENDS == 0
    after_number[1:] = kind[:-1] == 1
    slot = np.where(kind == 1, 1, np.where((kind == 2) & after_number, 2, np.where(flags & CAPITAL, 3, 0))).astype(np.int8)
    hashes[slot == 2] = placeholder(UNIT)
    joined = (slot == 3) | (flags & SPELLED != 0)
    joined[0] = False
    joined[1:] &= (slot[1:] == slot[:-1]) & (flags[:-1] & CLOSES != 0) & (flags[1:] & OPENS != 0) & ~apart[1:]
    return Words(hashes, raws, slot, kind, inside, joined, signs)


def placeholder(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name, SEED))


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` canonical words; ``first`` has the hashes of words that begin a window."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, "<u8")
    out = np.zeros(n, "<u8")
    for k in range(size):
        out ^= (hashes if k else first)[k : k + n]
        out *= MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def _running(flags: np.ndarray, size: int) -> np.ndarray:
    """How many of every ``size`` neighbours are set."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[size:] - total[:-size]


def _joined(words: Words, named: bool) -> np.ndarray:
    return words.joined if named else words.joined & (words.slot == 1)


def windows(words: Words, size: int, named: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word, last word of the first slot, word after the last) of the windows that count.

    With placeholders for names (``named``) joined words are one; else the names themselves count, each on its own, and only
    windows that hold a name or too few plain words are listed; the latter with all values and the signs between them. What counts depends on the words of the window alone: one that begins with a
    unit may follow a number or not, so that unit is always a placeholder.
    """
    n = len(words.raws)
    start = np.flatnonzero(~_joined(words, named))
    if len(start) < size:
        return np.zeros(0, "<u8"), *[np.zeros(0, np.int64)] * 3
    end = np.append(start[1:], n)
    hashes, slot, loose = words.hashes[start], words.slot[start], words.kind[start] == 2
    if named:
        hashes = np.where(slot == 3, placeholder(NAME), hashes)
        plain = slot == 0
    else:
        plain = (slot == 0) | (slot == 3)
    out = window_hashes(hashes, np.where(loose, placeholder(UNIT), hashes), size)
    kept = _running(plain, size) - (plain & loose)[: len(out)] >= min(PLAIN_WORDS, size)
    if not named:
        poor = ~kept
        if size >= PLAIN_WORDS and poor.any():
            first = literals(words, start, end)
            out = np.where(poor, window_hashes(first ^ words.signs[start], first, size), out)
            kept |= poor
        kept &= poor | (_running(slot == 3, size) > 0)
    at = np.flatnonzero(kept)
    return out[at], start[at], end[at] - 1, end[at + size - 1]


def literals(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words with their values; a number keeps its signs, one of several words is its digits."""
    out = words.hashes[start]
    for k in np.flatnonzero((words.slot[start] == 1) | (words.slot[start] == 2)).tolist():
        parts = [words.raws[i].strip(PUNCTUATION).lower() for i in range(start[k], end[k])]
        out[k] = xxhash.xxh64_intdigest("=" + number_value(parts), SEED)
    for k in np.flatnonzero((words.kind[start] == 2) & (words.slot[start] != 2)).tolist():
        out[k] = xxhash.xxh64_intdigest("=" + words.raws[start[k]].strip(PUNCTUATION).lower(), SEED)
    return out


def _values(words: Words, a: int, b: int, named: bool, names: set[str] | None = None) -> str:
    """Values behind the placeholders of a window: kind, value.

    For an item, with its ``names``, also the key whose value must be the same throughout (empty when it need not be), and
    whether the slot is at the beginning or the end of the item, where a document's slot may take in more words.
    """
    out, k = [], a
    while k < b:
        slot = 2 if k == a and words.kind[k] == 2 else words.slot[k]
        end = k + 1
        while end < b and words.joined[end] and (named or slot == 1):
            end += 1
        if slot and (named or slot != 3):
            parts = [words.raws[i].strip(STRIP).lower() for i in range(k, end)]
            value = number_value(parts) if slot == 1 else " ".join(parts)
            line = f"{slot}\t{value}"
            if names is not None:
                key = value if slot == 1 else " ".join(p for p in parts if p in names) if slot == 3 else ""
                line += f"\t{key}\t{'<' * (k == 0)}{'>' * (end == len(words.raws))}"
            out.append(line)
        k = end
    return "\n".join(out)


WINDOWS = "hash long, place long, slots string"  # place: last word of the first slot


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, variant, n_words, width, low, high, hash, place, slots): all windows of the items, from word ``low`` to
    before ``high``; variant tells texts of one id apart."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            rows = []
            for item, variant, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "variant", "text"))):
                words = canonical(text or "", lexicon)
                n = len(words.raws)
                names = {words.raws[k].strip(STRIP).lower() for k in np.flatnonzero((words.slot == 3) & words.inside).tolist()}
                for named in (True, False) if n else ():
                    width = min(size, int((~_joined(words, named)).sum()))
                    hashes, *ranges = windows(words, width, named)
                    for h, a, k, b in zip(hashes.view("<i8").tolist(), *(r.tolist() for r in ranges)):
                        rows.append((item, variant, n, width, a, b, h, k, _values(words, a, b, named, names)))
            types = [batch.schema.field("item_id").type, *[pa.int64()] * 7, pa.string()]
            columns = list(zip(*rows)) or [()] * len(types)
            names = ["item_id", "variant", "n_words", "width", "low", "high", "hash", "place", "slots"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = benchmark.select("item_id", F.xxhash64("text").alias("variant"), "text").dropDuplicates(["item_id", "variant"])
    return rows.mapInArrow(work, f"item_id {kind}, variant long, n_words long, width long, low long, high long, {WINDOWS}")


def bitmap(windows: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bits set at the low bits of all window hashes. The driver gets words of 64 bits, at most 2^bits / 64 of them."""
    words = windows.groupBy(F.expr(f"shiftright(hash & {(1 << bits) - 1}L, 6)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(hash & 63L AS int)))").alias("set"))
    out = np.zeros((1 << bits) // 64, "<i8")
    for row in words.toLocalIterator():
        out[row.word] = row.set
    return out.view("<u8")


def document_windows(docs: DataFrame, marks: np.ndarray, widths: list[tuple[int, bool]]) -> DataFrame:
    """(doc_id, hash, place, slots): the windows of ``docs`` that the bitmap lets through; slots are the values behind placeholders."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((marks, Lexicon()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lexicon = shared.value  # as long as the worker process, with the words it has met
        mask = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            at, found, places, slots = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                words = canonical(text.as_py() or "", lexicon)
                for width, named in widths:
                    own, *ranges = windows(words, width, named)
                    low = own & mask
                    hits = np.flatnonzero(bits[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1))
                    for a, k, b in zip(*(r[hits].tolist() for r in ranges)):
                        at.append(i)
                        places.append(k)
                        slots.append(_values(words, a, b, named))
                    found.append(own[hits])
                if len(lexicon) > CACHE:
                    lexicon.forget()
            values = np.concatenate(found) if found else np.zeros(0, "<u8")
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), batch.column("_text").take(pa.array(at, pa.int64())),
                 pa.array(values.view("<i8")), pa.array(places, pa.int64()), pa.array(slots, pa.string())],
                names=["doc_id", "_text", "hash", "place", "slots"])

    return bound_batches(docs).select("doc_id", F.xxhash64("text").alias("_text"), "text").mapInArrow(trimmed(work), f"doc_id {kind}, _text long, {WINDOWS}")


def _pairs(own: str, other: str) -> set[tuple[str, str, str, str, bool]]:
    """(kind, key, value in the item, value in the document, whether they are the same) of the slots of a window."""
    out = set()
    for i, d in zip(own.split("\n"), other.split("\n")) if own else ():
        kind, value, key, edge = i.split("\t")
        found = d.split("\t")[1]
        same = value == found or "<" in edge and found.endswith(" " + value) or ">" in edge and found.startswith(value + " ")
        out.add((kind, key, value, found, same))
    return out


def _fits(pairs: set[tuple[str, str, str, str, bool]]) -> bool:
    """Every key stands for one value of the document throughout; a name may be cut: 'Maria Lopez' goes with 'Maria'."""
    values: dict[tuple[str, str], set[str]] = {}
    for kind, key, _, found, _ in pairs:
        if key:
            values.setdefault((kind, key), set()).add(found)
    for (kind, _), found in values.items():
        if len(found) > 1:
            whole = set(max(found, key=lambda v: (len(v.split(" ")), v)).split(" "))
            if kind != "3" or not all(whole & set(v.split(" ")) for v in found):
                return False
    return True


def judge(n: int, hits: list[tuple[int, int, int, int, str, str]], share: float) -> tuple[int, bool] | None:
    """(most words of an item of ``n`` words that a document holds in order, whether with the same values), None below the share.

    ``hits`` has (place in the document, place in the item, first word, word after the last, slots of both) per window.
    A stretch whose values contradict each other counts nowhere. Each of the others is joined with those near it, the
    longest first; a joined stretch adds the words that follow in order, and none when its values contradict.
    """
    masks: dict[int, int] = {}
    pairs: dict[int, set] = {}
    for place, at, low, high, own, other in set(hits):
        shift = place - at
        masks[shift] = masks.get(shift, 0) | ((1 << high) - (1 << low))
        pairs.setdefault(shift, set()).update(_pairs(own, other))
    shifts = sorted(s for s in masks if _fits(pairs[s]))
    reach = max(DRIFT, n // 4)
    best = None
    first = 0
    for k, main in enumerate(shifts):
        while shifts[first] < main - reach:
            first += 1
        near = []
        for s in shifts[first : first + 2 * reach + 1]:
            if s != main and s <= main + reach:
                near.append(s)
        bound = masks[main]
        for s in near:
            bound |= masks[s]
        if bound.bit_count() < share * n:
            continue
        taken, covered, values = [main], masks[main], pairs[main]
        own = {main: masks[main]}
        for s in sorted(near, key=lambda s: (-masks[s].bit_count(), abs(s - main), s)):
            new = masks[s] & ~covered
            for t in taken:
                for d in range(1, abs(s - t) + 1):
                    new &= ~(own[t] >> d if s > t else own[t] << d)
            if new and _fits(values | pairs[s]):
                taken.append(s)
                own[s] = new
                covered |= new
                values = values | pairs[s]
        words = covered.bit_count()
        if words >= share * n:
            best = max(best or (0, False), (words, all(p[4] for p in values)))
    return best


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, _text, item_id, words, share, same_values): documents that repeat an item, once per item.

    ``words`` is the most words of the item that joined stretches hold; ``same_values`` tells a copy from a
    re-parameterised one. ``_text`` is the hash of the document's text.
    """
    items = item_windows(benchmark, window)
    count = items.count()
    # Only items shorter than the window have another width. A window with a name may meet one without.
    widths = sorted((r[0], named) for r in items.select("width").distinct().collect() for named in (True, False))
    found = document_windows(docs, bitmap(items), widths)
    side = items.select("item_id", "variant", "n_words", "hash", F.col("place").alias("_at"), "low", "high", F.col("slots").alias("_slots"))
    if count <= BROADCAST_WINDOWS:
        side = F.broadcast(side)
    keys = ["doc_id", "_text", "item_id"]
    hits = found.join(side, "hash").select(*keys, "variant", "n_words", "place", "_at", "low", "high", "_slots", "slots")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[:3]):
            best = None
            for (_, n), texts in groupby(group, key=lambda r: r[3:5]):
                got = judge(n, [r[5:] for r in texts], share)
                if got is not None:
                    best = max(best or (0, 0.0, False), (got[0], got[0] / n, got[1]))
            if best is not None:
                out.append((*key, *best))
            if len(out) >= 4096:
                yield _record(out, types)
                out = []
        if out:
            yield _record(out, types)

    types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), to_arrow_type(benchmark.schema["item_id"].dataType), pa.int64(), pa.float64(), pa.bool_()]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    ordered = hits.repartition(*keys).sortWithinPartitions(*keys, "variant")
    return ordered.mapInArrow(work, f"doc_id {kinds[0]}, _text long, item_id {kinds[1]}, words long, share double, same_values boolean")


def _record(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    names = ["doc_id", "_text", "item_id", "words", "share", "same_values"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """``docs`` without the documents that repeat an item; column names that start with _d_ are reserved."""
    bad = matches(docs, benchmark, **limits).select(F.col("doc_id").alias("_d_id"), F.col("_text").alias("_d_hash")).distinct()
    marked = docs.withColumn("_d_own", F.xxhash64("text"))
    return marked.join(bad, F.col("doc_id").eqNullSafe(F.col("_d_id")) & (F.col("_d_own") == F.col("_d_hash")), "left_anti").drop("_d_own")
