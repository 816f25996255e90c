"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

A text is escaped as the model says (blanks become U+2581, one goes in front) and cut into words in front of every run of
blanks; no piece reaches over such a cut. All words that are new to a worker lie in one flat array of symbols. A round finds
the least pair rank of every word (segmented minimum) and merges, in all words at once, the leftmost pair of that rank;
then the array is compacted, and words without a pair of the vocabulary leave it. Words go on until none is left.

More than one pair of a word is merged in a round where that equals one after the other:

* a piece is *steady* if every piece made of it has a higher rank. What arises beside a merged pair then waits, so all pairs
  of the rank are merged, from the left and without overlap;
* for other pieces, what arises may be merged before the next pair of the rank. It always contains the merged pair and is no
  longer than the longest piece, so pairs further apart than two of those do not meet: the first of every cluster is merged.

Characters outside the vocabulary become their UTF-8 bytes, or the unknown piece if the model has no byte pieces. Models
with another kind, a character map or user-defined pieces are refused.

Nulls: a null text has no ids, like an empty one; null ids decode to the empty text, and null entries and numbers outside
the vocabulary are passed over. Texts are read whole; a word of any length is one segment of the flat array. Repeated rows
and other columns stay as they are (a column named like the added one is replaced); an empty table stays empty.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from reviewlens.llm.common import bound_batches, without

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces
BPE = 2  # fixed value: kind of model
UNKNOWN_TEXT = " ⁇ "  # fixed value: what an unknown piece decodes to unless the model names another text
NEVER = np.iinfo(np.int32).max
CODES = 0x110000
KEPT_WORDS, KEPT_LENGTH = 1 << 18, 64  # distinct words a worker remembers, and the longest of them
PART = 1 << 20  # characters of texts, or ids, handled at once


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value: object = number()
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            size = number()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], dict, dict]:
    """((piece, score, kind) by id, trainer settings, normaliser settings) of a model file."""
    pieces, trainer, normaliser = [], {}, {}
    for name, value in _fields(data):
        if name == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode("utf-8"), own.get(2, 0.0), own.get(3, NORMAL)))
        elif name == 2:
            trainer = dict(_fields(value))
        elif name == 3:
            normaliser = dict(_fields(value))
    return pieces, trainer, normaliser


class Vocabulary:
    """The tables of a model, bounded by its size; workers keep one with the words they have met."""

    def __init__(self, data: bytes):
        pieces, trainer, normaliser = read_model(data)
        kinds = np.array([k for _, _, k in pieces])
        if trainer.get(3, 1) != BPE or normaliser.get(2, b"") or trainer.get(24, 0) or not normaliser.get(5, 1):
            raise ValueError("only BPE models with plain normalisation and blanks in front of words are supported")
        if np.isin(kinds, (USER, UNUSED)).any() or normaliser.get(4, 1):
            raise ValueError("models with user-defined or unused pieces, or that remove blanks, are not supported")
        self.prefix = bool(normaliser.get(3, 1))
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        normal = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.word = re.compile(" *[^ ]+| +") if not any(BLANK in p.lstrip(BLANK) for p in normal) else re.compile("(?s).+")
        self.longest = max(map(len, normal), default=1)

        # Symbols: the pieces by id, then characters that occur in pieces only, then all other characters by code.
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(symbols)):
            symbols[c] = len(pieces) + len(symbols) - len(normal)
        self.pieces, self.base = len(pieces), len(pieces) + len(symbols) - len(normal)
        self.of_code = self.base + np.arange(CODES, dtype=np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_code[ord(s)] = i
        self.code_of = np.array([ord(s) for s, i in symbols.items() if i >= len(pieces)], np.int64)

        scores = np.array([s for _, s, _ in pieces], np.float32)
        ids = np.array(sorted(normal.values()), np.int64)
        levels, place, times = np.unique(-scores[ids], return_inverse=True, return_counts=True)
        rank = np.full(self.base, -1, np.int32)
        rank[ids] = place
        steady = np.zeros(self.base, bool)
        steady[ids] = times[place] == 1
        pairs = []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a * (self.base + CODES) + b, i))
                    for part in (a, b):
                        steady[part] &= rank[part] < rank[i]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.merged = table[:, 0].copy(), table[:, 1].copy()
        self.rank, self.steady = rank, steady

        self.byte_id = np.full(256, -1, np.int64)
        out = []
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            elif k == UNKNOWN:
                out.append(trainer[44] if 44 in trainer else UNKNOWN_TEXT.encode())
            else:
                out.append(b"" if k == CONTROL else p.replace(BLANK, " ").encode())
        self.is_byte, self.is_control = kinds == BYTE, kinds == CONTROL
        self.strips = np.array([p.startswith(BLANK) for p, _, _ in pieces]) & (kinds == NORMAL)
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_at = np.r_[0, np.cumsum([len(x) for x in out])]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # ---- encoding --------------------------------------------------------------------------------------------------

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of neighbouring symbols; NEVER if they make no piece."""
        key = left * (self.base + CODES) + right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        merged = np.where(hit, self.merged[at] if len(self.keys) else 0, 0)
        return np.where(hit, self.rank[merged], NEVER).astype(np.int32), merged

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word) after all merges of the words that begin at ``starts`` (none is empty), in order of words."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(symbols)]))
        place = np.arange(len(symbols))  # of the first character
        last = np.r_[word[1:] != word[:-1], True]
        rank, merged = self._pair(symbols, np.r_[symbols[1:], 0])
        rank[last] = NEVER
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[first, len(symbols)])
            least = np.minimum.reduceat(rank, first)
            if (least == NEVER).any():
                over = np.repeat(least == NEVER, sizes)
                done.append((symbols[over], word[over]))
                symbols, word, place, rank, merged = (x[~over] for x in (symbols, word, place, rank, merged))
                if not len(symbols):
                    break
                sizes, least = sizes[least != NEVER], least[least != NEVER]
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            fresh = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            # Steady pieces: every other pair of a run of overlapping ones, counted from its left end.
            run = np.flatnonzero(fresh | np.r_[True, hit[1:] != hit[:-1] + 1])
            in_run = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            # Other pieces: the first pair of every cluster.
            apart = fresh | np.r_[True, place[hit[1:]] - place[hit[:-1]] > 2 * self.longest]
            at = hit[np.where(self.steady[merged[hit]], in_run % 2 == 0, apart)]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            symbols, word, place, rank, merged = (x[keep] for x in (symbols, word, place, rank, merged))
            touched = np.stack([np.maximum(new[at] - 1, 0), new[at]], axis=1).ravel()  # in order
            touched = touched[np.r_[True, touched[1:] != touched[:-1]]]
            after = np.minimum(touched + 1, len(symbols) - 1)
            rank[touched], merged[touched] = self._pair(symbols[touched], symbols[after])
            ends = (after == touched) | (word[after] != word[touched])
            rank[touched[ends]] = NEVER
        symbols, word = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _to_ids(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary as bytes, or as the unknown piece, of which equal neighbours are one."""
        odd = np.flatnonzero(symbols >= self.pieces)
        if not len(odd):
            return symbols, word
        codes = symbols[odd] - self.base
        inner = codes < 0
        codes[inner] = self.code_of[symbols[odd][inner] - self.pieces]
        if (self.byte_id < 0).any():
            symbols = symbols.copy()
            symbols[odd] = self.unknown
            return symbols, word
        lengths = np.ones(len(symbols), np.int64)
        lengths[odd] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        raw = np.frombuffer("".join(map(chr, codes.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        out = np.repeat(symbols, lengths)
        out[np.repeat(np.isin(np.arange(len(symbols)), odd), lengths)] = self.byte_id[raw]
        return out, np.repeat(word, lengths)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of every word) of escaped, non-empty words."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), "<u4")
        starts = np.r_[0, np.cumsum([len(w) for w in words])[:-1]]
        ids, word = self._to_ids(*self.merge(self.of_code[codes], starts))
        return ids.astype(np.int32), np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of every text)."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        blank = " " if self.prefix else ""
        split = [self.word.findall(blank + t.replace(BLANK, " ")) if t else [] for t in texts]
        missing = {w for words in split for w in words if w not in self.known}
        short = [w for w in missing if len(w) <= KEPT_LENGTH]
        long = [w for w in missing if len(w) > KEPT_LENGTH]
        ids, counts = self.encode_words(short)
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(short))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.r_[self.ends, self.ends[-1] + np.cumsum(counts)]
        place, pool, ends = self.known, self.ids, self.ends
        if long:  # used now, not kept
            ids, counts = self.encode_words(long)
            place = {**{w: len(ends) - 1 + i for i, w in enumerate(long)}}
            pool, ends = np.concatenate([pool, ids]), np.r_[ends, ends[-1] + np.cumsum(counts)]
            known = self.known
            number = [known[w] if w in known else place[w] for words in split for w in words]
        else:
            number = [place[w] for words in split for w in words]
        at = np.array(number, np.int64)
        sizes = ends[at + 1] - ends[at]
        flat = pool[np.arange(sizes.sum()) + np.repeat(ends[at] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)] if len(at) else pool[:0]
        per_text = np.add.reduceat(np.r_[sizes, 0], np.r_[0, np.cumsum([len(s) for s in split])[:-1]]) if split else np.zeros(0, np.int64)
        per_text[[not s for s in split]] = 0
        return flat, per_text

    # ---- decoding --------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < self.pieces)]
        sizes = self.out_at[ids + 1] - self.out_at[ids]
        raw = self.out[np.arange(sizes.sum()) + np.repeat(self.out_at[ids] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)].tobytes() if len(ids) else b""
        first = ids[~self.is_control[ids]][:1]
        skip = int(self.prefix and len(first) and self.strips[first[0]])
        if not self.is_control[ids].any():  # a control piece between two bytes parts them
            try:
                return raw[skip:].decode()
            except UnicodeDecodeError:
                pass
        return self._by_runs(ids, sizes, raw)[skip:]

    def _by_runs(self, ids: np.ndarray, sizes: np.ndarray, raw: bytes) -> str:
        """Runs of byte pieces on their own: a byte that begins no character is a replacement character."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        byte = self.is_byte[ids]
        cut = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        out = []
        for a, b in zip(cut, np.r_[cut[1:], len(ids)]):
            part = raw[starts[a] : ends[b - 1]]
            if not byte[a]:
                out.append(part.decode())
                continue
            at = 0
            while at < len(part):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(part[at : at + width].decode())
                        at += width
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
        return "".join(out)


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file that the driver can open; workers get its tables."""
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``PART``, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > PART:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` without its text, with the ids of the text."""
    docs = bound_batches(without(docs, ids) if ids != text else docs)
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = StructType([*kept]).add(ids, ArrayType(IntegerType(), False))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value  # lives as long as the worker process, with the words it has met
        for batch in batches:
            column = batch.column(text)
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in _parts(sizes):
                flat, counts = model.encode(column.slice(a, b - a).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.record_batch([*[batch.column(f.name).slice(a, b - a) for f in kept], lists], names=schema.names)

    return docs.mapInArrow(work, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids."""
    rows = without(rows, text)
    schema = StructType([*rows.schema.fields]).add(text, StringType())
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(ids)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in _parts(sizes):
                texts = []
                for own in column.slice(a, b - a):
                    values = own.values
                    texts.append(model.decode(values.drop_null().to_numpy(zero_copy_only=False)) if values is not None and len(values) else "")
                part = batch.slice(a, b - a)
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(work, schema)
