"""Piece encoding and decoding against the library that defines them, and against merges one at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from reviewlens.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = pieces.load(MODEL)
PARTS = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(LIBRARY.get_piece_size())]
CHARACTERS = [chr(c) for c in (32, 32, 32, 97, 97, 98, 101, 114, 10, 0, 9601, 233, 0x4E00, 0x1F600, 0xFFFD, 0x10FFFF)]


def encoded(texts):
    flat, counts = OWN.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def check(texts):
    want = [LIBRARY.encode(t or "") for t in texts]
    got = encoded(texts)
    assert got == want
    assert [OWN.decode(np.array(g, np.int64)) for g in got] == LIBRARY.decode(want)


def test_texts_of_pieces_and_odd_characters(rng):
    texts = ["".join(PARTS[i] for i in rng.integers(0, len(PARTS), int(rng.integers(0, 40)))) for _ in range(600)]
    texts += ["".join(CHARACTERS[i] for i in rng.integers(0, len(CHARACTERS), int(rng.integers(0, 60)))) for _ in range(600)]
    texts += [None, "", " ", "  ", "▁", "a" * 9000, "ab" * 4000, "er" * 3000 + "s", "<s></s><0x41><unk>"]
    check(texts)


def test_long_words_without_blanks(rng):
    letters = list("abcdeinorst")
    check(["".join(letters[i] for i in rng.integers(0, len(letters), 6000)) for _ in range(4)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("etaoinshrdlu .'-\n▁é中") | st.characters(exclude_categories=["Cs"])), min_size=1, max_size=4))
def test_any_texts(texts):
    check(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 262), max_size=12))
def test_any_ids_decode(ids):
    assert OWN.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_forgetting_words_changes_nothing(monkeypatch, rng):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 10)
    monkeypatch.setattr(pieces, "KEPT_LENGTH", 3)
    for _ in range(20):
        check(["".join(PARTS[i] for i in rng.integers(0, 2000, 30)) for _ in range(5)])


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(pieces, "PART", 50)
    rows = [(i, t, "clash", [9]) for i, t in enumerate([None, "", "Some words, some words.", "x" * 5000, "naïve\n中文 😀"] * 3)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    out = pieces.decode(pieces.encode(docs, OWN), OWN).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        want = LIBRARY.encode(rows[r.doc_id][1] or "")
        assert (r.ids, r.decoded) == (want, LIBRARY.decode(want))
    nothing = pieces.decode(pieces.encode(docs.where("doc_id < 0"), OWN), OWN)
    assert nothing.collect() == [] and set(nothing.columns) == {"doc_id", "ids", "decoded"}
    odd = spark.createDataFrame([(None,), ([],), ([264, None, 99999, -5],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(odd, OWN).collect()] == ["", "", "a"]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary(b"\x12\x02\x18\x01")


def test_query_on_the_given_table(spark):
    from reviewlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = QUERIES["op12_pieces"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = LIBRARY.encode(texts[r.doc_id])
        hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(r) == (r.doc_id, len(ids), hexed(",".join(map(str, ids))), hexed(LIBRARY.decode(ids)))
