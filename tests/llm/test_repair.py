"""Conversation repair against an exhaustive search and an independent table of strings."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest

from reviewlens.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn int, role string, text string, extra int, digest string"


def plain_damage(rows):
    """{conv: [(turn, role, text)]} after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        if fate:
            own += [(turn, role, text)] * (2 if fate == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {c: sorted(r, key=key) for c, r in out.items()}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        if not ink:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Cheapest (cost, audit, turns): whole strings per grammar state, no shared nodes."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def offer(into, state, found):
        if state not in into or found < into[state]:
            into[state] = found

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, turns) in list(table.items()):
                for letter in "ua":
                    if letter in step[state]:
                        offer(table, letter, (cost + 5, audit + "I", turns + (f"{full[letter]}:",)))
        return table

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, turns) in best.items():
            offer(new, state, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] in step[state]:
                offer(new, step[state][role[:1]], (cost + more, audit + "K", turns + (f"{role}:{text}",)))
            for letter in "ua":
                if letter in step[state]:
                    offer(new, letter, (cost + 1 + more, audit + "R", turns + (f"{full[letter]}:{text}",)))
        best = inserted(new)
    return min(best[s] for s in ("", "a") if s in best)


def plain_report(rows):
    out = {}
    for conv, own in plain_damage(rows).items():
        faults = plain_faults(own)
        cost, audit, turns = plain_repair(own, faults)
        turns_known = [t for t, _, _ in own if t is not None]
        gaps = max(turns_known) - min(turns_known) + 1 - len(set(turns_known)) if turns_known else 0
        roles = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


def report(spark, rows):
    given = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    found = repair.repair_report(repair.diagnosed(repair.damage(given))).collect()
    out = {r[0]: tuple(r[1:]) for r in found}
    assert len(out) == len(found)
    return out


def random_rows(rng, conversations, longest, texts=("Yes.", "No!", "Why", "", " \t", "So it is?  ", "a.b", None)):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "unknown", "", None]
    rows = []
    for conv in range(conversations):
        for turn in range(int(rng.integers(1, longest))):
            role = roles[int(rng.integers(0, len(roles)))] if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = texts[int(rng.integers(0, len(texts)))] if rng.random() < 0.5 else f"Text {conv} {turn}."
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn * int(rng.integers(1, 3)), role, text))
    return rows


def test_reports_equal_a_plain_search(spark, rng):
    rows = random_rows(rng, 300, 14)
    rows += rows[:40] + [(9999, 0, "user", "x" * 100_000 + "."), (9999, 1, "assistant", "y" * 100_000)]
    assert report(spark, rows) == plain_report(rows)


def test_a_long_conversation_is_given_out_as_it_is_decided(spark, rng, monkeypatch):
    monkeypatch.setattr(repair, "HELD", 32)
    rows = [(7, t, ("user", "assistant", "user", "system")[int(rng.integers(0, 4))], f"t{int(rng.integers(0, 900))}" + "."[: int(rng.integers(0, 2))])
            for t in range(3000)]
    conv = repair.Conversation()
    most = 0
    own = plain_damage(rows)[7]
    for (turn, role, text), fault in zip(own, plain_faults(own)):
        conv.add(turn, role, text, fault == "blank", fault == "duplicate", fault == "truncated")
        most = max(most, len(conv.waiting))
    cost = conv.end()
    want = plain_repair(own, plain_faults(own))
    assert (cost, "".join(e for e, _, _ in conv.turns)) == want[:2]
    assert most < len(own) / 4
    assert report(spark, rows) == plain_report(rows)


def test_turns_equal_the_report(spark, rng):
    rows = random_rows(rng, 60, 12)
    given = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    found = repair.repaired_turns(repair.diagnosed(repair.damage(given))).orderBy("conv_id", "place").collect()
    want = plain_report(rows)
    for conv, expected in want.items():
        own = [r for r in found if r.conv_id == conv]
        assert [r.place for r in own] == list(range(len(own)))
        kept = [r for r in own if r.edit != "D"]
        assert "".join(r.edit for r in own) == expected[6]
        assert SHAPE.fullmatch("".join(r.role[0] for r in kept))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == expected[7]


def test_paths_compare_like_strings(rng, monkeypatch):
    forest, known = repair.Forest(), {0: ""}
    for _ in range(400):
        parent = int(rng.integers(0, len(known)))
        letter = "DIKR"[int(rng.integers(0, 4))]
        known[forest.add(parent, letter)] = known[parent] + letter
    pairs = [tuple(map(int, rng.integers(0, len(known), 2))) for _ in range(4000)]
    check = lambda: all(forest.less(a, b) == (known[a] < known[b]) for a, b in pairs)
    assert check()
    assert all(known[forest.common([a, b])] == known[b][: len(known[forest.common([a, b])])] for a, b in pairs)
    # Hashes that all collide: the letters decide.
    forest.hash = [0] * len(forest.hash)
    assert check()
    forest.hash = [d % 3 for d in forest.depth]
    assert check()


def test_query_on_the_given_table(spark):
    from reviewlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op13_repair"](spark, sf)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == plain_report(given)


@pytest.mark.parametrize("rows", [[], [(1, 0, None, None)], [(None, None, None, None)] * 3])
def test_conversations_of_nothing(spark, rows):
    assert report(spark, rows) == plain_report(rows)
