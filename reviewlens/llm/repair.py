"""Conversation structure repair: the cheapest audit that makes the roles of a conversation legal.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. An audit has one letter per edit, in order:
K keeps a row (0), R gives it the role that fits, user or assistant (1), D deletes it (2), I inserts an empty turn (5).
Blank and duplicate rows have to go; a truncated row that stays costs 5 more. Of the cheapest audits the ASCII-least wins.

The dynamic program has four states (nothing yet, after system, after user, after assistant). Audits are paths in a forest
of linked nodes, so those of the four states share their prefixes. A tie is settled by the longest common prefix of two
paths: binary lifting over ancestors finds it by rolling hashes, and a prefix that only hashes equal is compared letter by
letter. Two audits of one state and cost are never prefixes of one another, so the least one stays least when both go on.

Rows of a conversation arrive in order and are not gathered: what all four paths share is decided, leaves the forest and
is given out, so memory follows the undecided end, however long the conversation is. One conversation is one ordered
stream, because its digest and its audit are.

Order, nulls and ties: rows go by turn (null first), then role, text and copy. Null roles and texts count as one blank, so
such a text is a blank row; a role with another initial than s, u or a cannot be kept. A null conv_id is a conversation of
its own. Of equal rows all but the first are duplicates. Other columns are not read. Texts of any length pass through; the
text of an undecided row is held. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.llm.common import SPACE

START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_INITIAL = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a fitting user or assistant turn leads to
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
LEGAL_PAIRS = {"su", "ua", "au"}
MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681
HELD = 512  # nodes after which the forest is cut back to what is undecided
OUT_ROWS, OUT_CHARS = 2048, 1 << 22  # results that are held before they are given out


class Forest:
    """Strings as paths from a common root; node 0 is the root."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... steps above

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % MODULUS)
        above = [parent]
        while len(self.up[above[-1]]) >= len(above):
            above.append(self.up[above[-1]][len(above) - 1])
        self.up.append(above)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        steps = self.depth[node] - depth
        while steps:
            k = steps.bit_length() - 1
            node = self.up[node][k]
            steps -= 1 << k
        return node

    def _same(self, a: int, b: int) -> bool:
        """Paths of one depth and hash are equal: walk up to where they are one."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def text(self, node: int, root: int = 0) -> str:
        out = []
        while node != root:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def less(self, a: int, b: int) -> bool:
        """The string of ``a`` comes before that of ``b``."""
        least = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, least), self.ancestor(b, least)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for k in range(least.bit_length() - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.letter[x] != self.letter[y] and self._same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)

    def common(self, nodes: list[int]) -> int:
        """The deepest node that all paths go through."""
        found = nodes[0]
        for other in nodes[1:]:
            least = min(self.depth[found], self.depth[other])
            found, other = self.ancestor(found, least), self.ancestor(other, least)
            for k in range(least.bit_length() - 1, -1, -1):
                if k < len(self.up[found]) and self.up[found][k] != self.up[other][k]:
                    found, other = self.up[found][k], self.up[other][k]
            if found != other:
                found = self.up[found][0]
        return found


def _choices(initial: str, gone: bool, truncated: bool) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of a row: letter, cost, state afterwards."""
    extra = TRUNCATED if truncated else 0
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if not gone:
            after = AFTER_INITIAL.get(initial, {}).get(state)
            if after is not None:
                edits.append(("K", KEEP + extra, after))
            edits.append(("R", REROLE + extra, TURN[state]))
        out.append(edits)
    return out


CHOICES = {(i, g, t): _choices(i, g, t) for i in ("s", "u", "a", "") for g in (False, True) for t in (False, True)}


class Audit:
    """The cheapest audit of a growing row sequence, given out as far as it is decided."""

    def __init__(self) -> None:
        self.forest = Forest()
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]  # cost and path of every state
        self.limit = HELD
        self._insert()

    def _better(self, one: tuple[int, int], other: tuple[int, int] | None) -> bool:
        if other is None or one[0] != other[0]:
            return other is None or one[0] < other[0]
        return self.forest.less(one[1], other[1])

    def _insert(self) -> None:
        """A missing turn before the next row; two in a row at most can pay."""
        best = self.best
        for state in (START, SYSTEM, ASSISTANT, USER):
            if best[state] is not None:
                to, cost = TURN[state], best[state][0] + INSERT
                if best[to] is None or cost <= best[to][0]:
                    new = (cost, self.forest.add(best[state][1], "I"))
                    if self._better(new, best[to]):
                        best[to] = new

    def _drop_hopeless(self) -> None:
        """States that can never win again, whose old paths would keep everything undecided.

        After an assistant the same edits fit as at the start, but for a system turn, which can be deleted for 2; and the
        same as after a system turn.
        """
        start, system, _, assistant = (b[0] if b is not None else None for b in self.best)
        if None not in (start, assistant) and start > assistant + DELETE:
            self.best[START] = None
        if system is not None and any(c is not None and system > c for c in (start, assistant)):
            self.best[SYSTEM] = None

    def row(self, initial: str, gone: bool, truncated: bool) -> str:
        """One more row; the letters that became decided."""
        after: list[tuple[int, int] | None] = [None] * 4
        for here, edits in zip(self.best, CHOICES[initial if initial in AFTER_INITIAL else "", gone, truncated]):
            if here is None:
                continue
            for letter, cost, to in edits:
                cost += here[0]
                if after[to] is None or cost <= after[to][0]:
                    new = (cost, self.forest.add(here[1], letter))
                    if self._better(new, after[to]):
                        after[to] = new
        self.best = after
        self._insert()
        self._drop_hopeless()
        return self._decided() if len(self.forest.letter) > self.limit else ""

    def _decided(self) -> str:
        """Cut the forest back to the paths below the last node that all of them share."""
        old, live = self.forest, [b for b in self.best if b is not None]
        root = old.common([node for _, node in live])
        out = old.text(root)
        self.forest, place = Forest(), {root: 0}
        for _, node in live:
            path = []
            while node not in place:
                path.append(node)
                node = old.up[node][0]
            for n in reversed(path):
                place[n] = self.forest.add(place[old.up[n][0]], old.letter[n])
        self.best = [None if b is None else (b[0], place[b[1]]) for b in self.best]
        self.limit = max(HELD, 4 * len(self.forest.letter))
        return out

    def end(self) -> tuple[int, str]:
        """Cost of the whole audit, and its letters since the last decided ones."""
        win = self.best[START]
        if self.best[ASSISTANT] is not None and self._better(self.best[ASSISTANT], win):
            win = self.best[ASSISTANT]
        assert win is not None  # the start is only given up for an assistant, which can always be reached again
        return win[0], self.forest.text(win[1])


class Conversation:
    """Repairs one conversation row by row; ``turns`` holds the repaired (edit, role, text) given out so far.

    A deleted row appears with its edit and is no part of the repaired conversation; the text of one that has to go is not
    held until then.
    """

    def __init__(self) -> None:
        self.audit, self.waiting, self.state = Audit(), deque(), START
        self.turns: list[tuple[str, str, str]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last_turn = None
        self.distinct, self.before = 0, None

    def add(self, turn: int | None, role: str, text: str, blank: bool, seen: bool, cut: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.last_turn
            self.high = self.last_turn = turn
        seen = seen or (self.before == (turn, role, text))
        self.illegal += self.before is not None and self.before[1][:1] + role[:1] not in LEGAL_PAIRS
        self.before = (turn, role, text)
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not blank and not seen
        self.waiting.append((role, "" if blank or seen else text))
        self._give(self.audit.row(role[:1], blank or seen, cut and not blank and not seen))

    def _give(self, letters: str) -> None:
        for letter in letters:
            role, text = self.waiting.popleft() if letter != "I" else ("", "")
            if letter in "RI":
                self.state = TURN[self.state]
                role = ROLES[self.state]
            elif letter == "K":
                self.state = AFTER_INITIAL[role[0]][self.state]
            self.turns.append((letter, role, text))

    def end(self) -> int:
        """Decide the rest; the cost."""
        cost, rest = self.audit.end()
        self._give(rest)
        return cost

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with planted faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (here: ``dropped``, so that its conversation is still known), 1 empties the text, 2 removes its sentence
    ends, 3 repeats the row (``copy`` 1), 4 makes it the user's. Nulls count as one blank.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fate.alias("_fate"))
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") != 0, text).alias("text"), (F.col("_fate") == 0).alias("dropped"), F.explode(copies).alias("copy"),
    )


def diagnosed(conversations: DataFrame) -> DataFrame:
    """Rows with the faults ``blank``, ``seen`` (role and text occur earlier) and ``cut`` (no sentence end).

    Where a role and text come first is found by partial aggregation, so a turn that a conversation repeats without end
    is one row of that search; equal rows at one place are told apart by the stream, where they are neighbours.
    """
    given = conversations.columns
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.col("dropped") if "dropped" in given else F.lit(False)).alias("dropped"),
        (F.col("copy") if "copy" in given else F.lit(0)).alias("copy"),
    ).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    end = F.rtrim("text", F.lit(SPACE))
    place: Column = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "copy")
    key = ["conv_id", "role", "digest"]
    first = rows.where(~F.col("dropped")).groupBy(*key).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = first.select(*[F.col(c).alias(f"_{c}") for c in key], "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return rows.withColumns({"_place": place, "blank": end == "", "cut": ~F.right(end, F.lit(1)).isin(".", "!", "?")}).join(
        first, same, "left"
    ).select("conv_id", "turn", "role", "text", "dropped", "copy", "digest", "blank", "cut",
             F.coalesce(F.col("_place") > F.col("_first"), F.lit(False)).alias("seen"))


def _stream(rows: DataFrame, work, schema: str) -> DataFrame:
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "copy"
    )
    return ordered.select("conv_id", "turn", "role", "text", "dropped", "blank", "seen", "cut").mapInArrow(work, schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Conversation, bool]]:
    """(conv_id, conversation, ended) after every row that decided something, and at the end of each conversation."""
    now, conv = None, None
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            for conv_id, turn, role, text, dropped, blank, seen, cut in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns)):
                if conv is None or conv_id != now:
                    if conv is not None:
                        yield now, conv, True
                    now, conv = conv_id, Conversation()
                if not dropped:
                    conv.add(turn, role, text, blank, seen, cut)
                    if conv.turns:
                        yield now, conv, False
    if conv is not None:
        yield now, conv, True


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of every edit of ``diagnosed`` rows; deleted rows are listed with edit D."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place long, edit string, role string, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, place = [], 0, 0
        id_type = None

        def first_type(source):
            nonlocal id_type
            for b in source:
                id_type = b.schema.field("conv_id").type
                yield b

        def out():
            ids, *rest = zip(*held)
            return pa.record_batch([pa.array(ids, id_type), pa.array(rest[0], pa.int64()), *[pa.array(c, pa.string()) for c in rest[1:]]],
                                   names=["conv_id", "place", "edit", "role", "text"])

        for conv_id, conv, ended in _conversations(first_type(batches)):
            if ended:
                conv.end()
            for edit, role, text in conv.turns:
                held.append((conv_id, place, edit, role, text))
                place, chars = place + 1, chars + len(text)
                if len(held) >= OUT_ROWS or chars > OUT_CHARS:
                    yield out()
                    held, chars = [], 0
            conv.turns.clear()
            place = 0 if ended else place
        if held:
            yield out()

    return _stream(rows, work, schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``diagnosed`` rows: faults, cost, audit and the digest of the repaired turns."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        id_type = None

        def first_type(source):
            nonlocal id_type
            for b in source:
                id_type = b.schema.field("conv_id").type
                yield b

        def out():
            cols = list(zip(*held))
            return pa.record_batch(
                [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]], *[pa.array(c, pa.string()) for c in cols[7:]]],
                names=["conv_id", *counts, "audit", "repaired_sha256"])

        letters, digest, some = [], hashlib.sha256(), False
        for conv_id, conv, ended in _conversations(first_type(batches)):
            cost = conv.end() if ended else 0
            letters.append("".join(edit for edit, _, _ in conv.turns))
            for edit, role, text in conv.turns:
                if edit != "D":
                    digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    some = True
            conv.turns.clear()
            if ended:
                audit = "".join(letters)
                held.append((conv_id, conv.gaps, conv.blank, conv.duplicate, conv.truncated, conv.illegal, cost, audit, digest.hexdigest()))
                chars += len(audit)
                letters, digest, some = [], hashlib.sha256(), False
                if len(held) >= OUT_ROWS or chars > OUT_CHARS:
                    yield out()
                    held, chars = [], 0
        if held:
            yield out()

    return _stream(rows, work, schema)
