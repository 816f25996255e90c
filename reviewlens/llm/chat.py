"""Chat formatting in budgeted windows.

Every conversation is cut into spans of whole turns by the prefix sums of their tokens: the budget line is divided into
steps of the budget, the turns that lie inside one step form a span, and a turn that crosses a step joins the span after
it if both fit, or stands alone. So no span needs the one before it, and a conversation of any length is cut in parallel.
Each window then shows the system turn, a few turns repeated from before, and its own span. Targets (assistant turns) are
under the loss mask only in the window whose span holds them.

Template: ``<|role|>text<|end|>`` per turn. Control strings inside texts and roles are broken up by a backslash after
their first character, and backslashes are doubled; ``unescape`` undoes both.

Nulls and ties: a null text or role is empty, a null turn sorts first, turns that tie are ordered by role and text and all
stay, rows without conv_id form one conversation. An empty table gives an empty result, an empty text a turn without
characters. A turn for which the budget has no room beside the system turn is a window with that system turn alone, and
longer than the budget by what is lacking. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.llm.common import stage

# Control strings of common chat templates and of this one.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SYSTEM, TARGET = "system", "assistant"
BLOCK = 256  # turns numbered together in one task

_BREAK = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))
_UNBREAK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|((?:[^|\\]|\\.|\|(?!>))*)\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNBREAK.sub(r"\1", text)


def tokens(text: Column) -> Column:
    """Tokens of a turn: runs of letters and digits, and single signs."""
    return F.regexp_count(text, F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]")) + 4  # the template's own


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """Adds pos (1, 2, ...) and upto, the tokens up to and including each turn of its conversation.

    Two levels: running sums inside blocks of turns, then over the blocks' totals.
    """
    turns = turns.withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    order = ("turn", "role", "text")
    inside = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv_id", "_block").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_n")).select(
        F.col("conv_id").alias("_conv"), F.col("_block").alias("_b"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
    )
    numbered = turns.withColumns({"upto": F.sum("tokens").over(inside), "pos": F.row_number().over(inside)})
    joined = numbered.join(totals, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_b")))
    return joined.withColumns({"upto": F.col("upto") + F.col("_t0"), "pos": F.col("pos") + F.col("_n0")}).select(
        "conv_id", "role", "text", "tokens", "upto", "pos"
    )


def windows(conversations: DataFrame, budget: int = 512, history: int = 2, history_tokens: int = 128) -> DataFrame:
    """(conv_id, window, turns): turns is an array of (pos, role, text, own), own false where a turn is repeated.

    A window has at most ``budget`` tokens, unless its system turn and one own turn alone have more. The system turn that
    opens the conversation is always shown; of the turns before the span at most ``history`` are repeated, with at most
    ``history_tokens`` tokens, and as many as fit beside the rest.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tokens", tokens(F.col("text")).cast("long"))
    summed = stage(_prefix_sums(turns))
    opens = summed.where((F.col("pos") == 1) & (F.col("role") == SYSTEM)).select(
        F.col("conv_id").alias("_conv"), F.col("text").alias("_system"), F.col("tokens").alias("_cost"))
    summed = summed.join(opens, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    is_system = (F.col("pos") == 1) & F.col("_system").isNotNull()
    room = F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.coalesce("_cost", F.lit(0)))
    start = F.col("upto") - F.col("tokens") - F.coalesce("_cost", F.lit(0))
    cut = summed.where(~is_system).withColumns({"_room": room, "_from": start, "_upto": F.col("upto") - F.coalesce("_cost", F.lit(0))})
    cut = cut.withColumns({
        "_step": F.floor(F.col("_from") / F.col("_room")),
        "_crosses": F.floor(F.col("_from") / F.col("_room")) < F.floor((F.col("_upto") - 1) / F.col("_room")),
    })
    # A crossing turn belongs to the step that it ends in, if what lies inside that step leaves room for it.
    cut = cut.withColumn("_step", F.when(F.col("_crosses"), F.floor((F.col("_upto") - 1) / F.col("_room"))).otherwise(F.col("_step")))
    inner = cut.groupBy(F.col("conv_id").alias("_c"), F.col("_step").alias("_s")).agg(F.sum("tokens").alias("_all"))
    cut = cut.join(inner, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_step") == F.col("_s")))
    alone = F.col("_crosses") & (F.col("_all") > F.col("_room"))
    cut = stage(cut.withColumn("_span", 2 * F.col("_step") + F.when(alone, 0).otherwise(1)).select(
        "conv_id", "role", "text", "tokens", "pos", "_span", "_from", "_system", "_cost"))
    # Own turns, and turns that a later span repeats: those at most ``history`` places before its first turn.
    first_rows = cut.groupBy(F.col("conv_id").alias("_c2"), F.col("_span").alias("_window")).agg(
        F.min("pos").alias("_first"), F.min("_from").alias("_at"), F.max("_system").alias("_sys"),
        (F.sum("tokens") + F.coalesce(F.max("_cost"), F.lit(0))).alias("_taken"))
    own = cut.select("conv_id", F.col("_span").alias("_window"), "pos", "role", "text", F.lit(True).alias("own"))
    wanted = first_rows.withColumn("_pos", F.explode(F.sequence(F.col("_first") - history, F.col("_first") - 1))).where("_pos > 0")
    repeated = cut.join(wanted, F.col("conv_id").eqNullSafe(F.col("_c2")) & (F.col("pos") == F.col("_pos"))).where(
        F.col("_at") - F.col("_from") <= F.least(F.lit(history_tokens), F.lit(budget) - F.col("_taken"))
    ).select("conv_id", "_window", "pos", "role", "text", F.lit(False).alias("own"))
    shown = first_rows.where(F.col("_sys").isNotNull())
    once = F.col("_first") == 2
    system = shown.select(
        F.col("_c2").alias("conv_id"), "_window", F.lit(1).cast("long").alias("pos"), F.lit(SYSTEM).alias("role"),
        F.col("_sys").alias("text"), once.alias("own"))
    # A conversation of its system turn alone is one window.
    lonely = summed.where(is_system).join(first_rows, F.col("conv_id").eqNullSafe(F.col("_c2")), "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("_window"), "pos", "role", "text", F.lit(True).alias("own"))
    parts = own.unionByName(repeated).unionByName(system).unionByName(lonely)
    return parts.groupBy("conv_id", F.col("_window").alias("window")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text", "own"))).alias("turns"))


def render(windows_: DataFrame) -> DataFrame:
    """(conv_id, window, text, mask, fresh): the formatted text, its loss mask as spans of code points, and the places of
    the turns that no earlier window has shown.
    """
    conv = windows_.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks, fresh = [], [], []
            for turns in batch.column("turns").to_pylist():
                out, mask, new, at = [], [], [], 0
                for k, t in enumerate(turns):
                    head, body = f"<|{escape(t['role'])}|>", escape(t["text"])
                    if t["own"]:
                        new.append(k)
                        if t["role"] == TARGET:
                            mask.append([at + len(head), at + len(head) + len(body)])
                    piece = head + body + "<|end|>"
                    out.append(piece)
                    at += len(piece)
                texts.append("".join(out))
                masks.append(mask)
                fresh.append(new)
            yield pa.record_batch(
                [batch.column("conv_id"), batch.column("window"), pa.array(texts, pa.string()),
                 pa.array(masks, pa.list_(pa.list_(pa.int64()))), pa.array(fresh, pa.list_(pa.int32()))],
                names=["conv_id", "window", "text", "mask", "fresh"])

    return windows_.mapInArrow(work, f"conv_id {conv}, window long, text string, mask array<array<bigint>>, fresh array<int>")


def format_conversations(conversations: DataFrame, **limits: int) -> DataFrame:
    """Formatted windows of ``conversations``, see ``windows`` and ``render``."""
    return render(windows(conversations, **limits))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted text alone: its turns and its masked text as digests.

    Windows stream through a worker in order, so a conversation of any length needs the memory of one window.
    """
    conv = formatted.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        none = object()
        current, out = none, []
        n = loss = chars = 0
        turns = masked = None

        def close():
            if current is not none:
                out.append((current, n, turns.hexdigest(), loss, masked.hexdigest(), chars))

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if current is none or row["conv_id"] != current:
                    close()
                    current, n, loss, chars = row["conv_id"], 0, 0, 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                fresh = set(row["fresh"])
                for k, (role, text) in enumerate(parse(row["text"])):
                    if k in fresh:
                        n += 1
                        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, b in row["mask"]:
                    text = unescape(row["text"][a:b])
                    loss += len(text)
                    masked.update(text.encode("utf-8", "surrogatepass"))
                chars += len(row["text"])
            if len(out) > 4096:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _types(kind))], names=names)
                out = []
        close()
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _types(kind))], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(
        work, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _types(conv: pa.DataType) -> list[pa.DataType]:
    return [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
