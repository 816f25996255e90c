"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by the hash of their text, then by id. The boundaries between shards are found by counting: each round
adds up the exact bytes below every probe in one pass over the narrow keys, brackets each boundary between two probes and
refines the probes inside the bracket, until the bytes below a probe are within the tolerance. A boundary lies between
two hashes, so equal texts stay in one shard; only where one hash alone outweighs the tolerance is it cut, by id.
Then the rows move once.

Nulls and ties: a null text counts as empty, a null id sorts first. Rows that agree in text and id cannot be told apart
and stay together. Ids that are no whole numbers are ordered by their hash. An empty table gives an empty result. A text
that outweighs a shard fills one. Other columns travel along; columns named size, shard or slot are replaced, and names that
start with _s_ are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.llm.common import stage, without

PROBES = 12  # probes per open boundary and round
TOLERANCE = 0.002  # bytes off the exact boundary, as a share of one shard
SLOT_ROWS = 50_000  # rows numbered together in one task
LOW, HIGH = -(1 << 63), (1 << 63) - 1


Key = tuple[int, int]  # hash, id


@dataclass
class Bracket:
    """A boundary lies from ``low`` up to ``high``."""

    low: Key
    high: Key


def size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def order_key(text: Column, doc_id: Column) -> dict[str, Column]:
    return {
        "_s_hash": F.xxhash64(F.coalesce(text, F.lit(""))),
        "_s_tie": F.coalesce(doc_id.try_cast("long"), F.when(doc_id.isNotNull(), F.xxhash64(doc_id)), F.lit(LOW)),
    }


def _below(hash_: int, tie: int) -> Column:
    """Rows strictly below a key."""
    if tie == LOW:
        return F.col("_s_hash") < hash_
    return (F.col("_s_hash") < hash_) | ((F.col("_s_hash") == hash_) & (F.col("_s_tie") < tie))


def _between(a: int, b: int, n: int) -> list[int]:
    return sorted({a + (b - a) * k // (n + 1) for k in range(1, n + 1)} - {a})


def histogram(keys: DataFrame, probes: list[Key]) -> list[tuple[int, Key | None, Key | None]]:
    """(bytes, least key, greatest key) of the rows from each probe up to the next, starting with those below the first.

    One pass and one row per gap; the place of a row is found by a balanced tree of comparisons.
    """

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(_below(*probes[mid]), tree(a, mid)).otherwise(tree(mid + 1, b))

    key = F.struct("_s_hash", "_s_tie")
    rows = keys.groupBy(tree(0, len(probes)).alias("gap")).agg(F.sum("_s_size"), F.min(key), F.max(key)).collect()
    found = {r[0]: (r[1], tuple(r[2]), tuple(r[3])) for r in rows}
    return [found.get(k, (0, None, None)) for k in range(len(probes) + 1)]


def _probes(b: Bracket, n: int) -> set[Key]:
    (h, t), (h2, t2) = b.low, b.high
    inside = {(h, x) for x in _between(t, t2, n)} if h == h2 else {(x, LOW) for x in _between(h, h2, n)}
    return inside | {b.low, b.high}


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[Key]:
    """``shards - 1`` keys; shard k takes the rows from boundary k - 1 up to, not including, boundary k.

    The bytes below a boundary differ from the exact share by the tolerance at most, or by less than those of one key.
    """
    total = keys.agg(F.coalesce(F.sum("_s_size"), F.lit(0))).first()[0]
    slack = int(total / shards * tolerance)
    chosen: list[Key] = [(LOW, LOW)] * (shards - 1)
    open_ = {k: Bracket((LOW, LOW), (HIGH, HIGH)) for k in range(shards - 1)} if total else {}
    while open_:
        order = sorted(set().union(*(_probes(b, probes) for b in open_.values())))
        gaps = histogram(keys, order)
        below = list(accumulate(g[0] for g in gaps))
        for k, b in list(open_.items()):
            goal = total * (k + 1) // shards
            at = next((i for i, key in enumerate(order) if key > b.low and below[i] > goal), order.index(b.high))
            _, least, most = gaps[at]
            near = min((goal - below[at - 1], order[at - 1]), (below[at] - goal, order[at]))
            if near[0] <= slack or least == most:
                chosen[k] = near[1]
                del open_[k]
            elif least[0] == most[0]:  # one hash outweighs the tolerance: its rows are cut by id
                open_[k] = Bracket(max(order[at - 1], least), min(order[at], (most[0], most[1] + 1)))
            else:
                open_[k] = Bracket(max(order[at - 1], (least[0], LOW)), min(order[at], (most[0] + 1, LOW)))
    return chosen


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    shard = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        shard = F.when(_below(*bounds[k]), k).otherwise(shard)
    return shard.cast("int")


def split_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with size, shard and slot (gapless from 0 in each shard).

    Slots are numbered in parts of a shard that are small enough for one task; the counts of the parts before give each
    its offset. The rows move once, to their part.
    """
    docs = without(docs, "size", "shard", "slot")
    keyed = docs.withColumns({**order_key(F.col("text"), F.col("doc_id")), "_s_size": size(F.col("text"))})
    keys = stage(keyed.select("_s_hash", "_s_tie", "_s_size"))
    bounds = splitters(keys, shards, tolerance)
    shard = shard_of(bounds)
    parts = max(1, -(-keys.count() // (shards * SLOT_ROWS)))
    part = F.pmod(F.xxhash64("_s_hash", "_s_tie"), F.lit(parts)).cast("int")
    before = Window.partitionBy("shard").orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keys.select(shard.alias("shard"), part.alias("_s_part")).groupBy("shard", "_s_part").agg(F.count(F.lit(1)).alias("_s_n"))
        .withColumn("_s_offset", F.coalesce(F.sum("_s_n").over(before), F.lit(0))).drop("_s_n")
    )
    placed = keyed.withColumns({"shard": shard, "_s_part": part})
    within = Window.partitionBy("shard", "_s_part").orderBy("_s_hash", "_s_tie")
    numbered = placed.withColumn("_s_rank", F.row_number().over(within) - 1)
    out = numbered.join(offsets, ["shard", "_s_part"])
    return out.select(
        *docs.columns, F.col("_s_size").alias("size"), "shard", (F.col("_s_offset") + F.col("_s_rank")).cast("long").alias("slot")
    )
