"""Mixing sources by temperature.

Source token shares are raised to an exponent and normalised. The exponent is found by repeated section: as it falls from
1 to 0 the mixture goes from proportional to uniform, its entropy rises, and so do the repetitions of the small sources.
It is lowered until the entropy reaches a target or a source would be repeated beyond a limit, whichever comes first.

The weights are realised as token budgets. The rows of a source lie in blocks by a hash of their id, and each epoch
permutes the blocks and the rows in them anew. A budget takes whole epochs, then whole blocks in the order of the next
one's permutation, then rows of one last block up to the budget. By default the total is such that every row is used at
least once; a smaller ``total`` leaves out rows of the sources that are over-represented.

Nulls and ties: rows without a source form a source of their own; a null text has no tokens; rows that tie on id and text
go the same way, all of them. Sources without a token are used once and have weight 0. An empty table gives an empty
result. Texts of any length are counted where they are and never shuffled. Other columns travel along; columns named epoch, block or mix_key are replaced, and names that start with _m_ are
reserved.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.llm.common import SPACE_RUN, stage, without

BLOCK_TOKENS = 1_000_000
PROBES = 16
ROUNDS = 6
MAX_REPEAT = 2.0
BROADCAST_SOURCES = 10_000
SEED = 1


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")).cast("long")


def _hash01(*parts: Column) -> Column:
    """A number in [0, 1) with 53 random bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeat: float | None) -> float:
    """Largest exponent in [0, 1] at which the entropy (as a share of its maximum) is reached, but not one so low that a
    source is repeated beyond the limit while every source is used at least once.

    Each round is one pass over the sources for all probes. Entropy of weights w = p^a / Z is log Z - a sum(w log p).
    """
    n, total = sources.where("tokens > 0").agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        probes = [low + (high - low) * k / PROBES for k in range(PROBES + 1)]
        sums = []
        for a in probes:
            sums += [F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")), F.min(F.pow("p", F.lit(1 - a))), F.max(F.pow("p", F.lit(1 - a)))]
        row = shares.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()

        def done(k: int) -> tuple[bool, bool]:
            """(entropy reached, repeated too often): a source is repeated in proportion to p^(a - 1)."""
            z, weighted, least, most = row[4 * k : 4 * k + 4]
            entropy = log(z) - probes[k] * weighted / z
            return target_entropy is not None and entropy >= target_entropy * log(n), max_repeat is not None and most / least > max_repeat

        # Go down from 1; stop at the first probe that reaches the entropy, or before the first that repeats too often.
        at = next((k for k in reversed(range(len(probes))) if any(done(k))), 0)
        reached, often = done(at)
        if at == len(probes) - 1 or not (reached or often):
            return probes[at]
        low, high = probes[at], probes[at + 1]
        if reached and not often:
            best = low
        else:
            best = high
    return best


def budgets(
    sources: DataFrame, target_entropy: float | None = None, max_repeat: float | None = MAX_REPEAT, total: int | None = None
) -> tuple[float, DataFrame]:
    """(exponent, table): per source its share, weight, budget in tokens and repeats."""
    a = find_exponent(sources, target_entropy, max_repeat)
    powered = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(0.0)
    sums = sources.agg(F.sum(powered), F.sum("tokens"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / powered))).first()
    z, all_tokens, stretch = (float(x or 0) for x in sums)
    # Every source is used once when the total is that of the least repeated one.
    wanted = float(total) if total is not None else z * stretch
    weight = powered / F.lit(z or 1.0)
    budget = F.round(weight * wanted).cast("long")
    if total is None:
        budget = F.greatest(budget, F.col("tokens"))  # rounding costs no row
    return a, sources.select(
        "source", "rows", "tokens", (F.col("tokens") / F.lit(all_tokens or 1.0)).alias("share"), weight.alias("weight"),
        F.when(F.col("tokens") > 0, budget).otherwise(F.lit(0).cast("long")).alias("budget"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def make_plan(narrow: DataFrame, block_tokens: int, **targets: float | None) -> DataFrame:
    """One row per source: rows, tokens, share, weight, budget, exponent; whole epochs, blocks, and tokens beyond whole epochs."""
    # A source that holds a third of all rows is summed on every task first.
    sources = stage(narrow.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("_m_tokens").alias("tokens")))
    exponent, table = budgets(sources, **targets)
    used, counted = F.col("tokens") > 0, F.col("epochs") * F.col("tokens")
    return stage(table.withColumns({
        "exponent": F.lit(exponent),
        "epochs": F.when(used, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("long"),
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long"),
    }).withColumn("rest", F.when(used, F.col("budget") - counted).otherwise(F.lit(0)).cast("long")))


def _cuts(placed: DataFrame, block_rank: Column, row_rank: Column, small: bool) -> DataFrame:
    """Per source with a partial epoch: the block in which the budget runs out, and the last row used there.

    Block totals are summed in the order of the permutation; only the rows of one block per source are then ordered.
    """
    totals = placed.where("_m_rest > 0").groupBy("source", "_m_block", "_m_epochs", "_m_rest").agg(F.sum("_m_tokens").alias("_m_sum"))
    before = Window.partitionBy("source").orderBy("_m_rank", "_m_block").rowsBetween(Window.unboundedPreceding, -1)
    running = totals.withColumn("_m_rank", block_rank).withColumn("_m_before", F.coalesce(F.sum("_m_sum").over(before), F.lit(0)))
    last = running.where("_m_before <= _m_rest AND _m_before + _m_sum > _m_rest").select(
        F.col("source").alias("_m_of"), F.col("_m_rank").alias("_m_last_rank"), F.col("_m_block").alias("_m_last"),
        (F.col("_m_rest") - F.col("_m_before")).alias("_m_left"))
    last = stage(last)
    there = F.broadcast(last) if small else last
    inside = placed.join(there, _same("source", "_m_of") & (F.col("_m_block") == F.col("_m_last"))).withColumn("_m_row", row_rank)
    upto = F.sum("_m_tokens").over(Window.partitionBy("source").orderBy("_m_row").rangeBetween(Window.unboundedPreceding, 0))
    fitting = inside.withColumn("_m_upto", upto).where("_m_upto <= _m_left")
    ends = fitting.groupBy(F.col("source").alias("_m_in")).agg(F.max("_m_row").alias("_m_end"))
    return stage(last.join(ends, _same("_m_of", "_m_in"), "left").select(
        "_m_of", "_m_last_rank", "_m_last", F.coalesce("_m_end", F.lit(-1.0)).alias("_m_end")))


def mix(
    docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = MAX_REPEAT, total: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): ``docs`` with epoch, block and mix_key, rows repeated or left out by their source's budget; the plan.

    Ordered by mix_key the sources are interleaved in proportion to their weights. Texts are not shuffled: the decision on
    a row needs its own hash and a few numbers of its source.
    """
    docs = without(docs, "epoch", "block", "mix_key")
    narrow = stage(docs.select("doc_id", "source", F.xxhash64("text").alias("_m_text"), tokens(F.col("text")).alias("_m_tokens")))
    plan = make_plan(narrow, block_tokens, target_entropy=target_entropy, max_repeat=max_repeat, total=total)
    small = plan.count() <= BROADCAST_SOURCES
    numbers = plan.select(
        F.col("source").alias("_m_source"), F.col("epochs").alias("_m_epochs"), F.col("blocks").alias("_m_blocks"), F.col("rest").alias("_m_rest"))
    numbers = F.broadcast(numbers) if small else numbers
    block = F.floor(_hash01(F.lit(SEED), F.col("doc_id"), F.col("_m_text")) * F.col("_m_blocks")).cast("long")
    # Permutations of the blocks of a source and of the rows of a block, one per epoch.
    block_rank = lambda epoch: _hash01(F.lit(SEED), F.col(epoch), F.col("source"), F.col("_m_block"))
    row_rank = lambda epoch: _hash01(F.lit(SEED), F.col(epoch), F.col("doc_id"), F.col("_m_text"))
    placed = narrow.join(numbers, _same("source", "_m_source")).withColumn("_m_block", block)
    cuts = _cuts(placed, block_rank("_m_epochs"), row_rank("_m_epochs"), small)
    cuts = F.broadcast(cuts) if small else cuts
    whole = docs.withColumn("_m_text", F.xxhash64("text")).join(numbers, _same("source", "_m_source")).withColumn("_m_block", block)
    whole = whole.join(cuts, _same("source", "_m_of"), "left").withColumns({
        "_m_rank": block_rank("_m_epochs"), "_m_row": row_rank("_m_epochs")})
    # Of the partial epoch: blocks before the last one, and the head of that.
    extra = F.expr(
        "_m_rest > 0 AND _m_last_rank IS NOT NULL AND ((_m_rank, _m_block) < (_m_last_rank, _m_last)"
        " OR (_m_block = _m_last AND _m_row <= _m_end))"
    )
    times = F.col("_m_epochs") + F.when(extra, 1).otherwise(0)
    used = whole.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    # Where a row stands in its source's run of epochs, stretched to the length of the whole mixture.
    within = (F.floor(block_rank("epoch") * F.col("_m_blocks")) + row_rank("epoch")) / F.col("_m_blocks")
    length = F.col("_m_epochs") + F.when(F.col("_m_last").isNotNull(), 1).otherwise(0)
    rows = used.withColumn("mix_key", (F.col("epoch") + within) / length)
    return rows.select(*docs.columns, "epoch", F.col("_m_block").alias("block"), "mix_key"), plan
