"""Near duplicates by SimHash, compared on bit planes.

Two ways to find which fingerprints meet:

* ``near_duplicates``: radius 3. The 64 bits are cut into five strips; two fingerprints within three bits agree on two
  strips at least, so each is filed under its ten pairs of strips (25 or 26 bits). Exact.
* ``similar_groups``: texts whose shingle sets have a Jaccard similarity of 0.8 or more. Their fingerprints differ in about
  ten of 64 bits, too many for strips. First, texts without a chance go: at least 0.8 of a set must occur in other texts,
  which counting tells exactly. The others are filed under their rarest shingles: in any order that holds for all texts,
  two similar sets share one of their first shingles (prefix filter), and where they first meet, enough of both sets must
  be left (size and position). So no link is missed. Fingerprints only order the candidates, nearest first, and every link
  is checked on the shingle sets.

Inside a file, fingerprints are compared as bit planes (``bitslice``). A large file is cut into chunks, and each pair of
chunks is a task of its own with bounded memory; what leaves a task is a spanning forest or the nearest neighbours,
never all pairs.

Nulls and ties: a null text has no word, and its fingerprint is zero like that of a blank one. Null ids are kept;
a component is named by its least non-null id. Repeated rows stay rows. An empty table gives an empty result. Texts of
any length are read whole. Other columns are not read (``near_duplicates``) or kept (``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.llm import bitslice
from reviewlens.llm.common import bound_batches, release, stage, trimmed
from reviewlens.llm.components import components

SEED = 42
STRIPS = (13, 13, 13, 13, 12)
CHUNK = 2048  # fingerprints of a file that one side of a task holds
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLAB = 1 << 15  # hashes handled at once


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; a shorter text is one run."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.zeros(0, "<u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))).tolist()
    stops = (ends - 1).tolist()
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, stops[words - 1 :])), "<u8", len(parts) - words + 1
    )


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set when it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SLAB):
        part = hashes[k : k + SLAB]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, "<u8").view("<i8"))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), _signed(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def strip_keys(fp: Column) -> Column:
    """The ten keys under which a fingerprint is filed: two of five strips, with the number of the pair above them."""
    strips, low = [], 0
    for width in STRIPS:
        strips.append(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        low += width
    return F.array(*[
        F.lit(n << 26).cast("long").bitwiseOR(F.shiftleft(strips[a], 13)).bitwiseOR(strips[b])
        for n, (a, b) in enumerate(combinations(range(len(STRIPS)), 2))
    ])


def _tasks(filed: DataFrame, chunk: int) -> DataFrame:
    """Rows of ``filed`` (key, node, ...) once per pair of chunks of their file that they belong to, ordered for the workers.

    Files of one row are dropped: they meet nothing.
    """
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    chunks = F.ceil(F.col("_size") / chunk).cast("int")
    return (
        filed.join(sizes, "key")
        .withColumn("_n", chunks)
        .withColumn("_cell", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_lo", F.least("_cell", "_other"))
        .withColumn("_hi", F.greatest("_cell", "_other"))
        .drop("_size", "_n", "_other")
        .repartition("key", "_lo", "_hi")
        .sortWithinPartitions("key", "_lo", "_hi", "_cell")
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, group number, cell) with whole groups only, about ``least`` rows at a time."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool):
        key, lo, hi, cell = (table.column(c).to_numpy() for c in ("key", "_lo", "_hi", "_cell"))
        new = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        end = len(key) if last else int(np.flatnonzero(new)[-1])
        return table.slice(0, end), (np.cumsum(new) - 1)[:end], cell[:end], table.slice(end)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            rows, group, cell, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
            held = rest.to_batches()
            if rows.num_rows:
                yield rows, group, cell
    if sum(b.num_rows for b in held):
        yield cut(pa.Table.from_batches(held).combine_chunks(), True)[:3]


def forest(filed: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges that connect all fingerprints of ``filed`` (key, node = fingerprint) linked within a file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group, cell in _whole_groups(batches):
            node = rows.column("node").to_numpy()
            label = np.arange(len(node))
            for i, j, _ in bitslice.links(node.view("<u8"), group, cell, radius):
                # Fold every piece into the components so far: memory follows the rows, not the links.
                label = bitslice.roots(len(node), np.r_[i, np.arange(len(node))], np.r_[j, label])
            moved = np.flatnonzero(label != np.arange(len(node)))
            yield pa.record_batch([pa.array(node[moved]), pa.array(node[label[moved]])], names=["a", "b"])

    return _tasks(filed, chunk).mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, component_id) of every row; fingerprints of one component are chained by ``radius`` bits or fewer.

    ``component_id`` is the least id reachable. Only radii up to 3 are exact with the strips used here.
    """
    if not 0 <= radius <= 3:
        raise ValueError("strips cover radii from 0 to 3; use similar_groups beyond")
    prints = stage(fingerprints(docs, words))
    distinct = prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least"))
    filed = distinct.select("node", F.explode(strip_keys(F.col("node"))).alias("key"))
    found = components(forest(filed, radius, chunk))
    rooted = distinct.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


# ---- similarity of shingle sets -------------------------------------------------------------------------------------

ORDER_BITS = 20  # counters of shingles, by which the rare ones come first; what shares a counter only costs time
ORDER_FACTOR = np.uint32(0x9E3779B1)
NEAREST = 4  # neighbours asked for in the first round
GROWTH = 8  # and so many times as many in each following one
RANGE_BYTES = 16 << 20  # characters of texts per range of shingle hashes; one task counts one range at a time
HELD_SHINGLES = 1 << 20  # shingles a task packs at once
CLOSE_ROWS, CLOSE_BLOCKS = 1 << 14, 1 << 12  # rows and blocks of 64 compared at once where no radius thins out the links
FEW = 500_000  # texts that are looked up by a broadcast at most


def _packed(rows: list[int], sets: list[np.ndarray], ranges: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(range, shingles, rows, shingles per row): the sets dealt out by hash; 32 bits tell shingles of a range apart."""
    every = np.concatenate(sets)
    owner = np.repeat(np.array(rows, "<i8"), [len(x) for x in sets])
    at = (every >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    order = np.argsort(at.astype(np.uint16 if ranges <= 1 << 16 else np.int64), kind="stable")
    at, low, owner = at[order], every[order].astype("<u4"), owner[order]
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    for x, y in zip(cuts, np.r_[cuts[1:], len(at)]):
        runs = np.flatnonzero(np.r_[True, owner[x + 1 : y] != owner[x : y - 1]])
        yield int(at[x]), low[x:y].tobytes(), owner[x:y][runs].tobytes(), np.diff(np.r_[runs, y - x]).astype("<u4").tobytes()


TEXT_ROW = ["row", "doc_id", "_text", "_node", "size"]
PACKED = ["block", "range", "keys", "owners", "counts"]


def _dealt(docs: DataFrame, words: int, ranges: int) -> DataFrame:
    """One row per text (``TEXT_ROW``), and rows of packed shingles (``PACKED``). A block is named by its first row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        sets: list[np.ndarray] = []
        held, types = 0, None

        def block() -> pa.RecordBatch:
            at, *packed = zip(*_packed(rows, sets, ranges))
            blank = [pa.nulls(len(at), t) for t in types]
            name = pa.array(np.full(len(at), rows[0], np.int64))
            return pa.record_batch([*blank, name, pa.array(at, pa.int32()), *[pa.array(c, pa.binary()) for c in packed]], names=TEXT_ROW + PACKED)

        for batch in batches:
            types = [pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32()]
            nodes, sizes = [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                own = np.unique(shingle_hashes(text.as_py(), words))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                if len(own):
                    rows.append(row)
                    sets.append(own)
                    held += len(own)
                if held >= HELD_SHINGLES:
                    yield block()
                    rows, sets, held = [], [], 0
            n = batch.num_rows
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), batch.column("_text"), _signed(nodes), pa.array(sizes, pa.int32()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3], names=TEXT_ROW + PACKED)
        if sets:
            yield block()

    numbered = bound_batches(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("_text"))
    return numbered.mapInArrow(
        trimmed(work), f"row long, doc_id {kind}, _text long, _node long, size int, block long, range int, keys binary, owners binary, counts binary")


def _shared_in(blocks: list[list]) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, rows, numbers): for every block of a range, how many of its rows' shingles another row has as well."""
    key = np.frombuffer(b"".join(b[1] for b in blocks), "<u4")
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    shared = np.zeros(len(key), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    at = 0
    for block, keys, owners, counts in blocks:
        n = len(keys) // 4
        runs = np.frombuffer(counts, "<u4")
        found = np.add.reduceat(shared[at : at + n], np.r_[0, np.cumsum(runs, dtype=np.int64)[:-1]], dtype=np.int64)
        some = found > 0
        yield block, np.frombuffer(owners, "<i8")[some].tobytes(), found[some].astype("<u4").tobytes()
        at += n


def shared_counts(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, _text, _node, size, shared) of every row: size of its shingle set, and how many of it another row has too.

    Each task deals the shingles of blocks of texts out to ranges of hash values, packed as bare numbers, in one shuffle. A
    range has a bounded number of shingles, but for those that many rows share, of which it gets one per row. What it counts
    goes back as one packed row per block and is added up there. 32 bits and the range tell shingles apart, so ``shared``
    can be too high by chance, never too low.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    ranges = max(1, -(-total // RANGE_BYTES))
    dealt = _dealt(docs, words, ranges)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*TEXT_ROW, "block", "owners", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            block, owners, counts = zip(*_shared_in(held))
            return pa.record_batch([*[pa.nulls(len(block), t) for t in types], pa.array(block, pa.int64()), pa.array(owners, pa.binary()),
                                    pa.array(counts, pa.binary())], names=names)

        for batch in batches:
            types = [batch.schema.field(c).type for c in TEXT_ROW]
            plain = pa.compute.is_null(batch.column("range"))
            texts = batch.filter(plain)
            if n := texts.num_rows:
                yield pa.record_batch([*[texts.column(c) for c in TEXT_ROW], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                                      names=names)
            packed = batch.filter(pa.compute.invert(plain))
            for at, *block in zip(*(packed.column(c).to_pylist() for c in ("range", "block", "keys", "owners", "counts"))):
                if at != now and held:
                    yield done()
                    held = []
                now = at
                held.append(block)
        if held:
            yield done()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, parts in groupby(rows, key=lambda r: r[0]):
            _, owners, counts = zip(*parts)
            once, at = np.unique(np.frombuffer(b"".join(owners), "<i8"), return_inverse=True)
            total = np.bincount(at, np.frombuffer(b"".join(counts), "<u4"), len(once))
            yield pa.record_batch([pa.array(once), pa.array(total.astype(np.int64))], names=["row", "shared"])

    sent = dealt.repartition(F.coalesce(F.col("range").cast("long"), F.col("row"))).sortWithinPartitions("range")
    counted = stage(sent.mapInArrow(
        trimmed(count), f"row long, doc_id {kind}, _text long, _node long, size int, block long, owners binary, counts binary"))
    back = counted.where("block IS NOT NULL").select("block", "owners", "counts").repartition("block").sortWithinPartitions("block")
    found = back.mapInArrow(trimmed(add), "row long, shared long")
    texts = counted.where("block IS NULL").select(*TEXT_ROW)
    out = texts.join(found, "row", "left").select("doc_id", "_text", "_node", "size", F.coalesce("shared", F.lit(0)).alias("shared"))
    out._stage_path = counted._stage_path  # released with the result
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row doc_id, _text (hash of the text), _node (hash of its shingle set), _fp and _set.

    ``_set`` holds the shingle set with 32 bits per shingle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _text long, _node long, _fp long, _set array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sets = [], [], []
            for t in batch.column("text"):
                own = np.unique(shingle_hashes(t.as_py(), words))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fps.append(fingerprint(own))
                sets.append(np.unique(own.astype("<u4")).view("<i4"))
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype("i4"))
            values = pa.array(np.concatenate(sets) if sets else np.zeros(0, "<i4"))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("_text"), _signed(nodes), _signed(fps), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "_text", "_node", "_fp", "_set"],
            )

    return bound_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("_text")).mapInArrow(trimmed(work), schema)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return shingles.view("<u4") * ORDER_FACTOR >> np.uint32(32 - ORDER_BITS)


def frequencies(rows: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall on each of a fixed number of counters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_counter(batch.column("_set").flatten().to_numpy()), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["counter", "n"])

    found = rows.select("_set").mapInArrow(trimmed(work), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << ORDER_BITS, np.int32)
    out[found["counter"].to_numpy()] = np.minimum(found["n"].to_numpy(), np.iinfo(np.int32).max)
    return out


def prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set in order, as many that two sets of the similarity share one of them."""
    n = len(shingles)
    first = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    return shingles[np.lexsort((shingles, counts[_counter(shingles)]))[:first]]


def prefixes(rows: DataFrame, similarity: float) -> DataFrame:
    """(node, fp, size, keys) of all sets but empty ones; ``keys`` is the prefix of the set, in order."""
    shared = rows.sparkSession.sparkContext.broadcast(frequencies(rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [prefix(s.values.to_numpy(), shared.value, similarity) for s in batch.column("_set")]
            offsets = pa.array(np.r_[0, np.cumsum([len(k) for k in keys])].astype("i4"))
            values = pa.array(np.concatenate(keys) if keys else np.zeros(0, "<i4"))
            yield pa.record_batch([batch.column("_node"), batch.column("_fp"), batch.column("size"), pa.ListArray.from_arrays(offsets, values)],
                                  names=["node", "fp", "size", "keys"])

    return rows.where(F.size("_set") > 0).select("_node", "_fp", F.size("_set").alias("size"), "_set").mapInArrow(
        trimmed(work), "node long, fp long, size int, keys array<int>")


def nearest(filed: DataFrame, radius: int, k: int, similarity: float, chunk: int) -> DataFrame:
    """(node, other, d): for every active node the ``k`` nearest others of another component beyond its floor, per task.

    ``filed`` has key, node, fp, size, place, label, active, floor_d, floor_node. Order is by distance, then node. Sets whose
    sizes differ too much for the similarity are passed over, and so are those that could not share enough shingles if
    this one, at ``place`` of each set's order, were the first they share; where it is not, they have met before.
    """
    share = similarity / (1 + similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group, cell in _whole_groups(batches, CLOSE_ROWS):
            col = {c: rows.column(c).to_numpy() for c in ("node", "fp", "size", "place", "label", "active", "floor_d", "floor_node")}
            left = col["size"] - col["place"]
            best: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
            for i, j, d in bitslice.links(col["fp"].view("<u8"), group, cell, radius, CLOSE_BLOCKS):
                fits = np.minimum(col["size"][i], col["size"][j]) >= similarity * np.maximum(col["size"][i], col["size"][j])
                fits &= col["label"][i] != col["label"][j]
                fits &= np.minimum(left[i], left[j]) >= share * (col["size"][i] + col["size"][j]) - 1e-9
                i, j, d = i[fits], j[fits], d[fits]
                i, j, d = np.r_[i, j], np.r_[j, i], np.r_[d, d]
                other = col["node"][j]
                late = (d > col["floor_d"][i]) | ((d == col["floor_d"][i]) & (other > col["floor_node"][i]))
                keep = late & col["active"][i]
                a, b, d = (np.r_[x, y] for x, y in zip(best, (i[keep], other[keep], d[keep])))
                order = np.lexsort((b, d, a))
                a, b, d = a[order], b[order], d[order]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
                rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
                best = [x[rank < k] for x in (a, b, d)]
            yield pa.record_batch([pa.array(col["node"][best[0]]), pa.array(best[1]), pa.array(best[2])], names=["node", "other", "d"])

    return _tasks(filed, chunk).mapInArrow(trimmed(work), "node long, other long, d long")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): doc_id, _text and _node (hash of the shingle set) of ``docs``, and (node, root) of the nodes that have
    a similar one.

    Texts of one group are chained by Jaccard similarities of ``similarity`` or more of their sets of ``words``-word
    shingles. Rounds ask each text for its nearest candidates outside its component, beyond those asked before, and check
    them on the sets; the number per round grows, and a text is done when it has no candidate left. So all
    candidates that could still connect two components are checked. A blank text has an empty set and no group.
    """
    sizes = shared_counts(docs, words)
    counted = stage(sizes)
    release(sizes)
    open_texts = stage(counted.where((F.col("size") > 0) & (F.col("shared") >= similarity * F.col("size") - 1e-9)).select(
        F.col("_text").alias("_open")).distinct())
    few = open_texts.count() <= FEW
    chosen = docs.select("doc_id", "text").join(
        F.broadcast(open_texts) if few else open_texts, F.xxhash64("text") == F.col("_open"), "left_semi")
    every = stage(sketches(chosen, words))
    rows = stage(every.groupBy("_node").agg(F.first("_fp").alias("_fp"), F.first("_set").alias("_set")))
    release(open_texts, every)
    once = stage(prefixes(rows, similarity))
    filed = once.select("node", "fp", "size", F.posexplode(F.col("keys").cast("array<long>")).alias("place", "key"))
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select("key")
    filed = stage(filed.join(shared, "key"))
    release(once)
    state = filed.select("node").distinct().select(
        "node", F.col("node").alias("label"), F.lit(True).alias("active"), F.lit(-1).cast("long").alias("floor_d"),
        F.lit(0).cast("long").alias("floor_node"))
    links, k = None, NEAREST
    while True:
        here = filed.join(state, "node")
        # Only files with an open text that has company of another component need another look.
        open_files = here.groupBy("key").agg(F.max("active").alias("_open"), (F.min("label") != F.max("label")).alias("_mixed"))
        here = here.join(open_files.where("_open AND _mixed").select("key"), "key")
        ranked = F.row_number().over(Window.partitionBy("node").orderBy("d", "other"))
        asked = stage(nearest(here, 64, k, similarity, chunk).distinct().withColumn("_rank", ranked).where(F.col("_rank") <= k))
        pairs = asked.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        involved = pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b").alias("_node"))).distinct()
        sets = stage(rows.join(involved, "_node").select("_node", F.col("_set").alias("s")))
        common = F.size(F.array_intersect("sa", "sb"))
        good = (
            pairs.join(sets.select(F.col("_node").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("_node").alias("b"), F.col("s").alias("sb")), "b")
            .where(common >= similarity * (F.size("sa") + F.size("sb") - common))
            .select("a", "b")
        )
        before, links = links, stage(good if links is None else links.union(good))
        release(before, sets)
        groups = components(links)
        last = asked.groupBy("node").agg(
            F.count(F.lit(1)).alias("_n"), F.max(F.struct("d", "other")).alias("_last"))
        before, state = state, stage(
            state.where("active").join(last.where(F.col("_n") == k), "node", "left")
            .select("node", F.col("_n").isNotNull().alias("active"), F.coalesce("_last.d", "floor_d").alias("floor_d"),
                    F.coalesce("_last.other", "floor_node").alias("floor_node"))
            .union(state.where("NOT active").select("node", "active", "floor_d", "floor_node"))
            .join(groups, "node", "left")
            .select("node", F.coalesce("root", "node").alias("label"), "active", "floor_d", "floor_node")
        )
        release(before, asked)
        if state.where("active").isEmpty():
            release(filed, links, state, rows)
            return counted, groups
        k *= GROWTH


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of every group of similar texts: that with the least doc_id (nulls last).

    Texts with equal shingle sets are one group; so are all blank and null texts. Of rows that tie on the id, one stays. Column names that start with _k_ are
    reserved.
    """
    rows, groups = similar_groups(docs, words, similarity)
    nodes = rows.select("doc_id", "_text", "_node").join(groups.select(F.col("node").alias("_node"), "root"), "_node", "left").select(
        "doc_id", "_text", F.coalesce("root", "_node").alias("_g"))
    # Equal rows are one here: how many of them there are, and whether they are the ones of their group that stay.
    once = nodes.groupBy("doc_id", "_text").agg(F.max("_g").alias("_g"), F.count(F.lit(1)).alias("_n"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text")
    least = once.groupBy("_g").agg(F.min(place).alias("_least"), F.sum("_n").alias("_all")).where("_all > 1").drop("_all")
    stays = (F.col("_least._text") == F.col("_text")) & F.col("_least.doc_id").eqNullSafe(F.col("doc_id"))
    touched = stage(once.join(least, "_g").where(~stays | (F.col("_n") > 1)).select(
        F.col("doc_id").alias("_k_id"), F.col("_text").alias("_k_hash"), stays.alias("_k_stays")))
    marked = docs.withColumn("_k_own", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_k_id")) & (F.col("_k_own") == F.col("_k_hash"))
    few = touched.count() <= FEW
    keys = lambda df: F.broadcast(df) if few else df
    alone = marked.join(keys(touched), same, "left_anti")
    repeated = touched.where("_k_stays")
    if repeated.isEmpty():
        return alone.select(*docs.columns)
    first = F.row_number().over(Window.partitionBy("_k_own", "doc_id").orderBy("_k_hash"))
    one = marked.join(keys(repeated), same).withColumn("_k_once", first).where("_k_once = 1")
    return alone.select(*docs.columns).unionAll(one.select(*docs.columns))
