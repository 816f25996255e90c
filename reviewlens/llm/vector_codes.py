"""Vector code compression: product codes learnt by Lloyd rounds whose members stay where they are.

Vectors are cut into parts; every part position has a codebook of its own. The members of an entry live in the partitions
of its owners, keyed by (position, entry, salt); the salt spreads an entry that holds a great share of all parts. In a round
the owners sum their resident members (one small row per entry leaves a task), the driver forms the new entries, and every
owner assigns its members anew. Only parts whose entry changes go through the next shuffle, to their new owners; the others
are written where they are. Every round rests on the written state of the one before, so a lost executor costs one round.

All arithmetic is in whole numbers: results depend on neither partitioning nor the order of rows. Components are floors of
4096 times the value; beyond +-4096 they count as +-4096, so that squared distances stay exact in 64 bits.

Nulls and ties: a vector that is null or holds null or non-finite components is dropped, as is one whose length is not that
of the first vector by id (ids of null come last). Lengths that the number of parts does not divide are filled up with
zeros. A codebook starts from the smallest distinct ids, of equal ids the least vector; there are fewer entries where there
are fewer ids. Equal distances go to the lower entry. Repeated rows are rows of their own, null labels are one label, other
columns are not read, and an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.llm.common import release, stage

SCALE, LIMIT = 4096, 1 << 24
PARTS, ENTRIES, ROUNDS = 8, 16, 6
OWNED = 1 << 16  # members that an owner of an entry has on average, at most
STATE = "row long, position int, entry int, part array<int>, moved boolean"


def whole(value: Column) -> Column:
    scaled = value.cast("double") * SCALE
    return F.floor(F.greatest(F.least(scaled, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")


def usable(vector: Column) -> Column:
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, wrong), F.lit(True))


def nearest(members: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row of ``members``; the lower entry on a tie."""
    entry = np.zeros(len(members), np.int32)
    least = np.full(len(members), np.iinfo(np.int64).max)
    for e, centre in enumerate(book):
        gap = members - centre
        distance = np.einsum("ij,ij->i", gap, gap)
        closer = distance < least
        entry[closer], least[closer] = e, distance[closer]
    return entry, least


def _matrix(parts: pa.Array, width: int) -> np.ndarray:
    return parts.flatten().to_numpy().astype(np.int64).reshape(len(parts), width)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.astype(np.int32).ravel()))


def _first_state(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """All parts with their first entry, in the layout of the rounds."""
    positions, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("vector"), positions * width)
            for p in range(positions):
                own = values[:, p * width : (p + 1) * width]
                entry, _ = nearest(own, books[p])
                n = len(own)
                yield pa.record_batch(
                    [batch.column("row"), pa.array(np.full(n, p, np.int32)), pa.array(entry), _lists(own), pa.array(np.ones(n, bool))],
                    names=["row", "position", "entry", "part", "moved"])

    return vectors.select("row", "vector").mapInArrow(work, STATE)


def _assigned(members: DataFrame, books: np.ndarray, final: bool) -> DataFrame:
    """Resident ``members`` with the nearest entry of the new books; ``final`` gives distances instead of parts."""
    positions, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("part"), width)
            position, old = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            entry, distance = np.zeros(len(old), np.int32), np.zeros(len(old), np.int64)
            for p in range(positions):
                own = np.flatnonzero(position == p)
                if len(own):
                    entry[own], distance[own] = nearest(values[own], books[p])
            if final:
                yield pa.record_batch([batch.column("row"), batch.column("position"), pa.array(entry), pa.array(distance)],
                                      names=["row", "position", "entry", "distance"])
            else:
                yield pa.record_batch([batch.column("row"), batch.column("position"), pa.array(entry), batch.column("part"), pa.array(entry != old)],
                                      names=["row", "position", "entry", "part", "moved"])

    kept = members.select("row", "position", "entry", "part")
    return kept.mapInArrow(work, "row long, position int, entry int, distance long" if final else STATE)


def _to_owners(movers: DataFrame, salts: int) -> DataFrame:
    """The one shuffle of a round: parts that changed their entry go to an owner of the new one."""
    return movers.repartition("position", "entry", F.pmod(F.xxhash64("row"), F.lit(salts)))


def _updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries moved to the floor of the mean of their members; entries without members stay."""
    width = books.shape[2]
    sums = members.groupBy("position", "entry").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("part", F.lit(i)).cast("long")) for i in range(width)]).alias("sums"))
    new = books.copy()
    for r in sums.collect():  # one row per entry
        new[r.position, r.entry] = [s // r.n for s in r.sums]
    return new


class Codes:
    """``vectors`` (row, id and label columns), ``codes`` (row, code, error) and the final ``books``."""

    def __init__(self, vectors: DataFrame, codes: DataFrame, books: np.ndarray):
        self.vectors, self.codes, self.books = vectors, codes, books

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def learn_codes(
    rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id", keep: tuple[str, ...] = (), parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, owned: int = OWNED,
) -> Codes:
    """Product codes of the usable vectors of ``rows``: one entry, two hexadecimal digits, for every part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    good = rows.where(usable(F.col(vector))).select(F.col(id_column), *keep, F.transform(vector, whole).alias("vector"))
    first = good.orderBy(F.asc_nulls_last(id_column), "vector").limit(1).select(F.size("vector").alias("n")).collect()
    length = first[0].n if first else 0
    width = -(-length // parts)
    filled = F.concat("vector", F.array_repeat(F.lit(0), parts * width - length)) if parts * width > length else F.col("vector")
    good = good.where(F.size("vector") == length).select(
        F.monotonically_increasing_id().alias("row"), id_column, *keep, filled.alias("vector"))
    vectors = stage(good)
    smallest = vectors.groupBy(id_column).agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last(id_column)).limit(entries)
    start = [r.vector for r in smallest.collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    if not start:
        return Codes(vectors, vectors.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books)

    salts = max(1, -(-vectors.count() // owned))
    members = stage(_to_owners(_first_state(vectors, books), salts))
    held = [members]
    for _ in range(rounds - 1):
        books = _updated(members, books)
        assigned = stage(_assigned(members, books, False))
        arrived = stage(_to_owners(assigned.where("moved"), salts))
        release(*held)
        members, held = assigned.where("NOT moved").unionByName(arrived), [assigned, arrived]
    if rounds:
        books = _updated(members, books)
    found = _assigned(members, books, True)
    digits = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0")))
    codes = stage(found.groupBy("row").agg(F.array_join(digits, "").alias("code"), F.sum("distance").alias("error")))
    release(*held)
    return Codes(vectors, codes, books)


def label_errors(learnt: Codes, id_column: str = "vec_id", label: str = "label") -> DataFrame:
    """(id, code, error, label_error) of every coded vector; the error of a label is the sum over its rows."""
    coded = learnt.vectors.select("row", id_column, label).join(learnt.codes, "row").select(id_column, label, "code", "error")
    total = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col(label).eqNullSafe(F.col("_label"))).select(id_column, "code", "error", "label_error")
