"""Hamming distances of many fingerprints at once, on bit planes.

A cell of 64 fingerprints becomes 64 machine words, one per bit position; comparing one fingerprint with the 64 of a cell
is one exclusive-or per position. The distances grow in bit-sliced counters fed by carry-save adders, and a (fingerprint,
cell) block leaves the computation as soon as all of its 64 distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
CHECK_EVERY = 12  # bit positions between two looks at which blocks can be abandoned


def planes_of(padded: np.ndarray) -> np.ndarray:
    """64 x (len / 64) words: bit j of word w in row b is bit b of ``padded[64 w + j]``."""
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above ``radius``."""
    above, equal = over.copy(), np.full_like(over, ALL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    return above


def close_pairs(padded: np.ndarray, planes: np.ndarray, lanes: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int):
    """(i, j, distance) of all i in ``q`` against the 64 lanes of the word beside it in ``w``, within ``radius``.

    ``padded`` holds the fingerprints, cells filled up to 64, ``planes`` their bits; ``lanes`` marks the real ones.
    """
    counters = [np.zeros(len(q), "<u8") for _ in range(radius.bit_length())]
    over = ~lanes[w]

    def add(x: np.ndarray, level: int) -> None:
        for i in range(level, len(counters)):
            counters[i], x = counters[i] ^ x, counters[i] & x
        np.bitwise_or(over, x, out=over)

    for b in range(0, 64, 3):
        diff = []
        for p in range(b, min(b + 3, 64)):
            own = (padded[q] >> np.uint64(p) & np.uint64(1)) * ALL
            diff.append(planes[p][w] ^ own)
        if len(diff) == 3:
            x, y, z = diff
            half = x ^ y
            add(half ^ z, 0)
            add(x & y | half & z, 1)
        else:
            for x in diff:
                add(x, 0)
        if b % CHECK_EVERY == CHECK_EVERY - 3:
            alive = _exceeds(counters, over, radius) != ALL
            if not alive.all():
                q, w, over = q[alive], w[alive], over[alive]
                counters = [c[alive] for c in counters]
            if not len(q):
                break
    hit = ~_exceeds(counters, over, radius)
    at = np.flatnonzero(hit)
    row, lane = np.nonzero(np.unpackbits(hit[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    row = at[row]
    distance = np.zeros(len(row), np.int64)
    for i, c in enumerate(counters):
        distance |= (c[row] >> lane.astype("<u8") & np.uint64(1)).astype(np.int64) << i
    return q[row], w[row] * 64 + lane, distance


def layout(fps: np.ndarray, group: np.ndarray, cell: np.ndarray):
    """Pad every cell to a multiple of 64 and list the blocks to compare.

    Rows come sorted by (group, cell). A group of one cell is compared within itself, a group of two across.
    Returns (padded, valid, place of each row, q, w).
    """
    n = len(fps)
    new_group = np.r_[True, group[1:] != group[:-1]]
    new_cell = new_group | np.r_[True, cell[1:] != cell[:-1]]
    starts = np.flatnonzero(new_cell)
    sizes = np.diff(np.r_[starts, n])
    cell_words = -(-sizes // 64)
    base = np.r_[0, np.cumsum(cell_words)[:-1]]
    own = np.cumsum(new_cell) - 1
    place = base[own] * 64 + np.arange(n) - starts[own]
    padded = np.zeros(int(cell_words.sum()) * 64, "<u8")
    valid = np.zeros(len(padded), np.uint8)
    padded[place], valid[place] = fps, 1
    group_of = np.cumsum(new_group[starts]) - 1
    cells_in = np.bincount(group_of)
    first = np.r_[0, np.cumsum(cells_in)[:-1]]
    # The cell that each row is compared with: its own when it is alone, the second one for rows of the first.
    target = np.where(cells_in[group_of] == 1, np.arange(len(starts)), np.where(np.arange(len(starts)) == first[group_of], first[group_of] + 1, -1))
    other = target[own]
    rows = np.flatnonzero(other >= 0)
    count = cell_words[other[rows]]
    q = np.repeat(place[rows], count)
    ends = np.cumsum(count)
    w = np.arange(len(q)) - np.repeat(ends - count, count) + np.repeat(base[other[rows]], count)
    # Within one cell every pair is met once: words before that of the row are left out, equal words are cut by order.
    keep = (other[rows] != own[rows]).repeat(count) | (w >= q // 64)
    return padded, valid, place, q[keep], w[keep]


def links(fps: np.ndarray, group: np.ndarray, cell: np.ndarray, radius: int, most: int = 1 << 14) -> Iterator[tuple]:
    """(i, j, distance), i and j row numbers, in pieces of ``most`` blocks, so at most 64 times as many links at once."""
    padded, valid, place, q, w = layout(fps, group, cell)
    planes, lanes = planes_of(padded), np.packbits(valid, bitorder="little").view("<u8")
    back = np.empty(len(padded), np.int64)
    back[place] = np.arange(len(fps))
    for k in range(0, len(q), most):
        i, j, d = close_pairs(padded, planes, lanes, q[k : k + most], w[k : k + most], radius)
        i, j = back[i], back[j]
        keep = (cell[i] != cell[j]) | (i < j)
        yield i[keep], j[keep], d[keep]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row number of the component of each of ``n`` rows."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            return label
