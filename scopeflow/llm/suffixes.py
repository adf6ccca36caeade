"""Suffix sorting one bucket at a time, with a difference cover for long ties.

``sort_suffixes`` orders the given suffixes of a text by their first ``depth`` bytes. Suffixes are dealt into buckets by their leading
bytes and one bucket is sorted at a time, by the first V bytes. Suffixes that tie on those are compared by ranks, computed
beforehand, of a sample: the places whose residue modulo V lies in a difference cover. For any two places i and j some shift below V
takes both into the sample, so one look at two ranks settles a tie, however long it is. Memory: the sample's ranks and one bucket.
"""

from __future__ import annotations

import numpy as np

V = 31
#: A perfect difference set, every residue modulo 31 is a difference of two of these.
COVER = (0, 1, 3, 8, 12, 18)
BUCKET = 1 << 18  # suffixes that are sorted at a time, unless more share their first 8 bytes
_COVER = np.zeros(V, bool)
_COVER[list(COVER)] = True
#: SHIFT[a, b]: the least shift that takes residues a and b into the cover.
SHIFT = np.array([[next(s for s in range(V) if _COVER[(a + s) % V] and _COVER[(b + s) % V]) for b in range(V)] for a in range(V)], np.int64)


class Text:
    """A text padded with zero bytes, read as big-endian words of 8 bytes at any place."""

    def __init__(self, data: np.ndarray, depth: int):
        self.n = len(data)
        self.data = np.concatenate([data, np.zeros(depth + 3 * V + 16, np.uint8)])

    def words(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | self.data[at + k]
        return out

    def head(self, at: np.ndarray) -> list[np.ndarray]:
        """The first V bytes of each suffix as words, in order of weight."""
        return [self.words(at), self.words(at + 8), self.words(at + 16), self.words(at + V - 8)]


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each item) by several keys, the weightiest first; equal items share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def cover_ranks(text: Text, depth: int) -> np.ndarray:
    """Ranks of the sample's suffixes by their first ``depth`` bytes at least, at their places (0 elsewhere)."""
    full = np.arange(text.n + depth + V)
    places = full[_COVER[full % V]]
    rank = np.zeros(text.n + depth + 3 * V, np.int64)
    _, own = _dense(text.head(places))
    rank[places] = own + 1
    if depth > V:
        _, own = _dense([rank[places], rank[places + V]])
        rank[places] = own + 1
    return rank


def _settle(group: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """An order of suffixes that keeps groups together and sorts each by cover ranks: quicksort of all groups side by side.

    ``group`` is non-decreasing; suffixes of one group agree on V bytes.
    """
    order = np.arange(len(at))
    group = group.copy()
    while True:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, len(group)])
        if not len(group) or sizes.max() <= 1:
            return order
        pivot = np.repeat(order[first + sizes // 2], sizes)
        p, q = at[order], at[pivot]
        shift = SHIFT[p % V, q % V]
        side = np.sign(rank[p + shift] - rank[q + shift])
        side = np.where(side == 0, np.sign(p - q), side)  # equal to beyond the depth: by place
        key = group * 3 + side + 1
        again = np.argsort(key, kind="stable")
        order, key = order[again], key[again]
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])


def sort_suffixes(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): an order of ``starts`` by the first ``depth`` bytes, and for each start, in that order, the number of its class of
    suffixes that agree on these. V < depth <= 2 * V. Ends of texts inside ``data`` are the caller's: no start may be nearer than depth to one.
    """
    if not V < depth <= 2 * V:
        raise ValueError(f"depth is to be over {V} and up to {2 * V}")
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = Text(data, depth)
    rank = cover_ranks(text, depth)
    lead = text.words(starts)
    by_lead = np.argsort(lead, kind="stable")
    ordered = lead[by_lead]
    orders, a = [], 0
    while a < len(starts):
        b = min(a + BUCKET, len(starts))
        b = int(np.searchsorted(ordered, ordered[b - 1], "right"))  # the whole of a leading word
        bucket = by_lead[a:b]
        own, same = _dense(text.head(starts[bucket]))
        bucket, same = bucket[own], same[own]
        tied = np.zeros(len(bucket), bool)
        tied[1:] = same[1:] == same[:-1]
        tied[:-1] |= tied[1:]
        where = np.flatnonzero(tied)
        bucket[where] = bucket[where][_settle(same[where], starts[bucket[where]], rank)]
        orders.append(bucket)
        a = b
    order = np.concatenate(orders)
    at = starts[order]
    new = np.zeros(len(at), bool)
    new[0] = True
    for word in (0, 8, 16, V - 8, V, V + 8, depth - 8):
        if word + 8 <= depth:
            w = text.words(at + word)
            new[1:] |= w[1:] != w[:-1]
    return order, np.cumsum(new) - 1
