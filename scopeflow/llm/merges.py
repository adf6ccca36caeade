"""Numbers of tokens of many short byte-level pre-tokens at once: byte-pair merging on arrays.

As the library does, the leftmost pair of least rank is merged until no pair has a rank; here, one pair of every piece that still has one at a
time. Results are kept in a table of SLOTS pieces, one a slot, compared by their bytes; a piece that is not there is merged anew.
"""

from __future__ import annotations

import json

import numpy as np

from scopeflow.llm import textkit as tk

LONGEST = 15  # bytes of a piece
SLOTS = 1 << 20
MERGED = 1 << 14  # pieces that are merged at a time
_ABSENT, _NEVER = 0xFFFF, 1 << 26


class Merger:
    def __init__(self, byte_ids: list[int], pairs: list[tuple[int, int, int]]):
        """``byte_ids``: the id of each byte. ``pairs``: (left id, right id, id of both), in order of rank. Ids are below 65535."""
        self.byte_ids = np.array(byte_ids, np.uint32)
        left, right, self.made = np.array(pairs, np.uint32).reshape(-1, 3).T.copy()
        # Pairs lie in a table of four slots a pair or more, each at its hash or in the next free slot.
        self.shift = np.uint32(32 - max(4, (4 * len(left)).bit_length()))
        self.keys = np.full((1 << 32 - int(self.shift)) + len(left) + 1, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(len(self.keys), _NEVER, np.int32)
        key, rank = left << np.uint32(16) | right, np.arange(len(left), dtype=np.int32)
        key, first = np.unique(key, return_index=True)
        rank, at = rank[first], self._slot(key)
        while len(key):
            free = self.keys[at] == 0xFFFFFFFF
            self.keys[at[free]] = key[free]
            own = self.keys[at] == key
            self.ranks[at[own]] = rank[own]
            key, rank, at = key[~own], rank[~own], at[~own] + 1
        self.a, self.b = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.size_n = np.zeros(SLOTS, np.uint8)  # size << 4 | number of tokens

    @classmethod
    def of(cls, path: str, alphabet: dict[str, int]) -> Merger | None:
        """That of a tokenizer's file, if its model has plain merges of bytes only."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, options = model["vocab"], ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(x) for x in options) or max(vocab.values()) >= _ABSENT or not alphabet.keys() <= vocab.keys():
            return None
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        return cls([vocab[c] for c in sorted(alphabet, key=alphabet.get)], [(vocab[x], vocab[y], vocab[x + y]) for x, y in pairs])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1) >> self.shift).astype(np.intp)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or _NEVER."""
        key = left << np.uint32(16) | right
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.ranks[at], np.int32(_NEVER))
        left = np.nonzero((got != key) & (got != 0xFFFFFFFF))
        key, at = key[left], at[left]
        while len(key):
            at = at + 1
            got = self.keys[at]
            same = got == key
            out[tuple(x[same] for x in left)] = self.ranks[at[same]]
            more = ~same & (got != 0xFFFFFFFF)
            left, key, at = tuple(x[more] for x in left), key[more], at[more]
        return out

    def merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece, of 1 to LONGEST bytes."""
        out = size.copy()
        which = np.arange(len(start))
        width = int(size.max(initial=0))
        place = np.arange(width)[:, None]
        ids = np.where(place < size, self.byte_ids[data[np.minimum(start + place, len(data) - 1)]], np.uint32(_ABSENT))
        ranks = self.rank(ids[:-1], ids[1:])
        place = place.astype(np.int32)
        for width in range(width - 1, 0, -1):  # pairs of the longest piece that still has a rank
            best = (ranks << 4 | place[:width]).min(axis=0)
            go = np.flatnonzero(best < _NEVER << 4)
            if not len(go):
                break
            if len(go) < len(best):
                best, ids, ranks, which = best[go], ids[:, go], ranks[:, go], which[go]
            out[which] -= 1
            at, own = best & 15, np.arange(len(best))
            new = self.made[best >> 4]
            stays = place[:width] <= at
            ids = np.where(stays, ids[:-1], ids[1:])
            ids[at, own] = new
            ranks = np.where(stays[:-1], ranks[:-1], ranks[1:])
            after = np.flatnonzero(at < width - 1)
            ranks[at[after], after] = self.rank(new[after], ids[at[after] + 1, after])
            before = np.flatnonzero(at > 0)
            ranks[at[before] - 1, before] = self.rank(ids[at[before] - 1, before], new[before])
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same, by the table where it has the piece."""
        words = tk.words64(data)
        bits = (np.minimum(size, 8) << 3).astype(np.uint64)
        a = words[start] & (~np.uint64(0) >> (np.uint64(64) - bits))
        b = words[start + np.maximum(size - 8, 0)]  # the last 8 bytes, if there are more
        b[size <= 8] = 0
        slot = ((a ^ (b + size.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.intp)
        own = self.size_n[slot]
        out = (own & 15).astype(np.int64)
        new = np.flatnonzero((self.a[slot] != a) | (self.b[slot] != b) | (own >> 4 != size))
        if not len(new):
            return out
        # One of the new pieces of a slot takes it; those equal to it need not be merged.
        at, a, b, left = slot[new], a[new], b[new], size[new]
        taker = np.empty(SLOTS, np.int32)
        taker[at] = np.arange(len(new), dtype=np.int32)
        of = taker[at]
        equal = (a[of] == a) & (b[of] == b) & (left[of] == left)
        takes = of == np.arange(len(new))
        which = np.flatnonzero(takes | ~equal)
        which = which[np.argsort(left[which], kind="stable")]  # pieces of like sizes are merged together
        n = np.zeros(len(new), np.int64)
        for i in range(0, len(which), MERGED):
            part = which[i : i + MERGED]
            n[part] = self.merged(data, start[new[part]], left[part])
        n = np.where(equal, n[of], n)
        out[new] = n
        at = at[takes]
        self.a[at], self.b[at], self.size_n[at] = a[takes], b[takes], left[takes] << 4 | n[takes]
        return out
