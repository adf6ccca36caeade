"""Pre-tokens of Latin texts, cut on byte arrays, and values of pre-tokens: each distinct one of a batch is looked up once.

The two cuts are those of the public tokenizers' own patterns, for texts whose code points are all below U+0180:
contractions, runs of letters, numbers or other signs. The byte-level cut keeps white space: a run of it is a piece but for its last
character, which, if a space, goes with what follows. The word cut drops white space and takes numbers one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd

from scopeflow.llm import textkit as tk

# Code points below U+0180: letters, numbers and white space as the libraries' \p{L}, \p{N} and \s have them.
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\x0b\x0c\r \x85\xa0"
LETTER, NUMBER, SPACE, SIGN = range(4)
_CLASS = np.array([next((k for k, own in enumerate((LETTERS, NUMBERS, SPACES)) if re.fullmatch(f"[{own}]", chr(c))), SIGN) for c in range(0x180)], np.uint8)
_BEYOND = 0xC6  # the least lead byte of a code point from U+0180 on
_SHORT, _MIDDLE = 7, 15


def plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows can be cut here: only code points below U+0180, and nothing that may open a special token."""
    odd = data >= _BEYOND
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    total = np.concatenate([[0], np.cumsum(odd)])
    return total[offsets[1:]] == total[offsets[:-1]]


def cut(data: np.ndarray, offsets: np.ndarray, by_bytes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of all pieces of the rows, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.flatnonzero(data >= 0xC0)
    follows = (data & 0xC0) == 0x80
    kind = _CLASS[data]
    wide = ((data[lead].astype(np.int32) & 0x1F) << 6) | (data[np.minimum(lead + 1, n - 1)] & 0x3F)
    kind[lead] = _CLASS[np.minimum(wide, 0x17F)]
    after = np.flatnonzero(follows)
    kind[after] = kind[after - 1]
    opens = np.zeros(n + 1, bool)  # of rows
    opens[offsets] = True
    begin = np.ones(n + 1, bool)
    begin[1:n] = kind[1:] != kind[:-1]
    begin |= opens
    if not by_bytes:
        begin[:n] |= (kind == NUMBER) & ~follows
    else:
        # Runs of white space that something follows in their row: the last character is apart, a space goes with what follows.
        stop = np.flatnonzero(begin[1:n] & ~opens[1:n] & (kind[:-1] == SPACE)) + 1
        last = stop - 1 - follows[stop - 1]
        begin[last] = True
        begin[stop[data[last] == 32]] = False
    # A sign at the start of a piece that is an apostrophe may open a contraction.
    at = np.flatnonzero(begin[:n] & (data == 39))
    one, two = (np.where(at + k < n, data[np.minimum(at + k, n - 1)], 0) * ~opens[np.minimum(at + k, n)] for k in (1, 2))
    two = two * (one > 0)
    size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, 0)
    pair = one.astype(np.int32) * 256 + two
    size = np.where(np.isin(pair, [a * 256 + b for a, b in (b"re", b"ve", b"ll")]), 3, size)
    at, size = at[size > 0], size[size > 0]
    begin[at + 1] = False
    begin[at + size] = True
    start = np.flatnonzero(begin[:n])
    end = np.append(start[1:], n)
    if not by_bytes:
        keep = kind[start] != SPACE
        start, end = start[keep], end[keep]
    return start, end


def look_up(data: np.ndarray, start: np.ndarray, end: np.ndarray, values_of: Callable[[list[bytes]], list]) -> tuple[list, np.ndarray]:
    """(values, place): the value of each distinct piece, and for each piece the place of its value."""
    raw = data.tobytes()
    size = end - start
    words = tk.words64(data)
    place = np.empty(len(start), np.int64)
    found: list[bytes] = []

    def distinct(which: np.ndarray, key: np.ndarray) -> np.ndarray:
        codes, _ = pd.factorize(key)
        first = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        place[which] = codes + len(found)
        found.extend(raw[a:b] for a, b in zip(start[which[first]].tolist(), end[which[first]].tolist()))
        return first[codes]

    short = np.flatnonzero(size <= _SHORT)  # the key is the piece itself
    bits = size[short].astype(np.uint64) * np.uint64(8)
    distinct(short, (words[start[short]] & ((np.uint64(1) << bits) - np.uint64(1))) | (bits << np.uint64(53)))
    middle = np.flatnonzero((size > _SHORT) & (size <= _MIDDLE))
    a, b = words[start[middle]], words[end[middle] - 8]
    same = distinct(middle, tk.mix64(a ^ tk.mix64(b + size[middle].astype(np.uint64))))
    wrong = (a[same] != a) | (b[same] != b) | (size[middle][same] != size[middle])  # a piece is its first 8 and last 8 bytes
    known: dict[bytes, int] = {}
    for i in [*np.flatnonzero(size > _MIDDLE).tolist(), *middle[wrong].tolist()]:
        piece = raw[start[i] : end[i]]
        if piece not in known:
            known[piece] = len(found)
            found.append(piece)
        place[i] = known[piece]
    return values_of(found), place
