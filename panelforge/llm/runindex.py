"""Run-length index of a byte text: a run-compressed Burrows-Wheeler transform.

For each run of the transform the suffix positions of its first and last row are sampled.
The longest match of a suffix with its neighbour above in suffix order falls by one from a
text position to the next, except where the row begins a run; likewise for the neighbour
below and run ends.  So matches need comparing only at the sampled run ends, and
streaming over the text gives every suffix's longest match with any other.
"""

from __future__ import annotations

import numpy as np

#: A byte that UTF-8 never holds; it stands between texts.
SEPARATOR = 0xFF


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian integer."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out |= padded[i : i + len(text)]
    return out


def suffix_order(word: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling from eight bytes; only tied groups are sorted again."""
    n = len(word)
    order = np.argsort(word)
    ranked = word[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    while True:
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(tied):
            return order
        own = order[tied]
        following = own + depth
        second = np.zeros(len(own), dtype=np.int64)
        inside = following < n
        second[inside] = rank[following[inside]] + 1
        key = (rank[own] << 32) | second
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[tied] = own
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[tied] = fresh
        rank[own] = np.maximum.accumulate(np.where(fresh, tied, 0))
        depth *= 2


def common_prefix(word: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes i and j, eight bytes at a step."""
    n = len(word)
    out = np.zeros(len(i), dtype=np.int64)
    left = np.arange(len(i))
    while len(left):
        a, b = i[left] + out[left], j[left] + out[left]
        inside = (a < n) & (b < n)
        left, a, b = left[inside], a[inside], b[inside]
        differ = word[a] ^ word[b]
        equal = differ == 0
        odd = left[~equal]
        x = differ[~equal]
        for k in range(1, 8):
            out[odd] += (x >> np.uint64(64 - 8 * k)) == 0
        left = left[equal]
        out[left] += 8
    return np.minimum(out, n - np.maximum(i, j))


class RunIndex:
    """Run symbols, run starts and the suffixes sampled at run ends."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        self.word = words_at(text)
        order = suffix_order(self.word)
        before = text.astype(np.int16)[order - 1]
        before[order == 0] = -1
        head = np.concatenate([[True], before[1:] != before[:-1]])
        self.start = np.flatnonzero(head)
        self.symbol = before[self.start]
        self.first = order[self.start]
        self.last = order[np.concatenate([self.start[1:], [self.n]]) - 1]

    def longest_matches(self) -> np.ndarray:
        """For each position, the longest match of its suffix with any other suffix."""
        boundary = common_prefix(self.word, self.first[1:], self.last[:-1])
        return np.maximum(self._stream(self.first, np.concatenate([[0], boundary])), self._stream(self.last, np.concatenate([boundary, [0]])))

    def _stream(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        known = np.zeros(self.n, dtype=np.int64)
        known[at] = at
        held = np.zeros(self.n, dtype=np.int64)
        held[at] = value
        place = np.arange(self.n)
        source = np.maximum.accumulate(known)
        return np.maximum(held[source] - (place - source), 0)


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct byte strings, the starts of ``length``-byte strings that also start elsewhere in them."""
    text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
    match = RunIndex(text).longest_matches()
    out, at = [], 0
    for p in pieces:
        out.append(np.flatnonzero(match[at : at + max(0, len(p) - length + 1)] >= length))
        at += len(p) + 1
    return out
