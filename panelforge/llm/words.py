"""Vectorised word and shingle hashing over blocks of UTF-8 bytes.

Texts of one Arrow batch lie in one buffer.  A block is a run of whole texts of
about ``BLOCK`` bytes (one text at least), so work arrays stay small whatever the
batch holds.  Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.arange(256, dtype=np.uint8)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0..n of an odd base modulo 2**64, grown by doubling and kept."""
    kept = _powers.get(base)
    if kept is None or len(kept) <= n:
        size = max(BLOCK + 1, n + 1)
        kept = np.empty(size, dtype=np.uint64)
        kept[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            factor = np.uint64(pow(base, done, 1 << 64))
            kept[done : done + step] = kept[:step] * factor
            done += step
        _powers[base] = kept
    return kept[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    parts = texts.buffers()
    offsets = np.frombuffer(parts[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None and parts[2].size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first, end, bytes, offsets): texts first..end-1 and where each starts in bytes."""
    data, offsets = buffers(texts)
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (n_texts + 1)."""
    inside = ~_SPACE[data]
    n = len(data)
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte span, from one prefix sum of a polynomial modulo 2**64."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    if n:
        np.cumsum(_BYTE[(_LOWER if lower else _KEEP)[data]] * _power(_BASE, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows and, for each text, the index of its first one.

    A text with 1 to width-1 words has one window, its whole sequence.
    """
    counts = np.diff(first)
    windows = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(windows)])
    total = int(begin[-1])
    if total == 0:
        return np.zeros(0, np.uint64), begin
    owner = np.repeat(np.arange(len(counts)), windows)
    at = first[:-1][owner] + (np.arange(total) - begin[:-1][owner])
    out = np.zeros(total, dtype=np.uint64)
    length = np.minimum(counts, width)[owner]
    for k in range(width):
        ok = length > k
        if ok.all():
            out += words[at + k] * _PLACE[k]
        else:
            out[ok] += words[at[ok] + k] * _PLACE[k]
    return mix(out + length.astype(np.uint64)), begin
