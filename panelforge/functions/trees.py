"""Boosted regression trees over binned rows: numpy over one block of rows, and the rounds that add up blocks.

A tree is perfect: ``feature`` and ``bin`` of its 2^depth - 1 splits in order of levels (a row goes left if its code is at
most ``bin``) and the ``leaf`` values, shrunk already.  A node that is not split sends all rows left.  Histograms are
sums of whole multiples of a power of two, so they do not depend on how rows are dealt to blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

BINS = 32
POINTS = 512
NEVER = 255  # the bin of a node without a split


class Tree(NamedTuple):
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray


class Block(NamedTuple):
    """Rows of a window: codes by feature, target, weight (empty: 1 each), validation or training, and a hash of the row."""

    codes: np.ndarray
    y: np.ndarray
    w: np.ndarray
    val: np.ndarray
    key: np.ndarray


class Member(NamedTuple):
    """What a pass over the rows needs of a fit: seed and round, trees, splits of the tree that grows, features whose histograms are read."""

    seed: int
    number: int
    trees: list[Tree]
    splits: list[tuple[int, int]]
    columns: list[int]


class Units(NamedTuple):
    """Powers of two of which sums are whole multiples: of residuals, weights and squared errors."""

    off: float
    weight: float
    error: float


def units(y: float, w: float) -> Units:
    """For targets and weights of at most these sizes; sums of 2^25 rows are exact."""
    at = lambda x: 2.0 ** (math.ceil(math.log2(x or 1.0)) - 28)
    return Units(at(y * w), at(w), at(y * y * w))


def sketch(x: np.ndarray) -> np.ndarray:
    """POINTS order statistics of x at even distances, or all of them."""
    x = np.sort(x)
    return x if len(x) <= POINTS else x[((np.arange(POINTS) + 0.5) * len(x) / POINTS).astype(np.int64)]


def thresholds(points: list[np.ndarray], rows: list[int]) -> np.ndarray:
    """Up to BINS - 1 splits, at even quantiles of the rows that the sketches stand for."""
    x = np.concatenate(points)
    weight = np.repeat([n / max(len(p), 1) for p, n in zip(points, rows)], [len(p) for p in points])
    values, place = np.unique(x, return_inverse=True)
    if len(values) > BINS:
        share = np.cumsum(np.bincount(place, weights=weight))
        values = values[np.unique(np.searchsorted(share, share[-1] * np.arange(1, BINS + 1) / BINS * (1 - 1e-12)).clip(max=len(values) - 1))]
    return values[:-1]


def coded(x: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """How many splits lie under x: at most j is the same as x <= splits[j]."""
    return np.searchsorted(splits, x, side="left").astype(np.uint8)


def _routed(codes: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """Node of each row on the level that follows ``splits``, which come in order of levels."""
    node, at, width = np.zeros(codes.shape[1], np.uint8), 0, 1
    while at < len(splits):
        right = np.zeros(codes.shape[1], bool)
        for k in range(width):
            f, b = splits[at + k]
            if b != NEVER:
                right |= (codes[f] > b) & (node == k)
        node = node * np.uint8(2) + right
        at, width = at + width, width * 2
    return node


def predicted(codes: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = np.zeros(codes.shape[1])
    for tree in trees:
        out += tree.leaf.take(_routed(codes, list(zip(tree.feature.tolist(), tree.bin.tolist()))))
    return out


def _drawn(key: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Which rows a round draws: a hash of row, seed and round, so that no block has a generator of its own."""
    x = key ^ np.uint32((seed * 0x9E3779B1 + number * 0x85EBCA77 + 0xC2B2AE3D) & 0xFFFFFFFF)
    for by, shift in ((0x7FEB352D, 15), (0x846CA68B, 16), (0x9E3779B1, 15)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(by)
    x ^= x >> np.uint32(16)
    return x < np.uint32(min(int(share * 2**32), 2**32 - 1))


def measured(block: Block, member: Member, unit: Units, share: float, known: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """Histograms (feature, node, bin, [weight, residual]) of the rows that the round draws, and on the first level the validation's squared error and weight.

    ``known``: what the fit's trees before ``member.trees`` give.
    """
    error = weight = 0.0
    left = block.y if known is None else block.y - known
    if not member.splits:
        at = np.flatnonzero(block.val)
        off, w = left[at] - predicted(block.codes[:, at], member.trees), block.w[at] if len(block.w) else np.ones(len(at))
        error, weight = float((np.rint(off * off * w / unit.error) * unit.error).sum()), float((np.rint(w / unit.weight) * unit.weight).sum())
    rows = np.flatnonzero(~block.val & _drawn(block.key, member.seed, member.number, share))
    codes, w = np.take(block.codes, rows, axis=1), block.w[rows] if len(block.w) else None
    off = left[rows]
    if member.trees:
        off -= predicted(codes, member.trees)
    off = np.rint((off if w is None else off * w) / unit.off) * unit.off
    w = None if w is None else np.rint(w / unit.weight) * unit.weight
    node, width = _routed(codes, member.splits).astype(np.intp) * BINS, len(member.splits) + 1
    out = np.zeros((len(member.columns), width, BINS, 2))
    for i, f in enumerate(member.columns):
        place = node + codes[f]
        out[i, :, :, 0] = np.bincount(place, weights=w, minlength=width * BINS).reshape(width, BINS)
        out[i, :, :, 1] = np.bincount(place, weights=off, minlength=width * BINS).reshape(width, BINS)
    return out, error, weight


def _candidates(n: int, share: float, seed: int, number: int, node: int) -> list[int]:
    """The features among which a node looks for its split."""
    k = max(1, math.ceil(share * n))
    return sorted(np.random.default_rng([seed, number, node]).choice(n, min(k, n), replace=False).tolist())


def boosted(members: dict, measure: Callable[[dict], dict], most: int, step: float, depth: int, columns: float) -> dict:
    """Trees and importances of each member: name -> (seed, number of features) in, name -> (trees, importances) out.

    ``measure`` takes name -> Member and gives name -> (histograms, validation error, weight), added up over all rows.
    A round grows one tree of each member, a pass over the rows a level.  The first tree fits the target, later ones the
    residual of the trees so far, by 2 * ``step``, as gradients of the squared error ask.  A member ends at the first
    round in which its validation error rises, and keeps the rounds up to the least error.
    """
    trees = {m: [] for m in members}
    gains = {m: [] for m in members}
    best = {m: (math.inf, 0) for m in members}
    active = list(members)
    for number in range(most + 1):
        splits = {m: [] for m in active}
        whole = {}  # node -> mean of its residuals, of the growing tree's last level
        for level in range(depth if number < most else 1):
            asked = {m: {k: _candidates(members[m][1], columns, members[m][0], number, len(splits[m]) + k) for k in range(2**level)} for m in active}
            used = {m: sorted({f for c in asked[m].values() for f in c}) for m in active}
            got = measure({m: Member(members[m][0], number, trees[m], splits[m], used[m]) for m in active})
            if level == 0:
                for m in active if number else ():
                    error = got[m][1] / got[m][2] if got[m][2] else 0.0
                    if error > best[m][0]:
                        splits.pop(m)
                    elif error < best[m][0]:
                        best[m] = (error, number)
                    elif not got[m][2]:
                        best[m] = (error, number)
                active = [m for m in active if m in splits]
                if number == most or not active:
                    break
            for m in active:
                hist, place = got[m][0], {f: i for i, f in enumerate(used[m])}
                means, gain = whole.setdefault(m, {}), gains[m]
                if level == 0:
                    gain.append(np.zeros(members[m][1]))
                made = []
                for k in range(2**level):
                    w, g = hist[place[asked[m][k][0]], k].sum(0)
                    mean = g / w if w > 0 else means.get((level, k), 0.0)
                    found = (0.0, 0, NEVER, mean, mean)
                    for f in asked[m][k]:
                        low = np.cumsum(hist[place[f], k], axis=0)[:-1]
                        ok = (low[:, 0] > 0) & (low[:, 0] < w)
                        if ok.any():
                            lw, lg = low[ok, 0], low[ok, 1]
                            more = lg * lg / lw + (g - lg) ** 2 / (w - lw) - g * g / w
                            j = int(np.argmax(more))
                            if more[j] > max(found[0], 1e-12 * abs(g * g / w)):
                                found = (float(more[j]), f, int(np.flatnonzero(ok)[j]), lg[j] / lw[j], (g - lg[j]) / (w - lw[j]))
                    made.append((found[1], found[2]))
                    gain[-1][found[1]] += found[0] * (4 if number else 1)
                    means[level + 1, 2 * k], means[level + 1, 2 * k + 1] = found[3], found[4]
                splits[m] = splits[m] + made
        if not active or number == most:
            break
        for m in active:
            leaf = np.array([whole[m][depth, k] for k in range(2**depth)]) * (2 * step if number else 1.0)
            trees[m] = trees[m] + [Tree(np.array([f for f, _ in splits[m]], np.uint8), np.array([b for _, b in splits[m]], np.uint8), leaf)]
    return {m: (trees[m][: best[m][1]], sum(gains[m][: best[m][1]], np.zeros(members[m][1]))) for m in members}


def joined(blocks: list[Block]) -> Block:
    return Block(np.concatenate([b.codes for b in blocks], axis=1), *[np.concatenate(x) for x in list(zip(*blocks))[1:]])


def fitted_block(block: Block, seed: int, n: int, unit: Units, share: float, **rounds) -> tuple[list[Tree], np.ndarray]:
    """``boosted`` of one fit whose rows are one block; what the trees give so far is kept."""
    known, done = np.zeros(len(block.y)), 0

    def measure(asked: dict) -> dict:
        nonlocal known, done
        member = asked[0]
        known, done = known + predicted(block.codes, member.trees[done:]), len(member.trees)
        return {0: measured(block, member._replace(trees=[]), unit, share, known)}

    return boosted({0: (seed, n)}, measure, **rounds)[0]
