"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel compares pieces of sentences.  It counts common subsequences of four characters that
span at most SPAN characters, each weighted by DECAY to the length it spans, and is normalised;
an inserted character or a gap lowers it but does not break it.  A sentence (up to ``.``, ``!``
or ``?`` before a blank, a line end or ``|``) is cut into pieces of PIECE characters, each half
over the one before; symbols inside words are left out; look-alike digits beside a letter and
look-alike symbols between two letters are letters.

Training: sentences of labelled texts carry their text's label.  The kernel to LANDMARKS pieces,
whitened (Nystrom), is the feature space of a linear support vector machine.  As not every
sentence of a toxic text is toxic, the machine is fitted ROUNDS times: after the first, a toxic
text gives its highest pieces and a clean one its highest as well, beside those of earlier rounds.  A toxic piece is also
learnt with one letter put into each longer word.  A decision is linear in a piece's subsequence vector, so
scoring needs one weight per subsequence.  A text's score is a logistic function of its three
highest decisions and its number of pieces.

Bounds: training reads at most ``MAX_LABELLED`` texts of each class (by hash of the id), whole;
at most ``FIRST`` and ``HIGHEST`` pieces of a text go to the driver.  Sampled rows of a class
stand for all its labelled rows: the logistic fit weights them.  Scoring reads every whole text.

Defined cases: a null text counts as empty; a text without pieces (under four characters a
sentence) gets the score of the decision of a piece that shares nothing with the landmarks;
without labels of both classes the score is the share of toxic labels (0 if there are none); a
null id is scored like any other and is never learnt from; labels repeated for one id count as
toxic if one of them is; rows repeated count as often as they stand; equal texts get equal scores;
texts over SLICE characters are read in slices that end at a blank; lang, source, ids and other
columns are never inputs of a score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.store import drop, save, small_batches

DECAY = 0.6
SPAN = 7  # characters that a subsequence spans at most
PIECE = 24  # characters at which subsequences of a piece start
MAX_LABELLED = 4000
FIRST = {1: 8, 0: 12}  # pieces of a toxic and of a clean text in the first round, by hash
HIGHEST = {1: 3, 0: 3}  # in later rounds, by decision
ROUNDS = 4
LANDMARKS = 256
SLICE = 1 << 20
#: Look-alike characters inside words (fixed values).
LOOKALIKE = {"!": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

SPACE, OTHER, STOP, BASE = 0, 27, 28, 29  # codes: blank, a to z, any other letter, end of a sentence
ALPHABET = " abcdefghijklmnopqrstuvwxyz#"
_DROP, _LINE, _END, _BANG, _LOOK = 100, 101, 102, 103, 200
#: Places of the second to the fourth character after the first one.
SHAPES = [(j, k, m) for m in range(3, SPAN) for k in range(2, m) for j in range(1, k)]
_LEVEL = (DECAY ** np.arange(4, SPAN + 1)).astype(np.float32)


def _classes() -> np.ndarray:
    """Code of every code point: letters by their base letter, look-alikes marked by _LOOK."""
    out = np.full(0x110000, _DROP, dtype=np.uint8)
    for point in range(0x20000):
        char = chr(point)
        if char.isalpha():
            base = unicodedata.normalize("NFD", char.lower())[0]
            out[point] = ord(base) - 96 if "a" <= base <= "z" else OTHER
        elif char == " " or "\t" <= char <= "\r":
            out[point] = SPACE
    for char, letter in LOOKALIKE.items():
        out[ord(char)] = _LOOK + ord(letter) - 96
    out[ord("!")] = _BANG
    out[[ord("."), ord("?")]] = _END
    out[[ord("\n"), ord("|")]] = _LINE
    return out


_CLASS = _classes()
_DIGITS = [ord(x) for x in LOOKALIKE if x.isdigit()]


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text divisible by 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts in a row, and the text of each; SPAN - 1 times STOP ends a sentence."""
    raw = [np.frombuffer((t + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    text = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    points = np.concatenate(raw)
    c = _CLASS[points]
    letter = ((c > SPACE) & (c <= OTHER)) | (c >= _BANG)
    before, after = np.concatenate([[False], letter[:-1]]), np.concatenate([letter[1:], [False]])
    digit = np.isin(points, _DIGITS)
    read = np.where(digit, before | after, before & after)
    c = np.where(c == _BANG, np.where(read, ord("i") - 96, _END), np.where(c > _LOOK, np.where(read, c - _LOOK, _DROP), c))
    blank = (c == SPACE) | (c == _LINE)
    c = np.where(c == _END, np.where(np.concatenate([blank[1:], [True]]), _LINE, _DROP), c)
    keep = c != _DROP
    c, text = c[keep], text[keep]
    # One of the blanks in a row is kept, and none at the start or before the end of a sentence.
    keep = (c != SPACE) | np.concatenate([c[1:] != SPACE, [True]])
    c, text = c[keep], text[keep]
    keep = (c != SPACE) | ~(np.concatenate([c[1:] == _LINE, [True]]) | np.concatenate([[True], c[:-1] == _LINE]))
    c, text = c[keep], text[keep]
    times = np.where(c == _LINE, SPAN - 1, 1)
    return np.repeat(np.where(c == _LINE, STOP, c).astype(np.int32), times), np.repeat(text, times)


def cut(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the pieces, and how many characters each position has left in its sentence."""
    edges = np.diff(np.concatenate([[0], (c != STOP).view(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    left = np.zeros(len(c), dtype=np.int64)
    size = last - first
    inside = np.repeat(last, size)
    left[c != STOP] = inside - np.flatnonzero(c != STOP)
    first, size = first[size >= 4], size[size >= 4]
    step = PIECE // 2
    parts = 1 + np.maximum(0, -(-(size - PIECE) // step))
    owner = np.repeat(np.arange(len(size)), parts)
    begin = first[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    return begin, np.minimum(begin + PIECE, (first + size)[owner]), left


def subsequences(c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Subsequence codes of pieces, a row each, by shape and start; -1 where there is none."""
    padded = np.concatenate([c, np.full(PIECE + SPAN, STOP, np.int32)])
    rows = padded[begin[:, None] + np.arange(PIECE + SPAN - 1)]
    none = rows == STOP
    late = np.arange(PIECE) >= (end - begin)[:, None]
    at = [slice(d, d + PIECE) for d in range(SPAN)]
    out = np.empty((len(rows), len(SHAPES), PIECE), dtype=np.int32)
    for n, (j, k, m) in enumerate(SHAPES):
        out[:, n] = ((rows[:, at[0]] * BASE + rows[:, at[j]]) * BASE + rows[:, at[k]]) * BASE + rows[:, at[m]]
        out[:, n][late | none[:, at[0]] | none[:, at[j]] | none[:, at[k]] | none[:, at[m]]] = -1
    return out.reshape(len(rows), -1)


_KIND = np.repeat(np.array([m - 3 for _, _, m in SHAPES], dtype=np.int32), PIECE)
_WEIGHT = _LEVEL[_KIND]
#: Sum of squared weights of the subsequences that start where so many characters are left.
_SQUARES = np.array([sum(DECAY ** (2 * m + 2) for _, _, m in SHAPES if m < n) for n in range(SPAN + 1)])


def norms(c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Square roots of k(s, s) of the pieces."""
    out = np.zeros(len(begin))
    for at in range(0, len(begin), 512):
        found = subsequences(c, begin[at : at + 512], end[at : at + 512])
        n, width = found.shape
        keys = np.where(found < 0, -1, found * 4 + _KIND)
        keys.sort(axis=1)
        keys = keys.ravel()
        fresh = np.concatenate([[True], (keys[1:] >> 2) != (keys[:-1] >> 2)])
        fresh[::width] = True
        places = np.flatnonzero(fresh)
        sums = np.add.reduceat(np.where(keys < 0, 0, _LEVEL[keys & 3]), places)
        out[at : at + 512] = np.add.reduceat(sums * sums, np.searchsorted(places, np.arange(0, n * width, width)))
    return np.sqrt(np.maximum(out, 1e-12))


def _window_sums(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of x[begin:end], each added up by itself."""
    if not len(begin):
        return np.zeros(0)
    return np.add.reduceat(np.concatenate([x, [0.0]]), np.stack([begin, end], 1).ravel())[::2]


def slices(text: str) -> Iterator[str]:
    """A text in parts of at most SLICE characters that end at a blank if there is one."""
    at = 0
    while len(text) - at > SLICE:
        end = text.rfind(" ", at, at + SLICE) + 1 or at + SLICE
        yield text[at:end]
        at = end
    yield text[at:]


def grouped(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(text numbers, parts) of at most about SLICE characters."""
    owners, parts, size = [], [], 0
    for owner, text in enumerate(texts):
        for part in slices(text):
            if parts and size + len(part) > SLICE // 4:
                yield np.array(owners), parts
                owners, parts, size = [], [], 0
            owners.append(owner)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(owners), parts


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """(codes, text of each piece, start, end, characters left at each position) of blocks of texts."""
    for owners, parts in grouped(texts):
        c, text = codes(parts)
        begin, end, left = cut(c)
        if len(begin):
            yield c, owners[text[begin]], begin, end, left


def _piece(c: np.ndarray, begin: int, left: int) -> str:
    """A piece with the characters that its last subsequences reach."""
    return "".join(ALPHABET[i] for i in c[begin : begin + min(left, PIECE + SPAN - 1)])


def piece_codes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, starts and ends of pieces given as strings of ALPHABET."""
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes + SPAN)[:-1]])
    c = np.full(int((sizes + SPAN).sum()), STOP, dtype=np.int32)
    for at, piece in zip(begin, pieces):
        c[at : at + len(piece)] = [ALPHABET.index(x) for x in piece]
    return c, begin, begin + np.minimum(sizes, PIECE)


@dataclass
class Model:
    """One weight per subsequence, and the logistic function over a text's piece decisions."""

    weights: np.ndarray | None = None
    bias: float = -1.0
    logistic: tuple[float, ...] = (0.0,) * 5
    constant: float | None = None

    def _dots(self, c: np.ndarray) -> np.ndarray:
        """Weighted subsequences that start at each position."""
        n = len(c)
        padded = np.concatenate([c, np.full(SPAN, STOP, np.int32)])
        pairs = {d: padded[:-d] * BASE + padded[d:] for d in range(1, SPAN)}
        out = np.zeros(n, dtype=np.float32)
        for j, k, m in SHAPES:
            out += self.weights[pairs[j][:n] * BASE**2 + pairs[m - k][k : k + n]] * _LEVEL[m - 3]
        return out

    def highest(self, texts: list[str], top: int = 3) -> Iterator[tuple[int, list[tuple[float, str]], int]]:
        """(text, its highest decisions with their pieces, number of pieces); a text in slices comes once a slice."""
        for c, own, begin, end, left in blocks(texts):
            dots = _window_sums(self._dots(c), begin, end)
            # k(s, s) is at least the sum of squared weights: a bound of the decision that spares most norms.
            bound = np.maximum(dots, 0) / np.sqrt(_window_sums(_SQUARES[np.minimum(left, SPAN)], begin, end))
            exact = np.full(len(begin), -np.inf)
            order = np.lexsort((-bound, own))
            starts = np.flatnonzero(np.diff(own[order], prepend=-1))
            sizes = np.diff(np.append(starts, len(order)))
            rank = np.arange(len(order)) - np.repeat(starts, sizes)
            first = order[rank < top]
            exact[first] = dots[first] / norms(c, begin[first], end[first])
            least = np.repeat(np.minimum.reduceat(np.where(rank < top, exact[order], np.inf), starts), sizes)
            more = order[(rank >= top) & (bound[order] + 1e-5 >= least)]
            exact[more] = dots[more] / norms(c, begin[more], end[more])
            for s, n in zip(starts, sizes):
                mine = order[s : s + n]
                mine = mine[np.lexsort((mine, -exact[mine]))][:top]
                yield int(own[mine[0]]), [(round(float(exact[i]) + self.bias, 6), _piece(c, begin[i], left[begin[i]])) for i in mine], int(n)

    def features(self, texts: list[str]) -> np.ndarray:
        """The three highest decisions and the log of 1 + pieces, of each text."""
        out, pieces = np.full((len(texts), 3), np.float64(self.bias)), np.zeros(len(texts))
        found: dict[int, list[float]] = {}
        for owner, best, n in self.highest(texts):
            found.setdefault(owner, []).extend(d for d, _ in best)
            pieces[owner] += n
        for owner, best in found.items():
            best = sorted(best, reverse=True)[:3]
            out[owner, : len(best)] = best
        return np.hstack([out, np.log1p(pieces)[:, None]])

    def decide(self, texts: list[str]) -> np.ndarray:
        """The highest decision of each text."""
        return self.features(texts)[:, 0]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        w = np.array(self.logistic)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ w[:-1] + w[-1], -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, float]]:
    """label, text of the bounded training sample, and how many labelled rows a sampled row of each class stands for."""
    ids = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("key")).agg(F.max("toxic").alias("label")).where(~held_out(F.col("key")))
    order = F.xxhash64("key")
    stands = {r.label: max(1.0, r["count"] / MAX_LABELLED) for r in ids.groupBy("label").count().collect()}
    sample = ids.where("label = 1").orderBy(order, "key").limit(MAX_LABELLED).unionByName(ids.where("label = 0").orderBy(order, "key").limit(MAX_LABELLED))
    # At most 2 * MAX_LABELLED ids: a proven bound for the broadcast.
    return docs.select(docs[id_col].cast("bigint").alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(sample), "key").select("label", "text"), stands


def _svm(x1: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge, by Newton steps on the active rows; the last column of x1 holds ones.

    Products of the active rows are added up over parts of the rows, so no copy of ``x1`` is held in doubles.
    """
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (x1 @ w.astype(x1.dtype)) < 1
        square, side = np.zeros((len(w), len(w))), np.zeros(len(w))
        for at in range(0, len(x1), 2048):
            part = np.flatnonzero(active[at : at + 2048]) + at
            own = x1[part].astype(float)
            a = own * weight[part, None]
            square += a.T @ own
            side += a.T @ y[part]
        new = np.linalg.solve(ridge + 2 * c * square, 2 * c * side)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new if _ < 3 else 0.5 * (w + new)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps, with Platt's softened targets; a row counts ``weight`` times."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x1.shape[1])
    ridge = np.diag([1.0] * (len(w) - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(ridge + (x1 * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x1, x1.T @ (weight * (target - p)) - ridge @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def with_insertions(texts: list[str]) -> list[str]:
    """Each text with one letter put into each word of four characters or more; place and letter follow the text's hash."""
    out = []
    for text in texts:
        draw = np.random.default_rng(_hash(text))
        words = text.split(" ")
        places = draw.random(len(words))
        letters = draw.integers(1, 27, len(words))
        for i, word in enumerate(words):
            if len(word) >= 4:
                at = 1 + int(places[i] * (len(word) - 1))
                words[i] = word[:at] + ALPHABET[letters[i]] + word[at:]
        out.append(" ".join(words))
    return out


class Landmarks:
    """Nystrom features of pieces: kernel to the landmarks, whitened.

    One row for each subsequence that a landmark holds and a last one of zeros: at most
    LANDMARKS * PIECE * len(SHAPES) rows, the largest array that training holds.
    """

    def __init__(self, pieces: list[str]):
        c, begin, end = piece_codes(pieces)
        found, norm = subsequences(c, begin, end), norms(c, begin, end)
        self.known = np.unique(found[found >= 0])
        self.row = np.full(BASE**4 + 1, len(self.known), dtype=np.int32)  # at -1: no subsequence
        self.row[self.known] = np.arange(len(self.known))
        self.table = np.zeros((len(self.known) + 1, len(pieces)), dtype=np.float32)
        for j, own in enumerate(found):
            np.add.at(self.table[:, j], self.row[own[own >= 0]], _WEIGHT[own >= 0] / np.float32(norm[j]))
        value, basis = np.linalg.eigh((self.table.T @ self.table).astype(float))
        self.whiten = basis @ np.diag(np.maximum(value, 1e-3 * value.max()) ** -0.5) @ basis.T

    def kernel(self, pieces: list[str]) -> np.ndarray:
        """Normalised kernel of each piece to each landmark."""
        c, begin, end = piece_codes(pieces)
        norm = norms(c, begin, end)
        out = np.zeros((len(pieces), self.table.shape[1]), dtype=np.float32)
        for at in range(0, len(pieces), 512):
            for i, rows in enumerate(self.row[subsequences(c, begin[at : at + 512], end[at : at + 512])], at):
                held = rows < len(self.known)
                out[i] = _WEIGHT[held] @ self.table[rows[held]] / norm[i]
        return out

    def features(self, pieces: list[str]) -> np.ndarray:
        return self.kernel(pieces) @ self.whiten.astype(np.float32)

    def weights(self, u: np.ndarray) -> np.ndarray:
        """One weight per subsequence code of the linear function ``u`` of the features."""
        out = np.zeros(BASE**4, dtype=np.float32)
        out[self.known] = self.table[:-1] @ (self.whiten @ u).astype(np.float32)
        return out


def fit(positive: list[str], negative: list[str], landmarks: list[str]) -> Model:
    """Support vector machine over pieces of sentences."""
    space = Landmarks(landmarks)
    pieces = [p[: PIECE + SPAN - 1] for p in positive + with_insertions(positive) + negative]
    y = np.where(np.arange(len(pieces)) < 2 * len(positive), 1.0, -1.0)
    balance = np.where(y > 0, min(5.0, len(negative) / len(positive)), 1.0)
    # The largest array of training beside the landmarks' table: filled in parts, never copied.
    x1 = np.ones((len(pieces), len(landmarks) + 1), dtype=np.float32)
    for at in range(0, len(pieces), 2048):
        x1[at : at + 2048, :-1] = space.features(pieces[at : at + 2048])
    u, bias = _svm(x1, y, balance * 1000 / len(pieces))
    return Model(weights=space.weights(u), bias=bias)


def choose(positive: list[str], negative: list[str]) -> list[str]:
    """Landmarks: two thirds positive pieces, spread over their order, the rest negative ones by hash."""
    n = min(len(positive), LANDMARKS * 2 // 3)
    spread = [positive[i * len(positive) // n] for i in range(n)]
    return spread + sorted(negative, key=_hash)[: LANDMARKS - n]


def _hash(piece: str) -> int:
    return xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"))


def _pieces(sample: DataFrame, model: Model | None) -> list[tuple[int, float, str]]:
    """(label, decision, piece) of some pieces of each labelled text: the highest, or without a model by hash.

    Bounded by MAX_LABELLED texts of a class and FIRST or HIGHEST pieces of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got: list[tuple[int, float, str]] = []
            if model is None:
                held: dict[int, set[str]] = {}
                for c, own, begin, _, left in blocks(texts):
                    for owner, b, n in zip(own.tolist(), begin, left[begin]):
                        held.setdefault(owner, set()).add(_piece(c, b, n))
                for owner, found in held.items():
                    got += [(labels[owner], 0.0, p) for p in sorted(found, key=_hash)[: FIRST[labels[owner]]]]
            else:
                best: dict[int, list[tuple[float, str]]] = {}
                for owner, found, _ in model.highest(texts):
                    best.setdefault(owner, []).extend(found)
                for owner, found in best.items():
                    top = sorted(found, key=lambda x: (-x[0], x[1]))[: HIGHEST[labels[owner]]]
                    got += [(labels[owner], d, p) for n, (d, p) in enumerate(top) if not labels[owner] or not n or d > 0]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.string()))], ["label", "decision", "piece"])

    found = sample.mapInArrow(run, "label bigint, decision double, piece string").distinct()
    return sorted({(r.label, r.decision, r.piece) for r in found.collect()}, key=lambda r: (-r[1], _hash(r[2])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the model on labelled rows that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    found, stands = _labelled(docs, labels, id_col, text_col)
    # At most 2 * MAX_LABELLED texts, read once a round.
    sample = save(found.select(F.col("label").cast("bigint"), "text").repartition(32), "labelled")
    totals = {r.label: r["count"] * stands[r.label] for r in sample.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        drop(sample)
        return Model(constant=float(n1 > 0))
    model, clean = None, set()
    for _ in range(ROUNDS):
        rows = _pieces(sample, model)
        clean |= {p for label, _, p in rows if not label}  # those of earlier rounds stay
        positive = list(dict.fromkeys(p for label, _, p in rows if label and (model is not None or p not in clean)))
        negative = sorted(clean - set(positive))
        if not positive or not negative:
            drop(sample)
            return Model(constant=float(n1 > n0))
        model = fit(positive, negative, choose(positive[: max(LANDMARKS, len(positive) * 2 // 3)] if model else positive, negative))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = model.features(texts + with_insertions(texts))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_pylist() * 2, pa.int64()), *(pa.array(x[:, i]) for i in range(4))], ["label", "a", "b", "c", "d"])

    rows = sorted(sample.mapInArrow(measured, "label bigint, a double, b double, c double, d double").collect())  # 4 * MAX_LABELLED at most: each text as it is and with insertions
    drop(sample)
    x, y = np.array([r[1:] for r in rows]), np.array([r.label for r in rows], dtype=float)
    model.logistic = tuple(_logistic(x, y, np.array([stands[r.label] / 2 for r in rows])).tolist())
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text.  A map over rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = np.concatenate([model.score(texts[i : i + 100]) for i in range(0, len(texts), 100)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is not predicted toxic, all columns as they are."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = [model.score(texts[i : i + 100]) < 0.5 for i in range(0, len(texts), 100)]
            yield batch.filter(pa.array(np.concatenate(found) if found else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
