"""Document fingerprints by winnowing.

A text's k-gram hashes (code points) are cut into windows of ``window`` hashes; from
each window the minimum is chosen, the rightmost on ties, and a hash chosen by several
windows is stored once with its position.  Two texts that share ``k + window - 1`` code
points share a fingerprint hash.  With the shipped values (12 and 19) that is any run of 30
code points, so a text of 40 or more shares a hash with its edited text, whose first three
quarters are its own.

Defined cases: a null text counts as empty and has the empty fingerprint; a text shorter
than k has one hash, of the whole text, at 0; a text of fewer than ``window`` hashes is one
window.  Two empty fingerprints are alike (1.0), an empty and another are not (0.0).
Texts of any length are read whole; long ones in slices that overlap by a window.
Rows with equal ids follow each other in the order of their texts' hashes; a null id sorts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import words as W
from panelforge.llm.store import small_batches

K = 12
WINDOW = 19
_PLACE_BITS = 26
_LIMIT = 1 << _PLACE_BITS
#: Code points hashed at once; a longer text is read in slices of this length.
SLICE = 1 << 22
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def chosen(codes: np.ndarray, lengths: np.ndarray, k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each text; ``codes`` holds the texts one after another."""
    n = len(codes)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(lengths)
    if n == 0:
        return out
    if n > SLICE + k + window - 2:
        return [_in_slices(codes[b:e], k, window) for b, e in zip(begins.tolist(), ends.tolist())]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(W.mix(codes.astype(np.uint64) + np.uint64(0x51ED27)) * W._power(_BASE, n)[:n], out=sums[1:])
    keep = np.uint64(~((1 << _PLACE_BITS) - 1) & (1 << 64) - 1)
    if n >= k:
        grams = W.mix((sums[k:] - sums[:-k]) * W._power(_INVERSE, n)[: n - k + 1])
        # Low bits: later places get smaller values, so a tie goes to the rightmost.
        grams &= keep
        grams |= np.uint64(_LIMIT - 1) - np.arange(len(grams), dtype=np.uint64)
        mins = _sliding_min(grams, window) if len(grams) >= window else None
    for i in range(len(lengths)):
        m, b = int(lengths[i]), int(begins[i])
        if m == 0:
            continue
        if m < k:
            value = W.mix((sums[b + m : b + m + 1] - sums[b : b + 1]) * np.uint64(pow(_INVERSE, b, 1 << 64)) + np.uint64(m))
            out[i] = (value >> np.uint64(32), np.zeros(1, np.int64))
            continue
        count = m - k + 1
        if count < window:
            picked = grams[b : b + count].min(keepdims=True)
        else:
            run = mins[b : b + count - window + 1]
            picked = run[np.concatenate([[True], run[1:] != run[:-1]])]
        place = np.int64(_LIMIT - 1) - (picked & np.uint64(_LIMIT - 1)).astype(np.int64) - b
        out[i] = (picked >> np.uint64(32), place)
    return out


def _in_slices(codes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of one text; every window of hashes lies whole in one slice."""
    shared = k + window - 2
    parts = []
    for at in range(0, max(1, len(codes) - shared), SLICE):
        piece = codes[at : at + SLICE + shared]
        hashes, places = chosen(piece, np.array([len(piece)]), k, window)[0]
        parts.append((hashes, places + at))
    places, first = np.unique(np.concatenate([p for _, p in parts]), return_index=True)
    return np.concatenate([h for h, _ in parts])[first], places


def _pack(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """16 hex digits for each chosen hash: its 32 bits and its position."""
    hashes, places = print_
    return np.stack([hashes.astype(">u4"), places.astype(">u4")], axis=1).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two fingerprints' hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _prints(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    group, size = [], 0
    for text in [*texts, None]:
        if group and (text is None or size + len(text) > 1 << 18):
            codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
            out += chosen(codes, np.array([len(x) for x in group]))
            group, size = [], 0
        if text is not None:
            group.append(text)
            size += len(text)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, hashes array<bigint>, positions array<bigint>.  A map over rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = _prints(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))],
                ["doc_id", "n_chars", "hashes", "positions"],
            )

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, n_chars bigint, hashes array<bigint>, positions array<bigint>")


def with_next(docs: DataFrame, id_col: str, text_col: str, run, schema: str) -> DataFrame:
    """Map ``run`` over ranges of rows in id order, each followed by the next range's first row.

    Range bounds are ids of the table, so the first row of a range is known by its id: it
    also goes to the range before (the very first row to the last range).  One shuffle
    of the texts; only the bounds, one id per range, come to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    parts = max(2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(rows.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)))
    bounds = [int(b) for b in bounds]
    # Range r holds ids in [bounds[r-1], bounds[r]).
    part = _bucket(bounds)
    placed = rows.withColumn("part", part)
    # Within a range, rows of equal id are ordered by text; the first row of each range is
    # repeated at the end of the range before it.
    heads = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))).alias("head"))
    order = [r.part for r in heads.select("part").orderBy("part").collect()]
    if not order:
        return spark.createDataFrame([], schema)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    where = spark.createDataFrame([(p, q) for p, q in before.items()], "part int, previous int")
    first = heads.join(F.broadcast(where), "part").select("part", "previous", F.col("head.doc_id").alias("head_id"), F.col("head.h").alias("head_h"))
    tagged = placed.join(F.broadcast(first), "part").withColumn("h", F.xxhash64("text"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    copies = F.when(is_head, F.array(F.struct("part", F.lit(0).alias("tail")), F.struct(F.col("previous").alias("part"), F.lit(1).alias("tail")))).otherwise(F.array(F.struct("part", F.lit(0).alias("tail"))))
    dealt = tagged.select("doc_id", "text", "h", F.explode(copies).alias("c")).select(F.col("c.part").alias("part"), F.col("c.tail").alias("tail"), "doc_id", "h", "text")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", "doc_id", "h").mapInArrow(run, schema)


def _bucket(bounds: list[int]):
    """Number of sorted bounds at or below doc_id (null: 0), by binary search in one literal array."""
    size = 1 << len(bounds).bit_length()
    padded = F.array(*[F.lit(b).cast("bigint") for b in bounds + [(1 << 63) - 1] * (size - len(bounds))])
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())]) if size > 1 else F.array(F.lit(0))
    if not bounds:
        return F.lit(0)
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(padded, low + step - 1) <= F.col("doc_id"), low + step).otherwise(low))


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the first as many code points of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text and the next text, and compare them."""
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (part, tail, doc_id, text) in order; pairs are neighbours
        seen: set = set()

        def flush() -> pa.RecordBatch | None:
            pairs = [(a, b) for a, b in zip(held, held[1:]) if a[0] == b[0] and not a[1]]
            if not pairs:
                return None
            after = [edited(a[3], b[3]) for a, b in pairs]
            plain = _prints([x[3] for x in held])
            index = [i for i, (a, b) in enumerate(zip(held, held[1:])) if a[0] == b[0] and not a[1]]
            changed = _prints(after)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in after], pa.string()),
                    pa.array([_pack(plain[i]) for i in index], pa.string()),
                    pa.array([_pack(c) for c in changed], pa.string()),
                    pa.array([likeness(plain[i][0], c[0]) for i, c in zip(index, changed)], pa.float64()),
                    pa.array([likeness(plain[i][0], plain[i + 1][0]) for i in index], pa.float64()),
                ],
                [x.split()[0] for x in schema.split(", ")],
            )

        size = 0
        for row in rows(batches):
            if row[1]:
                # One tail row for each range; equal first rows of it would repeat it.
                if row[0] in seen:
                    continue
                seen.add(row[0])
            held.append(row)
            size += len(row[3])
            if size > 1 << 19:
                made = flush()
                if made is not None:
                    yield made
                held[:], size = held[-1:], len(held[-1][3])
        made = flush()
        if made is not None:
            yield made

    return with_next(docs, id_col, text_col, run, schema)
