"""Sequence packing as a cutting-stock problem.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.  The counts
of pieces by length class (at most capacity / GRAIN numbers) come to the driver; there a
linear program over patterns is solved by column generation, with a knapsack dynamic
programme that prices new patterns.  Patterns are rounded down, what is left is packed
first-fit-decreasing, and pieces take the patterns' slots by their rank in their class.

Ranks come from counts per (class, bucket) and a window inside each bucket, so that a
class with a third of all pieces is still ranked by many tasks.

Defined cases: a null text counts as empty; an empty text is one piece, its end token;
repeated rows are separate documents of equal id, told apart by a hash-free running number
inside their partition; a table without rows gives no sequences; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.store import save, small_batches, vocabulary

CAPACITY = 2048
#: Tokens per length class: the driver sees at most CAPACITY / GRAIN counts.
GRAIN = 8
END = 1
KEEP_CHUNKS = 1_200_000
MARKS = ".,;:!?"


def _chunks(text: str) -> list[str]:
    """A text cut at white space; four control characters are space to Python only."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in text.replace("\n", " ").split(" ") if c]
    return text.split()


class Tokens:
    """Ids of whole texts by a tokenizer that drops white space between words.

    White space never joins two words' tokens in such a vocabulary, so texts are cut at
    white space, and the ids of a chunk are kept.  The kept chunks are dropped
    at ``KEEP_CHUNKS``; results never depend on it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.closes = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_chunks(t) for t in texts]
        if len(self.kept) > KEEP_CHUNKS:
            self.kept.clear()
        kept = self.kept
        new = set().union(*cut).difference(kept)
        if new:
            self._learn(new)
        return [b"".join(map(kept.__getitem__, chunks)) for chunks in cut]

    def _learn(self, new: set[str]) -> None:
        """Ids of chunks not seen before.

        Letters and a closing mark are separate words of this vocabulary and case is
        ignored, so a chunk of plain letters with or without a mark is encoded by its
        lower-case letters.
        """
        kept = self.kept
        parts, plain, odd = {}, set(), set()
        for chunk in new:
            mark = chunk[-1] if chunk[-1] in MARKS else ""
            core = chunk[:-1] if mark else chunk
            if core.isalpha() and max(core) < "\u0130":
                parts[chunk] = core.lower(), mark
                plain.add(core.lower())
                odd.add(mark)
            else:
                parts[chunk] = chunk, ""
                odd.add(chunk)
        # Words of letters are encoded many to a text and told apart by their closing tokens.
        words = list(plain.difference(kept))
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                odd.update(part)
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, (4 * ends).tolist()):
                kept[word] = raw[start:end]
                start = end
        rest = [x for x in odd if x and x not in kept]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for chunk, found in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                kept[chunk] = array("I", found.ids).tobytes()
        kept[""] = b""
        for chunk, (core, mark) in parts.items():
            kept[chunk] = kept[core] + kept[mark]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(vocabulary(path))
    return _tokens[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece.  A map over rows."""
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, copy bigint" + (", ids array<bigint>" if with_ids else "")
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = tokens(path), 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[list] = [[] for _ in range(7)]
            for at in range(0, len(texts), 64):
                for key, ids in zip(keys[at : at + 64], coder.encode(texts[at : at + 64])):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        row = (key, start, len(part) // 4, zlib.crc32(part), total, number)
                        for column, value in zip(out, row):
                            column.append(value)
                        if with_ids:
                            out[6].append(np.frombuffer(part, "<u4").astype(np.int64))
                    number += 1
            arrays = [pa.array(c, pa.int64()) for c in out[:6]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
            if with_ids:
                arrays.append(pa.array(out[6], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern by an unbounded knapsack: its value and how often each size is in it."""
    use = np.flatnonzero(values > 1e-12)
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    use = use[np.argsort(sizes[use])]
    size, value = sizes[use], values[use]
    for c in range(1, capacity + 1):
        m = int(np.searchsorted(size, c, "right"))
        best[c] = best[c - 1]
        if m:
            gain = value[:m] + best[c - size[:m]]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-15:
                best[c], pick[c] = gain[k], use[k]
    pattern = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses each, by revised simplex."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for step in range(rounds):
        if step % 200 == 199:
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ demand, 0.0)
        dual = cost @ inverse
        worst = int(dual.argmin())
        if dual[worst] < -1e-9:
            entering, price = np.zeros(m), 0.0
            entering[worst] = -1.0
        else:
            value, pattern = _knapsack(dual, sizes, capacity)
            if value <= 1 + 1e-7:
                break
            entering, price = pattern.astype(float), 1.0
        direction = inverse @ entering
        positive = np.flatnonzero(direction > 1e-10)
        if not len(positive):
            break
        ratio = x[positive] / direction[positive]
        least = ratio.min()
        ties = positive[ratio <= least + 1e-12]
        leave = int(ties[direction[ties].argmax()])
        x = np.maximum(x - least * direction, 0.0)
        x[leave] = least
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        columns[:, leave], cost[leave] = entering, price
    real = cost > 0
    return np.rint(columns[:, real]).astype(np.int64), x[real]


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, number of sequences) pairs that hold every piece exactly once."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if not len(sizes):
        return out
    columns, x = column_generation(sizes, demand.astype(float), capacity)
    for p in np.argsort(-x):
        pattern = columns[:, p]
        has = pattern > 0
        if has.any():
            n = min(int(np.floor(x[p] + 1e-6)), int((left[has] // pattern[has]).min()))
            if n > 0:
                out.append((pattern, n))
                left -= n * pattern
    # What rounding left, at most a few pieces for each pattern: first fit decreasing.
    order = np.argsort(-sizes)
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), dtype=np.int64)
        for c in order:
            take = min(int(left[c]), room // int(sizes[c]))
            if take:
                pattern[c] = take
                room -= take * int(sizes[c])
        has = pattern > 0
        n = int((left[has] // pattern[has]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (see ``pieces``)."""
    spark = found.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = found.withColumn("class", F.ceil(F.col("length") / grain).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "copy"), F.lit(buckets)).cast("int"))
    table = save(table, "pieces")
    counts = table.groupBy("class", "bucket").count().collect()  # classes x buckets at most
    by_class: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["class"], r["bucket"])):
        base[r["class"], r["bucket"]] = by_class.get(r["class"], 0)
        by_class[r["class"]] = by_class.get(r["class"], 0) + r["count"]
    classes = sorted(by_class)
    patterns = plan(np.array(classes, dtype=np.int64), np.array([by_class[c] for c in classes]), capacity // grain)
    # For each class: the first rank of each pattern's slots, its first sequence, slots in a sequence.
    slots: dict[int, list[list[int]]] = {c: [] for c in classes}
    taken, sequence = dict.fromkeys(classes, 0), 0
    for pattern, n in patterns:
        for c, per in zip(classes, pattern.tolist()):
            if per:
                slots[c].append([taken[c], sequence, per])
                taken[c] += per * n
        sequence += n
    tables = {c: np.array(v, dtype=np.int64).reshape(-1, 3) for c, v in slots.items()}
    inside = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "copy", "ids_crc32")
    ranked = table.withColumn("rank", F.row_number().over(inside) - 1)
    names = [f.name for f in ranked.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields) + ", sequence_id bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(names.index("class")).to_numpy()
            bucket = batch.column(names.index("bucket")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy().astype(np.int64)
            out = np.empty(len(kind), dtype=np.int64)
            for c in np.unique(kind).tolist():
                own = kind == c
                r = rank[own] + np.array([base[c, b] for b in bucket[own].tolist()], dtype=np.int64)
                t = tables[c]
                row = t[np.searchsorted(t[:, 0], r, "right") - 1]
                out[own] = row[:, 1] + (r - row[:, 0]) // row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, "sequence_id"])

    placed = ranked.mapInArrow(run, schema)
    # A sequence holds at most ``capacity`` pieces.
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length")).drop("class", "bucket", "rank", "copy")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and place."""
    return pack(pieces(docs, path, id_col, text_col, with_ids=with_ids))
