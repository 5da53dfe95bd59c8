"""Repeated passages: every byte covered by a LENGTH-byte string that starts twice or more.

Each text is cut into pieces: runs of LENGTH-byte windows that share their least GRAM-byte
hash.  Equal windows have equal keys, so only pieces of a key that is found twice matter, and
each window lies in one piece.  Pieces of equal bytes are counted once.  The pieces of a shard
(keys by hash) are indexed by a run-length Burrows-Wheeler index, whose streamed longest
matches mark the windows.  Exact copies of a text are one class and are indexed once.

A key with more than HOT pieces is not gathered in one shard: the windows of its distinct
pieces are counted by 128-bit hashes, with map-side sums.

Defined cases: null counts as empty; a text under LENGTH bytes keeps everything; equal rows and
equal texts of different ids are copies of one another and lose every byte (of LENGTH or more);
matches never cross texts; other columns pass through ``remove_repeats`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import words as W
from panelforge.llm.runindex import repeated_starts
from panelforge.llm.store import save, small_batches
from panelforge.llm.winnow import _sliding_min

LENGTH = 200
GRAM = 64
RUN = 256  # windows in a piece at most
HOT = 12_000
SHARD_BYTES = 2 << 20
INDEX_BYTES = 1 << 20


def cut(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of the texts of a block: (text, start in the block, windows, key, weight).

    ``weight`` is 2 where the key's gram is found twice inside the piece, else 1.
    """
    n, span = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return none, none, none, none, none
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(W._BYTE[data] * W._power(W._BASE, n)[:n], out=sums[1:])
    grams = W.mix((sums[gram:] - sums[:-gram]) * W._power(W._INVERSE, n)[: n - gram + 1])
    least = _sliding_min(grams, span)
    first, limit = offsets[long], offsets[long + 1] - length + 1
    depth = np.zeros(len(least) + 1, dtype=np.int8)
    np.add.at(depth, first, 1)
    np.add.at(depth, limit, -1)
    valid = np.cumsum(depth[:-1], dtype=np.int8) > 0
    opens = np.concatenate([[True], least[1:] != least[:-1]])
    opens[first] = True
    starts = np.flatnonzero(opens & valid)
    owner = long[np.searchsorted(first, starts, "right") - 1]
    ends = np.minimum(np.concatenate([starts[1:], [n]]), offsets[owner + 1] - length + 1)
    parts = -(-(ends - starts) // RUN)
    source = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[source] + nth * RUN
    count = np.minimum(ends[source] - begin, RUN)
    key = least[begin]
    # Where a chosen gram stands: count it between the piece's first and last byte.
    # (a gram is chosen by some window if it equals the largest of the windows' least ones over it).
    edge = np.full(span - 1, ~np.uint64(0))
    places = np.flatnonzero(grams == ~_sliding_min(np.concatenate([edge, ~least, edge]), span))
    values, kind = np.unique(grams[places], return_inverse=True)
    ordered = np.sort(kind.astype(np.int64) * (n + 1) + places)
    which = np.searchsorted(values, key).astype(np.int64) * (n + 1)
    weight = np.searchsorted(ordered, which + begin + count - 1 + span - 1, "right") - np.searchsorted(ordered, which + begin, "left")
    return owner[source], begin, count, key.view(np.int64), np.minimum(weight, 2)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(docs[id_col].cast("bigint"), text).alias("uid"), text.alias("text"))


def _index(base: DataFrame) -> DataFrame:
    """One row per text: its size, digests and pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.blocks(batch.column(2)):
                owner, begin, count, key, weight = cut(data, offsets)
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(end - first)]
                ends = pa.array(np.searchsorted(owner, np.arange(end - first + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (key, (begin - offsets[owner]).astype(np.int32), count.astype(np.int32), weight.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), *lists],
                    ["doc_id", "uid", "n_bytes", "sha256", "keys", "starts", "counts", "weights"],
                )

    return base.mapInArrow(run, "doc_id bigint, uid bigint, n_bytes bigint, sha256 string, keys array<bigint>, starts array<int>, counts array<int>, weights array<int>")


def _pid(piece: bytes) -> tuple[int, int]:
    digest = hashlib.md5(piece).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(uid, start, key, hot, bytes) of the pieces of joined rows (uid, text, pieces)."""
    for uid, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        data = text.encode()
        key, start, count, hot = (x.to_numpy(zero_copy_only=False).tolist() for x in own.values.flatten())
        for k, s, c, h in zip(key, start, count, hot):
            yield uid, s, k, h, data[s : s + c + LENGTH - 1]


def _emit_bytes(shards: int):
    """Distinct pieces of a task with their counts; bytes of a piece are sent once by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "key", "p1", "p2", "piece", "n", "hot"]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        def again() -> pa.RecordBatch:
            return table([(k % shards, k, *p, None, n, hot) for p, (k, n, hot) in seen.items() if n])

        seen: dict[tuple[int, int], list] = {}
        out: list[tuple] = []
        for batch in batches:
            for _, _, key, hot, piece in _pieces(batch):
                p = _pid(piece)
                held = seen.get(p)
                if held is None:
                    seen[p] = [key, 0, hot]
                    out.append((key % shards, key, *p, piece, 1, hot))
                else:
                    held[1] += 1
                if len(out) >= 8192:
                    yield table(out)
                    out = []
            if len(seen) > 200_000:
                yield again()
                seen = {}
        yield table(out)
        yield again()

    return run


def _emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each piece stands."""
    for batch in batches:
        rows = [(uid, start, *_pid(piece)) for uid, start, _, _, piece in _pieces(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["uid", "start", "p1", "p2"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of distinct hot pieces (p1, p2, piece, n), as a hash with its count up to 2."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256).to_pydict()
            rows = [(p1, p2, i, *_pid(piece[i : i + LENGTH]), min(n, 2)) for p1, p2, piece, n in zip(*part.values()) for i in range(len(piece) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["p1", "p2", "at", "w1", "w2", "weight"])


def _hot_marks(pieces: DataFrame) -> DataFrame:
    """Covered ranges of distinct hot pieces, from counts of their windows."""
    windows = pieces.mapInArrow(_emit_windows, "p1 bigint, p2 bigint, at int, w1 bigint, w2 bigint, weight int")
    twice = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1")
    # A piece found twice is a repeat as a whole; of the others the repeated windows are looked up.
    found = windows.where("weight = 1").join(twice, ["w1", "w2"]).groupBy("p1", "p2").agg(F.sort_array(F.collect_list("at")).alias("firsts"))
    whole = pieces.where("n > 1").select("p1", "p2", F.array(F.lit(0)).alias("firsts"), F.array(F.octet_length("piece").cast("int")).alias("ends"))
    return found.select("p1", "p2", "firsts", F.transform("firsts", lambda x: x + LENGTH).alias("ends")).unionByName(whole)


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covered byte ranges of sorted window starts."""
    if not len(starts):
        return starts, starts
    breaks = np.flatnonzero(np.diff(starts) > LENGTH)
    return starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])] + LENGTH


def _mark(part: pa.Table) -> pa.Table:
    """Index the pieces of one shard and give back the covered ranges of each marked piece."""
    count: dict[tuple[int, int], int] = {}
    held: dict[tuple[int, int], tuple[int, bytes]] = {}
    for key, p1, p2, piece, n in zip(*(part.column(c).to_pylist() for c in ("key", "p1", "p2", "piece", "n"))):
        count[p1, p2] = count.get((p1, p2), 0) + n
        if piece is not None:
            held[p1, p2] = key, piece
    by_key: dict[int, list[tuple[int, int]]] = {}
    for p, (key, _) in held.items():
        by_key.setdefault(key, []).append(p)
    out: list[tuple] = []

    def add(p: tuple[int, int], starts: np.ndarray) -> None:
        if len(starts):
            first, end = _runs(starts)
            out.append((*p, first.astype(np.int32), end.astype(np.int32)))

    def index(group: list[tuple[int, int]]) -> None:
        found = repeated_starts([held[p][1] for p in group], LENGTH)
        for p, starts in zip(group, found):
            add(p, np.arange(len(held[p][1]) - LENGTH + 1) if count[p] > 1 else starts)

    group: list[tuple[int, int]] = []
    size = 0
    for own in by_key.values():
        if len(own) == 1 and count[own[0]] > 1:  # nothing to compare: the whole piece is a repeat
            add(own[0], np.arange(len(held[own[0]][1]) - LENGTH + 1))
            continue
        group += own
        size += sum(len(held[p][1]) + 1 for p in own)
        if size >= INDEX_BYTES:
            index(group)
            group, size = [], 0
    if group:
        index(group)
    return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int32())), pa.array([r[3] for r in out], pa.list_(pa.int32()))], ["p1", "p2", "firsts", "ends"])


def _spans(base: DataFrame, index: DataFrame, classes: DataFrame) -> DataFrame:
    """(uid, first, end): covered byte ranges of class representatives, not yet merged."""
    one = index.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    rows = one.select("uid", F.explode(F.arrays_zip("keys", "starts", "counts", "weights")).alias("x")).select("uid", F.col("x.keys").alias("key"), F.col("x.starts").alias("start"), F.col("x.counts").alias("windows"), F.col("x.weights").alias("weight"))
    often = rows.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1")
    kept = rows.join(often, "key").select("uid", F.struct("key", "start", "windows", (F.col("n") > HOT).alias("hot")).alias("piece"))
    survivors = save(kept.groupBy("uid").agg(F.collect_list("piece").alias("pieces")), "survivors")  # a text's own pieces
    facts = survivors.select(F.explode("pieces").alias("p")).agg(F.sum(F.col("p.windows") + LENGTH).alias("bytes"), F.count_if("p.hot").alias("hot")).first()
    shards = max(1, -(-(facts.bytes or 0) // SHARD_BYTES))
    joined = base.select("uid", "text").join(survivors, "uid").select("uid", "text", "pieces")
    shipped = joined.mapInArrow(_emit_bytes(shards), "shard int, key bigint, p1 bigint, p2 bigint, piece binary, n bigint, hot boolean")
    marks = shipped.where("not hot").groupBy("shard").applyInArrow(_mark, "p1 bigint, p2 bigint, firsts array<int>, ends array<int>")
    if facts.hot:
        distinct = shipped.where("hot").groupBy("p1", "p2").agg(F.first("piece", ignorenulls=True).alias("piece"), F.sum("n").alias("n"))
        marks = marks.unionByName(_hot_marks(save(distinct, "hot")))
    places = joined.mapInArrow(_emit_places, "uid bigint, start int, p1 bigint, p2 bigint")
    covered = places.join(marks, ["p1", "p2"]).select("uid", "start", F.explode(F.arrays_zip("firsts", "ends")).alias("r"))
    return covered.select("uid", (F.col("start") + F.col("r.firsts")).alias("first"), (F.col("start") + F.col("r.ends")).alias("end"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted, possibly touching ranges."""
    out: list[list[int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def _outcomes(base: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """What is left of each representative that loses bytes: one row per uid."""
    per_text = spans.groupBy("uid").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
    joined = base.select("uid", "text").join(per_text, "uid").select("uid", "text", "ranges")
    schema = "uid bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, found = text.encode(), merged([(r["first"], r["end"]) for r in ranges])
                left, at = [], 0
                for first, end in found:
                    left.append(data[at:first])
                    at = end
                left.append(data[at:])
                kept = b"".join(left)
                # A character that lost some of its bytes is left out of the text.
                rows.append((uid, len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), "".join(x.decode("utf-8", "ignore") for x in left) if with_text else None))
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            names = ["uid", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array([r[4] for r in rows], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(run, schema).dropDuplicates(["uid"])


def _classed(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    base = _base(docs, id_col, text_col)
    index = save(_index(base), "pieces")
    classes = save(index.groupBy("sha256").agg(F.min("uid").alias("rep"), F.count("*").alias("n")), "classes")
    outcomes = _outcomes(base, _spans(base, index, classes), with_text)
    known = index.select("doc_id", "uid", "n_bytes", "sha256").join(classes, "sha256")
    return known.join(outcomes.withColumnRenamed("uid", "rep"), "rep", "left").withColumn("whole", (F.col("n") > 1) & (F.col("n_bytes") >= LENGTH))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    found = _classed(docs, id_col, text_col, with_text=False)
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text; other columns and rows as they are."""
    small_batches(docs.sparkSession)
    found = _classed(docs, id_col, text_col, with_text=True)
    changed = found.where(F.col("whole") | F.col("kept_text").isNotNull()).select("uid", F.when(F.col("whole"), F.lit("")).otherwise(F.col("kept_text")).alias("kept")).dropDuplicates(["uid"])
    own = docs.select(F.xxhash64(docs[id_col].cast("bigint"), F.coalesce(docs[text_col], F.lit(""))).alias("uid"), F.struct("*").alias("own"))
    text = F.coalesce("kept", F.col("own").getField(text_col))
    return own.join(changed, "uid", "left").select(*[(text if c == text_col else F.col("own").getField(c)).alias(c) for c in docs.columns])
