"""MinHash near-duplicates by an inverted join on signature coordinates.

Texts with equal shingle sets are one node.  A node is posted under each of its COORDINATES
(coordinate, value) pairs.  Two nodes must agree in at least T coordinates, T being the
largest number that a pair at the similarity bound misses with probability MISS at most.
Such a pair meets in one of the K - T + 1 rarest postings of either node, so the T - 1
longest are skipped, and a node with fewer than T shared postings is dropped.

Links are then confirmed on full sets in two rounds.  First each node meets the first node of each
of its postings; the coordinates in which both agree are counted, over the postings that were not
skipped and those that were, and of the pairs with T or more the one with most is compared.
Postings whose nodes are by then in one component need nothing more; in the
others the nodes outside the largest component are compared with all, in tasks that hold two blocks of BLOCK
nodes and give back a spanning set of links, never all pairs.

Defined cases: null and empty texts and texts without words have an empty set and link with
nothing; a text with fewer words than a shingle has its whole sequence as one; repeated rows
are equal sets; rows of one id with other texts are nodes of their own; rows with a null id link
with nothing, have no component and are kept; an empty table gives an empty one; other columns
are not read, or pass through ``keep_first`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm import words as W
from panelforge.llm.components import components
from panelforge.llm.store import save, small_batches

COORDINATES = 32
MISS = 1e-8
BLOCK = 512

_rng = np.random.default_rng(77)
_SALT = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_FACTOR = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def least_matches(similarity: float, k: int = COORDINATES, miss: float = MISS) -> int:
    """Largest T such that a pair of this similarity agrees in fewer than T of k coordinates with probability <= miss."""
    total, t = 0.0, 0
    while t < k:
        total += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if total > miss:
            break
        t += 1
    return max(1, t)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first, end, sets): sorted distinct shingle hashes of each text of a block."""
    for first, end, data, offsets in W.blocks(texts):
        starts, ends, at = W.spans(data, offsets)
        hashed, begin = W.shingles(W.hash_spans(data, starts, ends, lower=True), at, width)
        sets = []
        for i in range(end - first):
            own = hashed[begin[i] : begin[i + 1]]
            own.sort()
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        yield first, end, sets


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, two halves of a set fingerprint, and the signature."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, sets in shingle_sets(batch.column(2), width):
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                print1, print2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                signature = np.zeros((len(sets), COORDINATES), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    print1[full] = np.add.reduceat(W.mix(flat + np.uint64(1)), begin)
                    print2[full] = np.add.reduceat(W.mix(flat ^ np.uint64(0x5DEECE66D1234567)), begin)
                    for k in range(COORDINATES):
                        value = (flat ^ _SALT[k]) * _FACTOR[k]
                        value ^= value >> np.uint64(29)
                        value *= _FACTOR[k - 1]
                        signature[full, k] = np.minimum.reduceat(value, begin)
                    # The coordinate's number lies in the low bits: one long is a (coordinate, value) pair.
                    signature[full] = (signature[full] & np.uint64(~(COORDINATES - 1) & (1 << 64) - 1)) | np.arange(COORDINATES, dtype=np.uint64)
                flat_signature = signature[full].ravel().view(np.int64)
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[1:] = np.cumsum(np.where(sizes > 0, COORDINATES, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(sizes), pa.array(print1.view(np.int64)), pa.array(print2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat_signature))],
                    ["doc_id", "row", "n_shingles", "print1", "print2", "signature"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, row bigint, n_shingles bigint, print1 bigint, print2 bigint, signature array<bigint>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("row"), docs[text_col].alias("text"))


def _similar(common: np.ndarray, n: np.ndarray, m: int, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[s for _, _, part in shingle_sets(batch.column(c), width) for s in part] for c in (2, 3)]
            ok = [bool(_similar(np.int64(len(np.intersect1d(x, y, assume_unique=True))), np.int64(len(x)), len(y), percent)) for x, y in zip(*sets)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _within_blocks(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the two sides of each (key, i, j) group: a spanning set of each group.

    ``rows``: key, i, j, side, node, root, text.  A group holds two blocks at most.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable").reset_index(drop=True)
        nodes, side = part["node"].to_numpy(), part["side"].to_numpy()
        names, root = np.unique(part["root"].to_numpy(), return_inverse=True)
        parent = list(range(len(names)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets = [s for _, _, found in shingle_sets(pa.array(part["text"], pa.large_string()), width) for s in found]
        sizes = np.array([len(s) for s in sets])
        one_block = bool((part["i"] == part["j"]).all())
        other = np.arange(len(nodes)) if one_block else np.flatnonzero(side == 1)
        mine = np.arange(len(nodes)) if one_block else np.flatnonzero(side == 0)
        out = []
        if len(other) and len(mine):
            # Incidence of the other block's shingles, as positions in their sorted distinct values.
            values, place = np.unique(np.concatenate([sets[x] for x in other]), return_inverse=True)
            owner = np.repeat(np.arange(len(other)), sizes[other])
            order = np.argsort(place, kind="stable")
            owner, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(values)))])
            for x in mine:
                at = np.minimum(np.searchsorted(values, sets[x]), len(values) - 1)
                at = at[values[at] == sets[x]]  # a shingle that the other block lacks stands for no other one
                spans = start[at + 1] - start[at]
                index = np.repeat(start[at] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum()) if len(at) else np.zeros(0, np.int64)
                common = np.bincount(owner[index], minlength=len(other))
                for y in other[_similar(common, sizes[other], sizes[x], percent) & (common > 0)]:
                    r, s = find(root[x]), find(root[y])
                    if r != s:
                        parent[max(r, s)] = min(r, s)
                        out.append((nodes[x], nodes[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.groupBy("key", "i", "j").applyInPandas(run, "a bigint, b bigint")


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, n_shingles and first (doc_id, row) of the component of each row of ``docs``."""
    least = least_matches(percent / 100)
    plain = _rows(docs, id_col, text_col)
    marked = save(signatures(docs, width, id_col, text_col), "signatures")
    # A node is a class of equal sets, with a number of its own: rows of one id may be in several.
    full = marked.where("n_shingles > 0 and doc_id is not null")
    nodes = save(full.groupBy("print1", "print2").agg(F.min(F.struct("doc_id", "row")).alias("own"), F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    posts = nodes.select("node", F.explode("signature").alias("key"))
    shared = posts.groupBy("key").count().where("count > 1")
    known = posts.join(shared, "key")
    # Prefix and skip: of m shared postings, the T - 1 most frequent are left out.
    by_count = Window.partitionBy("node").orderBy(F.desc("count"), "key")
    prefix = save(known.withColumn("place", F.row_number().over(by_count)).where(F.col("place") >= least).select("node", "key", "count"), "postings")

    # A node meets the first node of each of its postings.  The collisions in the postings that were not
    # skipped are merged with those in the skipped ones: equal coordinates of both signatures.
    firsts = prefix.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    meets = prefix.join(firsts.select("key", "b"), "key").where("node <> b").select("node", "b").distinct()
    one, other = nodes.select("node", F.col("signature").alias("s")), nodes.select(F.col("node").alias("b"), F.col("signature").alias("t"))
    counted = meets.join(one, "node").join(other, "b").select("node", "b", F.size(F.array_intersect("s", "t")).alias("matches")).where(F.col("matches") >= least)
    best = counted.groupBy("node").agg(F.max_by("b", F.struct(F.col("matches"), -F.col("b"))).alias("b"))
    pairs = save(best.select(F.col("node").alias("a"), "b"), "pairs")
    # Texts of the nodes that are in a posting with another.
    candidates = prefix.join(firsts.select("key"), "key").select("node").distinct().join(nodes.select("node", "own.*"), "node")
    texts = save(plain.join(candidates, ["doc_id", "row"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    found = save(_confirm(pairs, texts, width, percent), "confirmed")
    roots = save(components(found), "roots")

    rooted = prefix.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    # Equal lists of nodes need one comparison: keep the smallest key of each.
    lists = rooted.join(open_keys.select("key", "n"), "key").groupBy("key", "n").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    chosen = lists.groupBy("n", "h").agg(F.min("key").alias("key"))
    members = rooted.join(chosen.select("key"), "key")
    # Nodes of a posting's largest component need no comparison with each other, only with the rest.
    parts = members.groupBy("key", "root").count()
    largest = parts.groupBy("key").agg(F.max_by("root", F.struct(F.col("count"), -F.col("root"))).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n"))
    largest = largest.select("key", "main", F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("n_main") / BLOCK).cast("int").alias("mains"))
    placed_in, in_main = members.join(largest, "key"), F.col("root") == F.col("main")
    hashed = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    placed_in = placed_in.withColumn("block", F.when(in_main, F.col("others") + hashed("mains")).otherwise(hashed("others")))
    # Blocks 0 to others - 1 meet every block once, as (min, max); those of the largest component meet only them.
    dealt = placed_in.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(in_main, 0).otherwise(F.col("mains")))))
    dealt = dealt.select("key", F.least("block", "c").alias("i"), F.greatest("block", "c").alias("j"), (F.col("block") > F.col("c")).cast("int").alias("side"), "node", "root")
    more = _within_blocks(dealt.join(texts, "node"), width, percent)
    final = components(found.unionByName(more))

    # Of each row: its class, the class's component, and that component's smallest row.
    placed = nodes.select("node", "print1", "print2", "own").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("own").alias("first"))
    where = save(placed.join(smallest, "root").select("print1", "print2", "first"), "components")
    out = marked.select("doc_id", "row", "n_shingles", "print1", "print2").join(where, ["print1", "print2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    alone = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))
    return out.select("doc_id", "row", "n_shingles", F.when(linked, F.col("first")).otherwise(alone).alias("first"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of links of ``percent`` or more.

    ``component_id`` is the smallest id of the component; ``kept`` marks rows of that id.
    """
    out = _classes(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id, and of its texts the one with the smallest hash.

    Of repeated rows (equal id and text) one stays; rows with a null id and rows without words stay.
    """
    marked = _classes(docs, width, percent, id_col, text_col)
    gone = marked.where("n_shingles > 0 and (doc_id <> first.doc_id or row <> first.row)").select("doc_id", "row").distinct()
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("row"), F.struct("*").alias("own"))
    left = own.join(gone, ["doc_id", "row"], "left_anti")
    again = save(marked.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row"), "repeated")
    if not again.isEmpty():
        once = left.join(again, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
        left = left.join(again, ["doc_id", "row"], "left_anti").unionByName(once)
    return left.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])
