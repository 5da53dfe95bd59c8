"""Centroid clustering by equal-average equal-variance search, in exact integers.

Centroids are sorted by their component sums.  A vector scans them outward from its own
sum and keeps the best squared distance so far.  With S the sum of components and D the
deviation sqrt(d * sum of squares - S * S), d components give

    d * distance >= (S - S')**2                    all centroids farther out are rejected
    d * distance >= (S - S')**2 + (D - D')**2      this centroid is rejected

and what is left is measured in integers; ties go to the smaller number.  The scan runs
for a block of vectors at once.  Rounds are Spark jobs: each task adds up the vectors of each
centroid, and only clusters x (components + 1) sums come to the driver, whatever the table's size.

Defined cases: vectors that are null, have another number of components or hold a null or
non-finite one are left out; repeated rows and ids count each by itself; rows with a null id never
seed; fewer vectors than clusters give fewer centroids; an empty table gives an empty one; other
columns are not read.  Components beyond 2**30 / d are measured in unbounded integers; a distance or a sum
that no long holds raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.store import save

SCALE = 1024
#: Vectors measured at once.
BLOCK = 8192


def integer_vectors(vectors: DataFrame, components: int = 64, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, floor(scale * component) of the vectors that are whole."""
    x = F.col("raw")
    whole = (F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("raw")).where(whole)
    return rows.select("vec_id", F.transform("raw", lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")).alias("x"))


def seeds(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``; ties by components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select(mark.alias("mark"), "x").orderBy(F.asc_nulls_last("mark"), "x").limit(clusters).collect()
    return np.array([r.x for r in rows if r.mark is not None], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of each row, and how many distances were measured."""
    n, k, d = len(x), len(centroids), x.shape[1]
    # Below this size of a component all bounds fit 64-bit integers.
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) >= (1 << 30) // d:
        wide, far = x.astype(object), centroids.astype(object)
        all_ = np.stack([((wide - c) ** 2).sum(axis=1) for c in far], axis=1)
        label = np.array([min(range(k), key=row.__getitem__) for row in all_], dtype=np.int64)
        return label, np.array([int(row[i]) for row, i in zip(all_, label)], dtype=np.int64), n * k
    # Components of one centroid that the vectors are compared with, in the order of their sums.
    sums = centroids.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, sorted_ = sums[order], centroids[order]
    deviations = np.sqrt((d * (sorted_ * sorted_).sum(axis=1) - sums * sums).astype(float))
    own = x.sum(axis=1)
    spread = np.sqrt((d * (x * x).sum(axis=1) - own * own).astype(float))
    right = np.searchsorted(sums, own)
    left = right - 1
    label, best = np.full(n, k), np.full(n, (1 << 62) // d)
    open_, measured, end = np.arange(n), 0, np.int64(1 << 40)
    for _ in range(k):
        below = np.where(left[open_] >= 0, own[open_] - sums[np.maximum(left[open_], 0)], end)
        above = np.where(right[open_] < k, sums[np.minimum(right[open_], k - 1)] - own[open_], end)
        gap = np.minimum(below, above)
        # Mean inequality: nothing farther out on either side can be nearer.
        near = (gap < end) & ((np.minimum(gap, 1 << 31) ** 2 <= d * best[open_]))
        open_, gap, down = open_[near], gap[near], (below <= above)[near]
        if not len(open_):
            break
        at = np.where(down, left[open_], right[open_])
        left[open_[down]] -= 1
        right[open_[~down]] += 1
        # Deviation inequality, with room for rounding.
        apart = np.maximum(np.abs(spread[open_] - deviations[at]) - 1e-3, 0.0)
        hold = (gap.astype(float) ** 2 + apart**2) * (1 - 1e-12) <= (d * best[open_]).astype(float) + 1.0
        row, at = open_[hold], at[hold]
        if len(row):
            step = x[row] - sorted_[at]
            found, number = (step * step).sum(axis=1), order[at]
            measured += len(row)
            better = (found < best[row]) | ((found == best[row]) & (number < label[row]))
            best[row[better]], label[row[better]] = found[better], number[better]
    return label, best, measured


def _blocks(batch: pa.RecordBatch, components: int) -> Iterator[tuple[int, int, np.ndarray]]:
    values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
    for first in range(0, len(values), BLOCK):
        yield first, min(first + BLOCK, len(values)), values[first : first + BLOCK]


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance.  A map over rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, x in _blocks(batch, centroids.shape[1]):
                label, distance, _ = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(label.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "x").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster_sums(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, place, total: sums of the components of each cluster's vectors; place -1 counts them.

    Tasks add up their own vectors first, so the shuffle carries clusters x (components + 1) rows a task.
    """
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, d + 1), dtype=object)
        for batch in batches:
            for _, _, x in _blocks(batch, d):
                label = nearest(x, centroids)[0]
                for number in np.unique(label):
                    mine = x[label == number]
                    totals[number, 0] += len(mine)
                    totals[number, 1:] += mine.sum(axis=0) if np.abs(mine).max() < 1 << 48 else mine.astype(object).sum(axis=0)
        cluster, place = np.divmod(np.arange(k * (d + 1)), d + 1)
        some = np.flatnonzero(totals[:, 0].astype(bool)[cluster])
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster[some].astype(np.int32)), pa.array((place[some] - 1).astype(np.int32)), pa.array([int(v) for v in totals.ravel()[some]], pa.int64())],
            ["cluster", "place", "total"],
        )

    return kept.select("vec_id", "x").mapInArrow(run, "cluster int, place int, total bigint").groupBy("cluster", "place").agg(F.sum("total").alias("total"))


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floor of the mean of each cluster; an empty one stays."""
    sums = {(r.cluster, r.place): r.total for r in cluster_sums(kept, centroids).collect()}
    out = centroids.copy()
    for number in range(len(centroids)):
        if count := sums.get((number, -1)):
            out[number] = [sums[number, place] // count for place in range(centroids.shape[1])]
    return out


def fit(kept: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids after ``rounds`` rounds, from ``seeds``."""
    centroids = seeds(kept, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(kept, centroids)
    return centroids


def digest(centroid: np.ndarray) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, components: int = 64, clusters: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector.

    The integer vectors are written once and read in every round; they are smaller than the source.
    """
    kept = save(integer_vectors(vectors, components, id_col=id_col, vector_col=vector_col), "vectors")
    centroids = fit(kept, clusters, rounds, seed)
    if not len(centroids):
        return kept.where("false").selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    placed = save(assign(kept, centroids), "placed")
    parts = {r.cluster: r.total for r in placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = F.array(*[F.struct(F.lit(parts.get(i, 0)).cast("bigint").alias("inertia"), F.lit(digest(c)).alias("sha")) for i, c in enumerate(centroids)])
    own = F.element_at(facts, F.col("cluster") + 1)
    return placed.select("vec_id", "cluster", "distance", own["inertia"].alias("cluster_inertia"), F.lit(sum(parts.values())).cast("bigint").alias("inertia"), own["sha"].alias("centroid_sha256"))
