"""Aggregations, top-k and set operations."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions import trees as T
from panelforge.functions.blocks import column, gathered
from panelforge.functions.windows import rank_pct
from panelforge.sources.scratch import sweep, written


BINS = 4096
GROUP = 100_000  # rows of a group that one task may sort
PAIRS = 20_000_000  # pairs of values that one job of ``rank_correlations`` moves


def _counted(df: DataFrame, x: str, *part: str) -> DataFrame:
    """Distinct values of x in each part with __n, their count, and __before, the count of smaller ones.

    A prefix sum in two steps: over bins of equal width between the extremes, then inside a bin, so no task
    sorts a whole part.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(*part, x).agg(F.count("*").alias("__n"))
    ends = values.groupBy(*part).agg(F.min(x).cast("double").alias("__lo"), F.max(x).cast("double").alias("__hi"))
    placed = values.join(ends, [*part]) if part else values.crossJoin(ends)
    binned = placed.withColumn("__bin", _bin(x, F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    sums = binned.groupBy(*part, "__bin").agg(F.sum("__n").alias("__m"))
    sums = sums.withColumn("__low", F.sum("__m").over(Window.partitionBy(*part).orderBy("__bin")) - F.col("__m")).drop("__m")  # BINS + 1 rows of a part at most
    inside = F.sum("__n").over(Window.partitionBy(*part, "__bin").orderBy(x)) - F.col("__n")
    return binned.withColumn("__in", inside).join(sums, [*part, "__bin"]).withColumn("__before", F.col("__low") + F.col("__in")).drop("__bin", "__low", "__in")


def _bin(x: str, low: Column, high: Column) -> Column:
    """Which of BINS bins of equal width between the extremes of its part holds x."""
    return F.coalesce(F.floor(F.try_divide(F.col(x).cast("double") - low, high - low) * BINS), F.lit(0))


def ranked(df: DataFrame, names: dict[str, str], *part: str) -> DataFrame:
    """``df``, which is cheap to read several times, with the ranks that ``pooled_ranks`` gives.

    Rows go to the cells of their value, which are numbered over parts and bins, and are ranked inside them, after the
    number of rows in lower bins of the part: one exchange a column and no join of rows with values.  A cell of one value
    needs no order, so its rows are dealt by hash.  Parts and cells are small tables (BINS + 1 rows a part) and are broadcast.
    """
    own = df.columns
    ends = df.groupBy(*part).agg(*[e for x, m in names.items() for e in (F.min(x).cast("double").alias(f"__lo_{m}"), F.max(x).cast("double").alias(f"__hi_{m}"))])
    ends = ends.withColumn("__part", F.row_number().over(Window.orderBy(*part or ["__lo_" + m for m in names.values()]))).withColumnsRenamed({c: f"__k_{c}" for c in part})  # one row per part
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in part]
    out = df.join(F.broadcast(ends), on, "left") if part else df.crossJoin(F.broadcast(ends))
    cells = {f"__c_{m}": F.when(F.col(x).isNotNull(), F.col("__part") * (BINS + 1) + _bin(x, F.col(f"__lo_{m}"), F.col(f"__hi_{m}"))) for x, m in names.items()}
    out = read = out.select(*own, "__part", *[e.alias(c) for c, e in cells.items()])
    seed = own  # later columns are dealt by the rank before, so that what nobody reads is not moved again
    for x, m in names.items():
        counted = read.where(F.col(x).isNotNull()).groupBy("__part", f"__c_{m}").agg(F.count("*").alias("__n"), (F.min(x) == F.max(x)).alias("__one"))
        below = F.sum("__n").over(Window.partitionBy("__part").orderBy(f"__c_{m}")) - F.col("__n")  # BINS + 1 rows of a part at most
        small = counted.select(f"__c_{m}", F.when(F.col("__one"), below + (F.col("__n") + 1) / 2).otherwise(below).alias("__at"), "__one")
        # Rows without a value, and those of a cell of one value, need no neighbours: negative numbers.
        dealt = F.when(F.coalesce("__one", F.lit(True)), -1 - F.pmod(F.xxhash64(*seed), F.lit(1 << 40))).otherwise(F.col(f"__c_{m}"))
        out = out.join(F.broadcast(small), f"__c_{m}", "left").withColumn(f"__c_{m}", dealt).drop("__one")
        inside = Window.partitionBy(f"__c_{m}").orderBy(x)
        place = F.col("__at") + F.when(F.col(f"__c_{m}") < 0, 0.0).otherwise((F.rank().over(inside) + F.count("*").over(inside)) / 2)
        out, seed = out.withColumn(m, place).drop("__at", f"__c_{m}"), [m]
    return out.drop("__part")


def pooled_ranks(df: DataFrame, names: dict[str, str], *part: str) -> DataFrame:
    """``df`` with the average-tie rank of each named column among the rows of a part that have it (null elsewhere), for parts of any size.

    ``df`` is written once, as it is read several times.
    """
    return ranked(written(df, "ranked"), names, *part)


def _cells(points: list[np.ndarray], rows: list[int]) -> np.ndarray:
    """Upper bounds of cells of about GROUP rows; a value that fills more than a cell gets one of its own."""
    values, place = np.unique(np.concatenate(points), return_inverse=True)
    share = np.cumsum(np.bincount(place, weights=np.repeat([n / max(len(p), 1) for p, n in zip(points, rows)], [len(p) for p in points])))
    n = -(-sum(rows) // GROUP)
    at = values[np.searchsorted(share, share[-1] * np.arange(1, n) / n * (1 - 1e-12)).clip(max=len(values) - 1)]
    often = at[1:][at[1:] == at[:-1]]
    return np.unique(np.concatenate([at, np.nextafter(often, -np.inf)]))


def _centred(x: np.ndarray, below: int, n: int) -> np.ndarray:
    """Average-tie ranks among n values, of which ``below`` lie under all of x, less their mean."""
    _, place, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[place] + below - (n + 1) / 2


def _blobs(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer()) for v in table[name]])


def rank_correlations(df: DataFrame, part: str, y: str, features: list[str]) -> list[tuple[int, int, int, float | None]]:
    """(part, feature, n, rank correlation) of y with each numbered feature over the rows of a numbered part that have both; None where one does not vary.

    ``df`` is cheap to read several times.  Pairs move as packed doubles: those of up to GROUP rows of a part and feature go to one
    place, those of more to the cell of their x, which gives its rank, and on to the cell of their y.  Sketches give the cells,
    a count the rows under a cell, and a cell of one value needs no order, so its pairs are dealt to many places.  A job moves
    about PAIRS pairs, and its files go before the next.
    """
    spark = df.sparkSession
    rows = df.where(F.col(y).isNotNull()).select(F.col(part).cast("int").alias("part"), F.col(y).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    size = 250_000

    def pairs(batches, numbers):
        """number of part and feature, x and y of a block of rows."""
        for table in gathered(batches, size):
            parts, ys = table["part"].to_numpy(), table["y"].to_numpy()
            order = np.argsort(parts, kind="stable")
            names, first = np.unique(parts[order], return_index=True)
            for name, at in zip(names.tolist(), np.split(order, first[1:])):
                for i in numbers:
                    x = table[f"x{i}"].take(pa.array(at)).combine_chunks()
                    has = at if not x.null_count else at[x.is_valid().to_numpy(zero_copy_only=False)]
                    if len(has):
                        yield name * len(features) + i, x.drop_null().to_numpy(), ys[has]

    def sketched(batches):
        for k, x, v in pairs(batches, range(len(features))):
            yield pa.RecordBatch.from_pydict({"k": [k], "n": [len(x)], "points": [pickle.dumps((T.sketch(x), T.sketch(v)))]})

    seen = {}
    for r in rows.mapInArrow(sketched, "k long, n long, points binary").collect():
        seen.setdefault(r.k, []).append((r.n, pickle.loads(r.points)))
    total = {k: sum(n for n, _ in s) for k, s in seen.items()}
    bounds = {}
    for k, s in seen.items():
        if total[k] > GROUP:
            bounds[k] = tuple(_cells([p[side] for _, p in s], [n for n, _ in s]) for side in (0, 1))
    below, one = {}, {}
    if bounds:

        def counted(batches):
            for k, *xy in pairs(batches, sorted({k % len(features) for k in bounds})):
                if k in bounds:
                    for side, x in enumerate(xy):
                        cell = np.searchsorted(bounds[k][side], x)
                        names, n = np.unique(cell, return_counts=True)
                        order = np.argsort(cell, kind="stable")
                        runs = np.split(x[order], np.cumsum(n)[:-1])
                        yield pa.RecordBatch.from_pydict({"k": [k] * len(n), "side": [side] * len(n), "cell": names.tolist(), "n": n.tolist(), "lo": [float(v.min()) for v in runs], "hi": [float(v.max()) for v in runs]})

        found = rows.mapInArrow(counted, "k long, side long, cell long, n long, lo double, hi double").groupBy("k", "side", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        for r in sorted(found, key=lambda r: (r.k, r.side, r.cell)):
            at = below.setdefault((r.k, r.side), {})
            at[r.cell] = (sum(n for _, n in at.values()), r.n)
            one[r.k, r.side, r.cell] = r.lo == r.hi

    def key(k: int, side: int, cell: int, salt: int) -> int:
        return (k << 32) | (cell << 12) | (salt % 4096 if one.get((k, side, cell)) else 0)

    def dealt(k: int, side: int, xy: tuple, salt: int):
        """The pairs by the cells of one side: keys and packed sides."""
        cell = np.searchsorted(bounds[k][side], xy[side])
        order = np.argsort(cell, kind="stable")
        names, first = np.unique(cell[order], return_index=True)
        for name, at in zip(names.tolist(), np.split(order, first[1:])):
            yield key(k, side, name, salt), xy[0][at].tobytes(), xy[1][at].tobytes()

    def ranks(table: pa.Table, side: int, x: np.ndarray) -> np.ndarray:
        at = table["key"][0].as_py()
        k, cell = at >> 32, (at >> 12) & 0xFFFFF
        under, n = below[k, side][cell]
        return np.full(len(x), under + (n + 1) / 2 - (total[k] + 1) / 2) if one[k, side, cell] else _centred(x, under, total[k])

    def batch(made: list) -> pa.RecordBatch:
        made = list(zip(*made)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.binary()), pa.array(made[2], pa.binary())], ["key", "x", "y"])

    def sums(k: int, a: np.ndarray, b: np.ndarray) -> pa.Table:
        return pa.table({"k": [k], "aa": [float(a @ a)], "bb": [float(b @ b)], "ab": [float(a @ b)]})

    def first_side(table: pa.Table) -> pa.Table:
        x, v = _blobs(table, "x"), _blobs(table, "y")
        at = table["key"][0].as_py()
        return pa.Table.from_batches([batch(list(dealt(at >> 32, 1, (ranks(table, 0, x), v), (at >> 12) + at)))])

    def second_side(table: pa.Table) -> pa.Table:
        a, v = _blobs(table, "x"), _blobs(table, "y")
        return sums(table["key"][0].as_py() >> 32, a, ranks(table, 1, v))

    def whole(table: pa.Table) -> pa.Table:
        x, v = _blobs(table, "x"), _blobs(table, "y")
        return sums(table["key"][0].as_py(), _centred(x, 0, len(x)), _centred(v, 0, len(v)))

    added: dict = {}
    packed, out = "key long, x binary, y binary", "k long, aa double, bb double, ab double"

    def add(frame: DataFrame) -> None:
        for r in frame.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("aa", "bb", "ab")]).collect():
            added[r.k] = (r.aa, r.bb, r.ab)

    weight = [sum(n for k, n in total.items() if k % len(features) == i) for i in range(len(features))]
    jobs, held = [], 0
    for i, n in enumerate(weight):
        if not jobs or held + n > PAIRS:
            jobs.append([])
            held = 0
        jobs[-1].append(i)
        held += n
    for numbers in jobs:
        own = rows.select("part", "y", *[f"x{i}" for i in numbers])

        def small(batches, numbers=numbers):
            for k, x, v in pairs(batches, numbers):
                if k not in bounds:
                    yield batch([(k, x.tobytes(), v.tobytes())])

        def large(batches, numbers=numbers):
            for salt, (k, x, v) in enumerate(pairs(batches, numbers)):
                if k in bounds:
                    yield batch(list(dealt(k, 0, (x, v), salt)))

        mine = {k for k in total if k % len(features) in numbers}
        if mine - set(bounds):
            add(own.mapInArrow(small, packed).groupBy("key").applyInArrow(whole, out))
        if mine & set(bounds):
            add(own.mapInArrow(large, packed).groupBy("key").applyInArrow(first_side, packed).groupBy("key").applyInArrow(second_side, out))
        if len(jobs) > 1:
            sweep(spark)
    return [(k // len(features), k % len(features), total[k], ab / (aa * bb) ** 0.5 if aa * bb > 0 else None) for k, (aa, bb, ab) in sorted(added.items())]


def _places(shares: dict[str, float], total: Column) -> dict[str, Column]:
    """Place (from 0) of each quantile among that many values."""
    return {name: (total - 1) * F.lit(float(q)) for name, q in shares.items()}


def _interpolated(shares: dict[str, float], *by: str) -> list[Column]:
    return [*by, *[(F.col(f"__l_{m}") + (F.col(f"__h_{m}") - F.col(f"__l_{m}")) * F.col(f"__f_{m}")).alias(m) for m in shares]]


def _of_counts(rows: DataFrame, x: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Quantiles from counts of distinct values and their prefix sums, so no task holds or sorts a group."""
    counted = _counted(rows, x, *by)
    if by:
        totals = counted.groupBy(*by).agg(F.sum("__n").alias("__total"))
        counted = counted.join(totals, [*by])
    else:
        counted = counted.crossJoin(counted.agg(F.sum("__n").alias("__total")))
    at = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__n")), F.col(x).cast("double")))
    ends = [e for name, p in _places(shares, F.col("__total")).items() for e in (at(F.floor(p)).alias(f"__l_{name}"), at(F.ceil(p)).alias(f"__h_{name}"), F.max(p - F.floor(p)).alias(f"__f_{name}"))]
    return counted.groupBy(*by).agg(*ends).select(*_interpolated(shares, *by))


def _of_places(rows: DataFrame, x: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Quantiles from row numbers: a group is sorted, and spilled where it must, in one task after one exchange."""
    own = Window.partitionBy(*by)
    placed = rows.withColumns({"__i": F.row_number().over(own.orderBy(x)) - 1, "__total": F.count("*").over(own)})
    at = lambda k: F.max(F.when(F.col("__i") == k, F.col(x).cast("double")))
    ends = [e for name, p in _places(shares, F.col("__total")).items() for e in (at(F.floor(p)).alias(f"__l_{name}"), at(F.ceil(p)).alias(f"__h_{name}"), F.max(p - F.floor(p)).alias(f"__f_{name}"))]
    return placed.groupBy(*by).agg(*ends).select(*_interpolated(shares, *by))


def _quantiles(rows: DataFrame, x: str, shares: dict[str, float], *by: str) -> DataFrame:
    """``quantiles`` of a table that is cheap to read several times."""
    rows = rows.where(F.col(x).isNotNull()).select(*by, x)
    if not by:
        return _of_counts(rows, x, shares)
    # At most one group in GROUP rows is large, so their names are a small table.
    large = F.broadcast(rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > GROUP).select(*by))
    few = _of_places(rows.join(large, [*by], "left_anti"), x, shares, *by)
    return few.unionByName(_of_counts(rows.join(large, [*by], "left_semi"), x, shares, *by))


def quantiles(df: DataFrame, x: str, shares: dict[str, float], *by: str) -> DataFrame:
    """The group and, for each name of ``shares``, the exact quantile of x with linear interpolation; groups without a value have no row.

    Groups of up to GROUP rows by row numbers, larger ones by counts of distinct values, so no task sorts a large group.
    ``df`` is written once, as it is read several times.
    """
    return _quantiles(written(df.where(F.col(x).isNotNull()).select(*by, x), "quantiles"), x, shares, *by)


def moments(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Mean, deviation, bias-corrected skewness and excess kurtosis, median and outer deciles of each group."""
    df = written(df.select(*by, x), "moments")  # read several times
    n, g, k = F.count(x), F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))
    plain = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), skew.alias("skew"), kurt.alias("kurt"))
    cuts = _quantiles(df, x, {"med": 0.5, "p10": 0.1, "p90": 0.9}, *by)
    return plain.join(cuts, [*by], "left") if by else plain.crossJoin(cuts)


def correlations(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson, and Spearman as Pearson of average-tie ranks, over rows that have both."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": rank_pct(x, *by), "__y": rank_pct(y, *by)})
    return both.groupBy(*by).agg(F.corr(x, y).alias("pearson"), F.corr("__x", "__y").alias("spearman"))


def top_sector(df: DataFrame, x: str) -> DataFrame:
    """The sector with most of x on each date, and its share."""
    sums = df.groupBy("date", "sector").agg(F.sum(x).alias("v"))
    return sums.groupBy("date").agg(F.max_by("sector", F.struct("v", "sector")).alias("top"), (F.max("v") / F.sum("v")).alias("share"))


def resample(df: DataFrame, unit: str, r: str = "lr") -> DataFrame:
    """Compounded and summed log returns of each ticker by week or month."""
    return df.where(F.col(r).isNotNull()).groupBy(F.date_trunc(unit, "date").cast("date").alias(unit), "ticker").agg((F.exp(F.sum(r)) - 1).alias("comp"), F.sum(r).alias("total"))


def ewm_covariance(m: DataFrame, columns: list[str], halflife: float) -> DataFrame:
    """Exponentially weighted covariance of date-level series; means are removed unweighted."""
    everything = Window.partitionBy()
    made = m.withColumn("__w", F.pow(F.lit(0.5), (F.row_number().over(Window.orderBy(F.desc("date"))) - 1) / halflife)).withColumns({f"__{c}": F.col(c) - F.avg(c).over(everything) for c in columns})
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = made.agg(*[(F.sum(F.col("__w") * F.col(f"__{a}") * F.col(f"__{b}")) / F.sum("__w")).alias(f"{a}|{b}") for a, b in pairs])
    return row.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "cov").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "cov")


def weighted_mean(df: DataFrame, x: str, w: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(w)).alias("wm"))


def quantile_buckets(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """Statistics of y in quantile buckets of x; equal cut points are one (right-closed buckets).

    The cut points come from the counts of distinct values: the value at a place and, between
    two places, a linear mix, as a quantile of all rows would give.
    """
    df = written(df, "buckets")  # read several times
    counted = _counted(df, x)
    total = counted.agg(F.sum("__n").alias("rows"))
    wanted = total.select("rows", F.inline(F.array(*[F.struct(F.lit(i / n).alias("q")) for i in range(1, n)]))).withColumn("h", F.col("q") * (F.col("rows") - 1))
    held = counted.select(F.col(x).cast("double").alias("v"), F.col("__before").alias("a"), (F.col("__before") + F.col("__n")).alias("b"))
    at = lambda k: F.max(F.when((F.col("a") <= k) & (k < F.col("b")), F.col("v")))
    low, high = F.floor("h"), F.ceil("h")
    # n - 1 rows meet the distinct values: a broadcast of n - 1 rows.
    cut = held.crossJoin(F.broadcast(wanted)).where(((F.col("a") <= low) & (low < F.col("b"))) | ((F.col("a") <= high) & (high < F.col("b")))).groupBy("q", "h").agg(at(low).alias("lo"), at(high).alias("hi"))
    cuts = cut.agg(F.array_distinct(F.array_sort(F.collect_list(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))))).alias("cuts"))  # n - 1 values
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(x))))
    return placed.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.sum(y).alias("total"))


def item_frequency(df: DataFrame, items: str) -> DataFrame:
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def top_by_date(df: DataFrame, x: str, n: int, smallest: bool = False) -> DataFrame:
    """The n largest (or smallest) of each date, ties by ticker (a top-k report)."""
    w = Window.partitionBy("date").orderBy(F.asc(x) if smallest else F.desc(x), "ticker")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def set_operations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union, intersection and difference of two key sets, marked by kind."""
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.distinct().join(b, "k", "left_anti"))]
    out = None
    for kind, df in parts:
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out
