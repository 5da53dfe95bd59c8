"""Recursive means and sliding ranks of long series, without a list of values per row.

``with_ewm`` is a scan in two levels.  Decay is added up along a key; rows fall into blocks in which it grows by
``REACH`` at most, so that weights inside a block stay within double range.  A block's own running sum needs no
other block; the sum that the block before leaves is one carry, and anything older weighs under exp(-REACH).

``with_shares`` counts values of a sliding window with a wavelet matrix over the ranks of a key's values: all rows
of a key go down its log2 levels at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from panelforge.functions.blocks import over_blocks

REACH = 300.0


def decayed_sums(df: DataFrame, decay: Column, terms: dict[str, Column], key: str = "ticker", date: str = "date") -> DataFrame:
    """Add each name: the sum of its term over all rows of a key so far, aged by exp(-decay) from row to row.

    ``decay`` is not negative and under REACH; terms are not null.
    """
    rows = Window.partitionBy(key).orderBy(date)
    block = Window.partitionBy(key, "__block").orderBy(date)
    out = df.withColumn("__age", F.sum(decay).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("__block", F.floor(F.col("__age") / REACH)).withColumn("__age", F.col("__age") - F.col("__block") * REACH)
    inside = block.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"__in_{c}": F.sum(x * F.exp("__age")).over(inside) for c, x in terms.items()})
    gap = F.exp(-(F.col("__block") - F.lag("__block").over(rows)) * REACH)
    out = out.withColumns({f"__carry_{c}": F.lag(f"__in_{c}").over(rows) * gap for c in terms})
    carried = {c: F.coalesce(F.first(f"__carry_{c}").over(inside), F.lit(0.0)) for c in terms}
    sums = {c: (F.col(f"__in_{c}") + carried[c]) * F.exp(-F.col("__age")) for c in terms}
    return out.withColumns(sums).drop("__age", "__block", *[f"__{kind}_{c}" for kind in ("in", "carry") for c in terms])


def with_ewm(df: DataFrame, name: str, x: str, alpha: float, adjust: bool = True, key: str = "ticker", date: str = "date") -> DataFrame:
    """Add ``name``: the exponentially weighted mean of x.  A null inside ages the weights, leading nulls do not count.

    Weights of the rows so far are powers of 1 - alpha; without ``adjust`` a mean of weight 1 and a new value of weight alpha.
    """
    value, base = F.col(x), -math.log(1 - alpha)
    rows = Window.partitionBy(key).orderBy(date)
    if adjust:
        zero, one = F.lit(0.0), F.lit(1.0)
        made = decayed_sums(df, F.lit(base), {"__n": F.coalesce(value, zero), "__d": F.when(value.isNotNull(), one).otherwise(zero)}, key, date)
        mean = F.col("__n") / F.col("__d")
    else:
        # m = (old * m + alpha * x) / (old + alpha), old being (1 - alpha) ** rows since the last value.
        made = df.withColumn("__row", F.row_number().over(rows))
        since = F.col("__row") - F.last(F.when(value.isNotNull(), F.col("__row")), ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, -1))
        made = made.withColumn("__old", F.when(value.isNotNull(), F.exp(-base * since)))
        term = F.when(value.isNull(), 0.0).when(F.col("__old").isNull(), value).otherwise(alpha * value / (F.col("__old") + alpha))
        # A mean older than exp(-40) of the new value's weight is out of double range beside it.
        decay = F.when(F.col("__old").isNotNull(), F.least(F.lit(40.0), -F.ln(F.col("__old") / (F.col("__old") + alpha)))).otherwise(0.0)
        made = decayed_sums(made, decay, {"__n": term}, key, date).drop("__row", "__old")
        mean = F.col("__n")
    # A null leaves the mean as it was.
    made = made.withColumn(name, F.when(value.isNotNull(), mean))
    return made.withColumn(name, F.last(name, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0))).drop("__n", "__d")


def with_ewms(df: DataFrame, *steps: dict[str, tuple[Column, float]], key: str = "ticker", date: str = "date") -> DataFrame:
    """Add each name of each step: the adjusted exponentially weighted mean of its column with its alpha, as ``with_ewm`` gives it.

    A step may use names of the steps before.  All means share the blocks of rows (those of the fastest decay), so the
    table is sorted twice, whatever the number of means; the slowest decay must still fade out over a block.
    """
    bases = {name: -math.log(1 - alpha) for step in steps for name, (_, alpha) in step.items()}
    size = int(REACH / max(bases.values()))
    if size * min(bases.values()) < 40.0:
        raise ValueError(f"smoothing factors of {list(bases)} lie too far apart for one scan")
    row = F.row_number().over(Window.partitionBy(key).orderBy(date)) - 1
    out = df.withColumn("__row", row).withColumn("__block", F.floor(F.col("__row") / size)).withColumn("__row", F.col("__row") % size)
    # Blocks follow the dates, so this is the order of dates; one sort serves windows of keys and of blocks.
    rows = Window.partitionBy(key).orderBy("__block", date)
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(key, "__block").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    for step in steps:
        terms = {}
        for name, (value, _) in step.items():
            grown = F.exp(F.col("__row") * bases[name])
            terms |= {f"__n_{name}": F.when(value.isNotNull(), value * grown).otherwise(0.0), f"__d_{name}": F.when(value.isNotNull(), grown).otherwise(0.0)}
        out = out.withColumns({c: F.sum(x).over(inside) for c, x in terms.items()})
        # What the block before leaves, at this block's start; a key's first block has none.
        last = {f"__c{c}": F.when((F.col("__row") == 0) & (F.col("__block") > 0), F.lag(c).over(rows)) for c in terms}
        out = out.withColumns(last)
        aged = {c: F.coalesce(F.first(f"__c{c}").over(inside), F.lit(0.0)) for c in terms}
        whole = {c: F.col(c) + aged[c] * math.exp(-size * bases[c[4:]]) for c in terms}
        out = out.withColumns({name: F.when(value.isNotNull(), whole[f"__n_{name}"] / whole[f"__d_{name}"]) for name, (value, _) in step.items()})
        # A null leaves the mean as it was.
        out = out.withColumns({name: F.last(name, ignorenulls=True).over(so_far) for name in step}).drop(*terms, *last)
    return out.drop("__row", "__block")


def count_less(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query, how many of ranks[low:high] are under its limit: one pass down a wavelet matrix for all."""
    found = np.zeros(len(limit), dtype=np.int64)
    if not len(ranks) or not len(limit):
        return found
    for bit in range(int(max(ranks.max(), limit.max())).bit_length() - 1, -1, -1):
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        up = (limit >> bit & 1).astype(bool)
        z_low, z_high = zeros[low], zeros[high]
        found += np.where(up, z_high - z_low, 0)
        low, high = np.where(up, zeros[-1] + low - z_low, z_low), np.where(up, zeros[-1] + high - z_high, z_high)
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return found


def sliding_share(values: np.ndarray, known: np.ndarray, n: int, least: int, above: bool) -> np.ndarray:
    """Share of the known values of the last n rows at or below (``above``: at or above) this row's; NaN with fewer than ``least`` or if this one is not known."""
    out = np.full(len(values), np.nan)
    at = np.flatnonzero(known)
    before = np.concatenate([[0], np.cumsum(known)])
    _, ranks = np.unique(values[at], return_inverse=True)
    low, high = before[np.maximum(at - n + 1, 0)], before[at + 1]
    hit = high - low - count_less(ranks, low, high, ranks) if above else count_less(ranks, low, high, ranks + 1)
    out[at] = np.where(high - low >= least, hit / np.maximum(high - low, 1), np.nan)
    return out


def with_shares(df: DataFrame, made: dict[str, str], n: int, least: int, above: bool = False, key: str = "ticker", date: str = "date") -> DataFrame:
    """Add each name of ``made``: the share of the last n values of its column at or below (``above``: at or above) this row's.

    Null if this value is or if fewer than ``least`` of the window are known.
    """
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in made]])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(date, "ascending")]))
        for name, x in made.items():
            column = table[x].combine_chunks().cast(pa.float64())
            share = sliding_share(column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False), n, least, above)
            table = table.append_column(name, pa.array(share, pa.float64(), from_pandas=True))
        return table

    return df.groupBy(key).applyInArrow(run, schema)


def _by_group(df: DataFrame, key: str, schema: StructType, run) -> DataFrame:
    """``run`` over the rows of each key: name -> (values, known) of double columns in, name -> doubles with NaN for null out."""

    def whole(table: pa.Table) -> pa.Table:
        def read(x: str) -> tuple[np.ndarray, np.ndarray]:
            column = table[x].combine_chunks().cast(pa.float64())
            return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)

        made = run(read)
        out = [pa.array(made[f.name], pa.float64(), from_pandas=True) if f.name in made else table[f.name] for f in schema.fields]
        return pa.Table.from_arrays(out, [f.name for f in schema.fields])

    return df.groupBy(key).applyInArrow(whole, schema)


def pct_rank(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Percent rank with average ties over the known values; NaN elsewhere."""
    out = np.full(len(values), np.nan)
    _, place, count = np.unique(values[known], return_inverse=True, return_counts=True)
    out[known] = (np.cumsum(count) - (count - 1) / 2)[place] / max(len(place), 1)
    return out


def with_ranks(df: DataFrame, made: dict[str, str], key: str = "date") -> DataFrame:
    """Add each name of ``made``: the percent rank of its column among the rows of a key, all in one pass over a cross-section."""
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in made]])
    return _by_group(df, key, schema, lambda read: {name: pct_rank(*read(x)) for name, x in made.items()})


def over_sections(df: DataFrame, names: list[str], run: Callable, kept: list[str] | None = None, known: str | None = None, key: str = "date") -> DataFrame:
    """``df`` (or its columns ``kept``) with the doubles that ``run`` makes of the rows of a key, which move as blocks (:func:`over_blocks`).

    ``run``: read -> name: values, NaN for null, where read(x) gives values and known of a double column and read(x, True) the
    numbers of the values of any other.  A name of a column replaces it.  Only rows stay whose ``known`` is not NaN.
    """
    fields = [f for f in df.schema.fields if kept is None or f.name in kept]
    schema = StructType([*[f for f in fields if f.name not in names], *[StructField(name, DoubleType()) for name in names]])

    def whole(table: pa.Table) -> pa.Table:
        def read(x: str, numbered: bool = False):
            array = table[x].combine_chunks()
            if numbered:
                return pc.dictionary_encode(array, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            array = array.cast(pa.float64())
            return array.fill_null(0.0).to_numpy(zero_copy_only=False), array.is_valid().to_numpy(zero_copy_only=False)

        made = run(read)
        out = pa.Table.from_arrays([pa.array(made[f.name], pa.float64(), from_pandas=True) if f.name in made else table[f.name] for f in schema.fields], [f.name for f in schema.fields])
        return out.filter(pa.array(~np.isnan(made[known]))) if known else out

    return over_blocks(df, key, schema, whole)


def filled(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Values, where they are not known their median, else 0."""
    return np.where(known, values, np.median(values[known]) if known.any() else 0.0)


def fill_cross_section(df: DataFrame, columns: list[str], key: str = "date") -> DataFrame:
    """Null becomes the median of the column among the rows of a key, then 0; all columns in one pass."""
    doubles = StructType([StructField(f.name, DoubleType()) if f.name in columns else f for f in df.schema.fields])

    def run(read) -> dict[str, np.ndarray]:
        out = {}
        for x in columns:
            out[x] = filled(*read(x))
        return out

    return _by_group(df, key, doubles, run)
