"""Cleaning, projection, filters and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions import windows as W


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinite values become null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in columns})


def liquid_tickers(df: DataFrame, rows: int = 252, missing: float = 0.1, dollars: float = 1e7) -> DataFrame:
    """Tickers with enough prices, few gaps and enough mean dollar volume."""
    both = F.col("price").isNotNull() & F.col("volume").isNotNull()
    stats = df.groupBy("ticker").agg(F.count("price").alias("n"), (1 - F.count("price") / F.count("*")).alias("gap"), F.count(F.when(both, 1)).alias("common"), F.avg(F.col("price") * F.col("volume")).alias("adv"))
    return stats.where((F.col("n") >= rows) & (F.col("gap") <= missing) & (F.col("common") >= rows) & (F.col("adv") >= dollars))


def missing_shares(df: DataFrame, *columns: str, target: str | None = None) -> DataFrame:
    """One row per column: share of nulls, among rows with a target if one is named."""
    rows = df.where(F.col(target).isNotNull()) if target else df
    return rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).unpivot([], list(columns), "feature", "missing")


def drop_sparse(df: DataFrame, *columns: str, target: str, most: float = 0.3) -> DataFrame:
    """Drop feature columns with more than ``most`` nulls.  One small row per feature is collected."""
    gone = [r.feature for r in missing_shares(df, *columns, target=target).where(F.col("missing") > most).collect()]
    return df.drop(*gone)


def fill_median(df: DataFrame, *columns: str) -> DataFrame:
    """Null becomes the date's median, then 0."""
    made = {f"__m_{c}": c for c in columns}
    return W.with_medians(df, made, "date").withColumns({c: F.coalesce(c, m, F.lit(0.0)) for m, c in made.items()}).drop(*made)


def quality_gate(df: DataFrame, *columns: str, warn: float = 0.5, fail: float = 0.3) -> DataFrame:
    """total_missing, n_warn (columns over ``warn``) and failed, in one row."""
    shares = missing_shares(df, *columns)
    return shares.agg(F.avg("missing").alias("total_missing"), F.count_if(F.col("missing") > warn).alias("n_warn")).withColumn("failed", F.col("total_missing") > fail)


def clean_symbols(df: DataFrame, symbol: str, exchange: str, exchanges: list[str], *flags: str) -> DataFrame:
    """Upper-case listed symbols without warrants or dotted classes whose ``flags`` (tradable, shortable) all hold."""
    s = F.upper(F.trim(symbol))
    ok = F.col(exchange).isin(exchanges) & ~F.endswith(s, F.lit("W")) & ~F.contains(s, F.lit("."))
    for flag in flags:
        ok = ok & F.coalesce(F.col(flag), F.lit(False))
    return df.where(ok).withColumn("clean", s)


def dashed_symbols(df: DataFrame, symbol: str) -> DataFrame:
    """``clean``: the symbol of an index list with a dash for the dot of a share class."""
    return df.withColumn("clean", F.replace(F.col(symbol), F.lit("."), F.lit("-")))


def capped_universe(df: DataFrame, symbol: str, known: Column, n: int = 500) -> DataFrame:
    """Known names first, then in alphabetical order, n in all (a top-k report)."""
    return df.orderBy(F.when(known, 0).otherwise(1), symbol).limit(n)


def first_positions(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(value).agg(F.min(position).alias("first_at"))


def tradable(df: DataFrame, least: float = 5.0, snapshots: DataFrame | None = None) -> DataFrame:
    """Rows with a price of ``least`` or more (0: any) whose name is in the latest snapshot at or before the date.

    ``snapshots``: date, ticker; a date before the first snapshot, or no snapshots, means no such gate.
    """
    priced = df.where(F.col("price") >= least) if least > 0 else df
    if snapshots is None:
        return priced
    from panelforge.operators.asof import latest_snapshot

    dated = priced.join(latest_snapshot(priced, snapshots), "date")
    named = snapshots.select(F.col("date").alias("snapshot"), "ticker", F.lit(True).alias("__in")).distinct()
    return dated.join(named, ["snapshot", "ticker"], "left").where("snapshot is null or __in").select(*df.columns)


def source_coverage(df: DataFrame, column: str) -> DataFrame:
    """Share of tickers with any value; usable above 30 %."""
    by = df.groupBy("ticker").agg(F.count(column).alias("n"))
    return by.agg(F.avg((F.col("n") > 0).cast("double")).alias("coverage")).withColumn("usable", F.col("coverage") > 0.3)


def business_days(df: DataFrame) -> DataFrame:
    """Monday to Friday between the table's first and last date."""
    return df.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date")).where(F.weekday("date") < 5)


def to_long(df: DataFrame, *features: str) -> DataFrame:
    return df.unpivot(["date", "ticker"], list(features), "feature", "value")


def to_wide(df: DataFrame, *features: str) -> DataFrame:
    return df.groupBy("date", "ticker").pivot("feature", list(features)).agg(F.first("value", ignorenulls=True))


def align_columns(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Exactly the model's columns in its order; those missing are null."""
    return df.select(*keys, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in features])


def clipped(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, W.clip(column, low, high))
