"""Look-back analysis of a book's days, trades and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.aggregates import quantiles
from panelforge.operators.aggregates import quantile_buckets

A = math.sqrt(252)


def day_table(scores: DataFrame, book: DataFrame, daily: DataFrame, regime: DataFrame, breaker: float = -0.03, gate: float | None = None) -> DataFrame:
    """One row of context and result per book date.

    ``scores``: date, ticker, score; ``book``: date, ticker, weight, sector; ``daily``: date, gross, long_pnl,
    short_pnl of the replay (a date without a row earned nothing); ``regime``: date, stress.  The drawdown is
    known after the day's return.
    """
    signal = scores.where("score is not null").groupBy("date").agg(
        F.count("*").alias("n_universe"), F.avg("score").alias("pred_mean"), F.stddev_samp("score").alias("pred_std")
    ).join(quantiles(scores, "score", {"pred_p10": 0.1, "pred_p90": 0.9}, "date"), "date")
    long, short = F.col("weight") > 0, F.col("weight") < 0
    size = F.abs("weight")
    state = book.groupBy("date").agg(
        F.count_if(long).alias("n_long"), F.count_if(short).alias("n_short"), F.coalesce(F.sum(F.when(long, size)), F.lit(0.0)).alias("long_gross"), F.coalesce(F.sum(F.when(short, size)), F.lit(0.0)).alias("short_gross"),
        F.sum(size).alias("gross_exposure"), F.sum("weight").alias("net_exposure"),
    )
    by_sector = book.where(long | short).groupBy("date", long.alias("is_long"), "sector").agg(F.sum(size).alias("v"))
    top = lambda side: F.max_by(F.when(side, F.col("sector")), F.struct(F.when(side, F.col("v")), F.when(side, F.col("sector"))))
    share = lambda side: F.max(F.when(side, F.col("v"))) / F.sum(F.when(side, F.col("v")))
    is_long, is_short = F.col("is_long"), ~F.col("is_long")
    tops = by_sector.groupBy("date").agg(top(is_long).alias("top_long_sector"), share(is_long).alias("top_long_sector_pct"), top(is_short).alias("top_short_sector"), share(is_short).alias("top_short_sector_pct"))
    days = state.join(signal, "date", "left").join(tops, "date", "left").join(regime.select("date", "stress"), "date", "left").join(daily.select("date", F.col("gross").alias("gross_return"), "long_pnl", "short_pnl"), "date", "left").fillna(0.0, ["gross_return", "long_pnl", "short_pnl"])
    path = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    days = days.withColumn("cum_return", F.product(1 + F.col("gross_return")).over(path)).withColumn("peak_return", F.greatest(F.max("cum_return").over(path), F.lit(1.0)))
    gated = F.lit(False) if gate is None else F.coalesce(F.col("stress") > gate, F.lit(False))
    return days.withColumn("current_dd", F.col("cum_return") / F.col("peak_return") - 1).withColumns({"breaker_active": F.col("current_dd") < breaker, "gate_active": gated})


def extremes(df: DataFrame, x: str, n: int, *ties: str) -> DataFrame:
    """kind (worst, best), place and the columns of the n rows with the smallest and the largest x (a top-k report)."""
    low = df.where(F.col(x).isNotNull()).orderBy(F.asc(x), *ties).limit(n)
    high = df.where(F.col(x).isNotNull()).orderBy(F.desc(x), *ties).limit(n)
    place = lambda d, order, kind: d.withColumn("place", F.row_number().over(Window.orderBy(order, *ties))).withColumn("kind", F.lit(kind))  # noqa: E731  n rows
    return place(low, F.asc(x), "worst").unionByName(place(high, F.desc(x), "best"))


def commonality(df: DataFrame, bad: Column, good: Column, *features: str) -> DataFrame:
    """Mean of each feature in bad and good rows, and their distance in mean standard deviations."""
    long = df.withColumn("__group", F.when(bad, "bad").when(good, "good")).where("`__group` is not null").unpivot(["__group"], list(features), "feature", "value")
    of = lambda f, g: f(F.when(F.col("__group") == g, F.col("value")))
    by = long.groupBy("feature").agg(of(F.avg, "bad").alias("bad"), of(F.avg, "good").alias("good"), of(F.stddev_samp, "bad").alias("s1"), of(F.stddev_samp, "good").alias("s2"))
    known = by.where("bad is not null and good is not null")
    return known.withColumn("diff", F.col("bad") - F.col("good")).withColumn("z", F.col("diff") / ((F.col("s1") + F.col("s2")) / 2 + 1e-12)).drop("s1", "s2")


def worst_and_best_quarter(df: DataFrame, x: str) -> tuple[Column, Column]:
    """Predicates of the rows at or under the first and at or over the third quartile of x."""
    low, high = df.agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first().q or (None, None)  # one row per date
    return F.col(x) <= F.lit(low), F.col(x) >= F.lit(high)


def hypotheses() -> list[tuple[str, Column, float]]:
    """The eight standard hypotheses: name, predicate over the day table, factor on matched days (0 skips them; fixed values)."""
    c = F.col
    return [
        ("stress over 30", c("stress") > 30, 0.0), ("stress over 25", c("stress") > 25, 0.0), ("dispersion under 0.005", c("pred_std") < 0.005, 0.0), ("dispersion under 0.001", c("pred_std") < 0.001, 0.0),
        ("drawdown beyond 3 %", c("current_dd") < -0.03, 0.25), ("drawdown beyond 5 %", c("current_dd") < -0.05, 0.5), ("net over 0.6", c("net_exposure") > 0.6, 0.5), ("long sector over 25 %", c("top_long_sector_pct") > 0.25, 0.5),
    ]


def counterfactual(days: DataFrame, scenarios: list[tuple[str, Column, float]], r: str = "gross_return") -> DataFrame:
    """What if the returns of matched days had been multiplied: totals, Sharpe and drawdown before, after and their change.

    Also the mean return of matched and of other days (null without any).  One row per scenario.
    """
    cases = F.array(*[F.struct(F.lit(name).alias("scenario"), F.coalesce(match, F.lit(False)).alias("matched"), F.lit(float(by)).alias("by")) for name, match, by in scenarios])
    rows = days.where(F.col(r).isNotNull()).select("date", F.col(r).alias("r0"), F.inline(cases)).withColumn("r1", F.when(F.col("matched"), F.col("r0") * F.col("by")).otherwise(F.col("r0")))
    path = Window.partitionBy("scenario").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    for k in (0, 1):
        rows = rows.withColumn(f"c{k}", F.product(1 + F.col(f"r{k}")).over(path)).withColumn(f"d{k}", F.col(f"c{k}") / F.max(f"c{k}").over(path) - 1)
    enough = F.count("*") >= 2
    value = lambda x: F.when(enough, x).otherwise(0.0)
    found = [F.count("*").alias("days"), F.count_if("matched").alias("n_matched"), F.avg(F.when(F.col("matched"), F.col("r0"))).alias("matched_mean"), F.avg(F.when(~F.col("matched"), F.col("r0"))).alias("other_mean")]
    for k, name in ((0, "base"), (1, "new")):
        r_ = F.col(f"r{k}")
        found += [value(F.product(1 + r_) - 1).alias(f"{name}_total"), value(F.avg(r_) / (F.stddev_samp(r_) + 1e-12) * A).alias(f"{name}_sharpe"), value(F.min(f"d{k}")).alias(f"{name}_mdd")]
    out = rows.groupBy("scenario").agg(*found)
    return out.withColumns({f"delta_{x}": F.col(f"new_{x}") - F.col(f"base_{x}") for x in ("total", "sharpe", "mdd")})


def regime_table(days: DataFrame, regime: str, n: int = 5, r: str = "gross_return") -> DataFrame:
    """Count, mean in basis points, sum in percent and Sharpe of returns in quantile buckets of a regime column."""
    by = quantile_buckets(days.where(F.col(regime).isNotNull() & F.col(r).isNotNull()), regime, r, n)
    return by.select("bucket", "n", (F.col("mean") * 1e4).alias("mean_bps"), (F.col("total") * 100).alias("sum_pct"), (F.try_divide("mean", "sd") * A).alias("sharpe"))


def worst_windows(windows: DataFrame, ic: str, n: int = 10) -> DataFrame:
    """The n windows with the lowest correlation (a top-k report)."""
    return windows.where(F.col(ic).isNotNull()).orderBy(F.asc(ic), "window").limit(n)


def feature_stability(selected: DataFrame, n: int = 20) -> DataFrame:
    """How many windows chose each feature; the n most frequent (a top-k report).  ``selected``: window, feature."""
    return selected.groupBy("feature").agg(F.count_distinct("window").alias("windows")).orderBy(F.desc("windows"), "feature").limit(n)
