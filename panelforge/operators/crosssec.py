"""Per-date operators: ranks, sectors, calendar, breadth, market-wide series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from panelforge.functions import windows as W
from panelforge.functions.scans import over_sections, pct_rank, with_ranks, with_shares
from panelforge.functions.windows import EPS, lag, rank_pct, rolling
from panelforge.operators import timeseries as T


def in_sector() -> WindowSpec:
    """Members of a row's sector on its date."""
    return Window.partitionBy("date", "sector")


def ranks(df: DataFrame, *columns: str) -> DataFrame:
    """cs_x: percent rank of each column on its date, all columns in one pass over a cross-section."""
    return with_ranks(df.select("date", "ticker", *columns), {f"cs_{c}": c for c in columns}).select("date", "ticker", *[f"cs_{c}" for c in columns])


def sector_relative(df: DataFrame, x: str) -> DataFrame:
    """x less its sector mean where the sector has more than one member, else x."""
    n = F.count("ticker").over(in_sector())
    return df.withColumn("rel", F.col(x) - F.when(n > 1, F.avg(x).over(in_sector())).otherwise(F.lit(0.0)))


def sector_z(df: DataFrame, x: str, population: bool = False, least: int = 3) -> DataFrame:
    """z-score in the sector; small sectors and ``Unknown`` have none."""
    sd = (F.stddev_pop if population else F.stddev_samp)(x).over(in_sector())
    ok = (F.count(x).over(in_sector()) >= least) & (F.col("sector") != "Unknown")
    return df.withColumn("sector_z", F.when(ok, F.try_divide(F.col(x) - F.avg(x).over(in_sector()), sd)))


def factor_returns(df: DataFrame, x: str) -> DataFrame:
    """Mean return of the top quintile of x less that of the bottom, null as 0; and its 5 and 21 row sums."""
    ranked = df.withColumn("__r", rank_pct(x))
    by = ranked.groupBy("date").agg((F.avg(F.when(F.col("__r") > 0.8, F.col("lr"))) - F.avg(F.when(F.col("__r") < 0.2, F.col("lr")))).alias("f"))
    dated = by.withColumn("factor", F.coalesce("f", F.lit(0.0))).withColumn("ticker", F.lit("all"))
    return dated.withColumns({f"fm_{n}": rolling(F.sum, "factor", n) for n in (5, 21)}).drop("ticker", "f")


def calendar(df: DataFrame) -> DataFrame:
    """Day and month cycles, closeness to a month's turn, and days 15 to 21."""
    pi2 = 6.283185307179586
    d, day = F.col("date"), F.dayofmonth("date")
    turn = F.least(day - 1, F.dayofmonth(F.last_day(d)) - day)
    return df.withColumns({
        "dow_sin": F.sin(F.weekday(d) * pi2 / 5), "dow_cos": F.cos(F.weekday(d) * pi2 / 5),
        "month_sin": F.sin(F.month(d) * pi2 / 12), "month_cos": F.cos(F.month(d) * pi2 / 12),
        "turn": F.exp(-turn / 2.0), "opex": day.between(15, 21).cast("int"),
    })


def breadth(df: DataFrame, *ns: int) -> DataFrame:
    """Share of all tickers above their own n-row mean; a missing comparison is false."""
    above = df.withColumns({f"__a{n}": F.coalesce(F.col("price") > rolling(F.avg, "price", n), F.lit(False)).cast("double") for n in ns})
    return above.groupBy("date").agg(*[F.avg(f"__a{n}").alias(f"above_{n}") for n in ns])


def market_state(df: DataFrame, *ns: int) -> DataFrame:
    """Mean and dispersion of n-row momentum on each date."""
    return T.momentum(df, *ns).groupBy("date").agg(*[F.avg(f"mom_{n}").alias(f"mean_{n}") for n in ns], *[F.stddev_samp(f"mom_{n}").alias(f"disp_{n}") for n in ns])


def macro_features(m: DataFrame, stress: str, long_rate: str, short_rate: str, safe: str, risky: str, momentum: dict[str, str], lags: tuple[int, ...] = (5, 21), n: int = 21) -> DataFrame:
    """Changes of stress over some lags, slope and its change, rate change, log spread of two series and its change,
    and n-row momentum of named series, on one row per date."""
    made = m.withColumn("slope", F.col(long_rate) - F.col(short_rate)).withColumn("spread", F.ln(F.try_divide(safe, risky)))
    k = lags[0]
    return made.withColumns({
        **{f"stress_change_{j}": W.change(stress, j) for j in lags}, "slope_change": F.col("slope") - lag("slope", k), "rate_change": F.col(long_rate) - lag(long_rate, k),
        "spread_change": F.col("spread") - lag("spread", k), **{f"{name}_mom": F.ln(F.try_divide(F.col(c), lag(c, n))) for name, c in momentum.items()},
    })


def broadcast_series(df: DataFrame, dated: DataFrame, *columns: str) -> DataFrame:
    """Attach a date-level series to every ticker; the optimiser broadcasts it where it is small."""
    return df.join(dated.select("date", *columns), "date", "left")


def on_calendar(calendar: DataFrame, series: DataFrame, *columns: str, back: bool = False) -> DataFrame:
    """Date-level series on another calendar: the last value at or before each date, column by column.

    ``back`` also fills the first dates from the first value after them: look-ahead, off by default.
    """
    both = series.select("date", *columns, F.lit(0).alias("__kind")).unionByName(calendar.select("date").distinct().withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    order = Window.orderBy("date", "__kind")  # one row per date
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.last(c, ignorenulls=True).over(before) for c in columns}
    if back:
        filled = {c: F.coalesce(x, F.first(c, ignorenulls=True).over(after)) for c, x in filled.items()}
    return both.withColumns(filled).where("__kind = 1").select("date", *columns)


def sector_momentum(df: DataFrame, n: int = 21) -> DataFrame:
    """Momentum of the own sector's mean price, and the sector's rank among sectors."""
    level = df.groupBy("date", "sector").agg(F.avg("price").alias("p"))
    lr = F.ln(F.col("p") / lag("p", 1, "sector"))
    mom = level.withColumn("__lr", lr).withColumn("etf_mom", rolling(F.sum, "__lr", n, key="sector"))
    strength = mom.withColumn("etf_rank", rank_pct("etf_mom"))
    return df.join(strength.select("date", "sector", "etf_mom", "etf_rank"), ["date", "sector"], "left")


def risk_composite(m: DataFrame, up: list[str], down: list[str], n: int = 126, least: int = 63) -> DataFrame:
    """Mean of the rolling percentiles of some columns and the inverted ones of others; missing ones are left out."""
    made = with_shares(m, {f"__{c}": c for c in up + down}, n, least)
    return made.withColumn("risk_on", W.row_mean(*[F.col(f"__{c}") for c in up], *[1 - F.col(f"__{c}") for c in down])).drop(*[f"__{c}" for c in up + down])


def interactions(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Products of two columns' ranks (a leading ``-`` inverts one), ranked again: one pass over a cross-section, whatever the number of pairs."""
    used = sorted({c.removeprefix("-") for pair in pairs for c in pair})

    def run(read) -> dict[str, np.ndarray]:
        ranks = {c: pct_rank(*read(c)) for c in used}
        rank = lambda c: 1 - ranks[c[1:]] if c[0] == "-" else ranks[c]
        made = {f"x{i}": rank(a) * rank(b) for i, (a, b) in enumerate(pairs)}
        return made | {f"xr{i}": pct_rank(x, ~np.isnan(x)) for i, x in enumerate(made.values())}

    return over_sections(df, [f"{x}{i}" for x in ("x", "xr") for i in range(len(pairs))], run)


def regime_score(m: DataFrame, x: str = "mkt") -> DataFrame:
    """Weighted, clipped ratios of fast to slow averages."""
    parts = [w * W.clip(F.try_divide(rolling(F.avg, x, a, la), rolling(F.avg, x, b, lb)) - 1, -0.1, 0.1) for a, la, b, lb, w in ((5, 5, 20, 15, 0.2), (20, 15, 50, 30, 0.3), (50, 30, 200, 100, 0.5))]
    return m.withColumn("score", W.clip(sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0))), -0.1, 0.1))


def regime_observations(m: DataFrame, market: str, high_yield: str, investment: str, long_bond: str, short_bond: str, stress: str, k: int = 21, n: int = 252, least: int = 63) -> DataFrame:
    """Rows with all five observations as z-scores over n rows: k-row log return and annual deviation of the market,
    k-row changes of the credit and the curve ratio, and the stress level."""
    made = m.withColumns({"__lr": F.ln(F.try_divide(F.col(market), lag(market))), "__c": F.try_divide(high_yield, investment), "__t": F.try_divide(long_bond, short_bond)})
    names = {"o_return": F.ln(F.try_divide(F.col(market), lag(market, k))), "o_vol": rolling(F.stddev_samp, "__lr", k) * math.sqrt(W.YEAR), "o_credit": W.change("__c", k), "o_curve": W.change("__t", k), "o_stress": F.col(stress)}
    known = made.withColumns(names).drop("__lr", "__c", "__t").na.drop(subset=list(names))
    z = {c: (F.col(c) - rolling(F.avg, c, n, least)) / (rolling(F.stddev_samp, c, n, least) + EPS) for c in names}
    return known.withColumns(z).na.drop(subset=list(names))


def regimes(observed: DataFrame) -> DataFrame:
    """A label by the sign of return - vol + credit + curve - stress, and the label's run length."""
    score = F.col("o_return") - F.col("o_vol") + F.col("o_credit") + F.col("o_curve") - F.col("o_stress")
    scored = observed.withColumn("score", score).withColumn("label", F.signum(F.round("score", 9)).cast("int"))
    w = W.by_key()
    fresh = F.when(F.col("label").eqNullSafe(lag("label")), 0).otherwise(1)
    runs = scored.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("duration", F.row_number().over(Window.partitionBy("ticker", "__run").orderBy("date")))


def composite(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.withColumn(name, W.row_mean(*columns))


def latest_static(df: DataFrame, x: str) -> DataFrame:
    """Each ticker's last value on every date: look-ahead, for a latest-date slice only."""
    last = df.where(F.col(x).isNotNull()).groupBy("ticker").agg(F.max_by(x, "date").alias("static"))
    return df.join(last, "ticker", "left")
