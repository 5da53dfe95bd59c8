"""Per-entity window features.  Every function is DataFrame -> DataFrame, pure and lazy.

Inputs are dense panels (one row per calendar date and ticker), so a window of n rows is n
calendar rows and is null unless all of them have a value.  All windows of a function share
one partitioning and ordering, so Spark sorts each ticker once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import windows as W
from panelforge.functions.scans import with_ewm, with_ewms, with_shares
from panelforge.functions.windows import EPS, YEAR, lag, rolling, trailing

A = math.sqrt(YEAR)
MONTH = 21


def momentum(df: DataFrame, *ns: int) -> DataFrame:
    """mom_n: sum of the last n log returns.

    Spark goes through a whole window for each row, so windows of several times MONTH rows are added up from those of MONTH rows.
    """
    long = [n for n in ns if n > MONTH and n % MONTH == 0]
    out = df.withColumns({f"mom_{n}": rolling(F.sum, "lr", n) for n in ns if n not in long})
    if not long:
        return out
    out = out.withColumns({"__s": F.coalesce(F.sum("lr").over(trailing(MONTH)), F.lit(0.0)), "__n": F.count("lr").over(trailing(MONTH))})
    parts = range(0, max(long), MONTH)
    out = out.withColumns({f"{c}{k}": F.coalesce(lag(c, k), F.lit(0)) for c in ("__s", "__n") for k in parts if k} | {"__s0": F.col("__s"), "__n0": F.col("__n")})
    added = lambda c, n: sum((F.col(f"{c}{k}") for k in range(MONTH, n, MONTH)), F.col(f"{c}0"))
    out = out.withColumns({f"mom_{n}": F.when(added("__n", n) >= n, added("__s", n)) for n in long})
    return out.select(*df.columns, *[f"mom_{n}" for n in ns])


def skip_momentum(df: DataFrame, *ns: int) -> DataFrame:
    """skip_n: the n-1 returns before the last one."""
    out = {}
    for n in ns:
        w = W.by_key().rowsBetween(-(n - 1), -1)
        out[f"skip_{n}"] = F.when(F.count("lr").over(w) == n - 1, F.sum("lr").over(w))
    return df.withColumns(out)


def year_less_month(df: DataFrame, long: int = 252, short: int = 21) -> DataFrame:
    """mom_12m_1m: returns from long-1 to short rows ago."""
    w = W.by_key().rowsBetween(-(long - 1), -short)
    return df.withColumn("mom_12m_1m", F.when(F.count("lr").over(w) == long - short, F.sum("lr").over(w)))


def acceleration(df: DataFrame, *ns: int) -> DataFrame:
    """accel_n: momentum less the momentum n rows ago."""
    out = momentum(df, *ns)
    return out.withColumns({f"accel_{n}": F.col(f"mom_{n}") - lag(f"mom_{n}", n) for n in ns})


def mean_reversion(df: DataFrame, *ns: int) -> DataFrame:
    """to_mean_n: price against its moving average; z_n: z-score of the last return."""
    return df.withColumns({f"to_mean_{n}": F.try_divide("price", rolling(F.avg, "price", n)) - 1 for n in ns} | {f"z_{n}": (F.col("lr") - rolling(F.avg, "lr", n)) / (rolling(F.stddev_samp, "lr", n) + EPS) for n in ns})


def range_distance(df: DataFrame, *ns: int) -> DataFrame:
    """to_high_n, to_low_n: price against the window's extremes."""
    return df.withColumns({f"to_high_{n}": F.try_divide("price", rolling(F.max, "price", n)) - 1 for n in ns} | {f"to_low_{n}": F.try_divide("price", rolling(F.min, "price", n)) - 1 for n in ns})


def volatility(df: DataFrame, *ns: int) -> DataFrame:
    """vol_n: annualised realised volatility."""
    return df.withColumns({f"vol_{n}": rolling(F.stddev_samp, "lr", n) * A for n in ns})


def vol_ratio(df: DataFrame, short: int = 5, long: int = 63) -> DataFrame:
    return df.withColumn("vol_ratio", rolling(F.stddev_samp, "lr", short) / (rolling(F.stddev_samp, "lr", long) + EPS))


def shape(df: DataFrame, *ns: int) -> DataFrame:
    """skew_n, kurt_n: bias-corrected moments of the last n returns."""
    return df.withColumns({f"skew_{n}": rolling(W.skew(n), "lr", n) for n in ns} | {f"kurt_{n}": rolling(W.kurtosis(n), "lr", n) for n in ns})


def up_down_vol(df: DataFrame, *ns: int) -> DataFrame:
    up = F.when(F.col("lr").isNotNull(), F.greatest("lr", F.lit(0.0)))
    down = F.when(F.col("lr").isNotNull(), F.least("lr", F.lit(0.0)))
    return df.withColumns({f"updown_{n}": rolling(F.stddev_samp, up, n) / (rolling(F.stddev_samp, down, n) + EPS) for n in ns})


def volume_features(df: DataFrame, *ns: int) -> DataFrame:
    """Volume surprise, log mean dollar volume and the 5 against 21 row trend."""
    dollars = F.col("price") * F.col("volume")
    out = {f"surprise_{n}": F.col("volume") / (rolling(F.avg, "volume", n) + 1) - 1 for n in ns}
    out |= {f"log_dollar_{n}": F.log1p(rolling(F.avg, dollars, n)) for n in ns}
    return df.withColumns(out | {"trend": rolling(F.avg, "volume", 5) / (rolling(F.avg, "volume", 21) + 1) - 1})


def illiquidity(df: DataFrame, *ns: int) -> DataFrame:
    """illiq_n: log of the mean absolute return per dollar traded, in millionths."""
    x = F.abs("lr") / (F.col("price") * F.col("volume") + 1)
    return df.withColumns({f"illiq_{n}": F.log1p(rolling(F.avg, x, n) * 1e6) for n in ns})


def smoothing_residual(df: DataFrame, *alphas: float) -> DataFrame:
    """resid_a: price against its recursive exponential mean."""
    out = df
    for a in alphas:
        s = F.col("__s")
        out = with_ewm(out, "__s", "price", a, adjust=False).withColumn(f"resid_{round(a * 100)}", (F.col("price") - s) / (s + EPS)).drop("__s")
    return out


def decay_momentum(df: DataFrame, *halflives: int) -> DataFrame:
    means = with_ewms(df, {f"decay_{h}": (F.col("lr"), W.halflife(h)) for h in halflives})
    return means.withColumns({f"decay_{h}": F.col(f"decay_{h}") * A for h in halflives})


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength from simple means of gains and losses."""
    d = F.col("price") - lag("price")
    stepped = df.withColumn("__d", d)
    gain = rolling(F.avg, F.when(F.col("__d").isNotNull(), F.greatest("__d", F.lit(0.0))), n)
    loss = rolling(F.avg, F.when(F.col("__d").isNotNull(), -F.least("__d", F.lit(0.0))), n)
    return stepped.withColumn("rsi", 100 - 100 / (1 + gain / (loss + EPS))).drop("__d")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mean, sd = rolling(F.avg, "price", n), rolling(F.stddev_samp, "price", n)
    return df.withColumn("boll_pos", (F.col("price") - (mean - k * sd)) / (2 * k * sd + EPS)).withColumn("boll_width", 2 * k * sd / (mean + EPS))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD histogram against price."""
    line = F.col("__f") - F.col("__s")
    means = with_ewms(df, {"__f": (F.col("price"), W.span(fast)), "__s": (F.col("price"), W.span(slow))}, {"__l": (line, W.span(signal))})
    return means.withColumn("macd", F.try_divide(line - F.col("__l"), "price")).drop("__f", "__s", "__l")


def risk_adjusted_momentum(df: DataFrame, *ns: int) -> DataFrame:
    return df.withColumns({f"ram_{n}": rolling(F.sum, "lr", n) * YEAR / n / (rolling(F.stddev_samp, "lr", n) * A + EPS) for n in ns})


def positive_share(df: DataFrame, *ns: int) -> DataFrame:
    """Share of rows with a positive return; a missing return counts as not positive."""
    up = F.when(F.coalesce(F.col("lr") > 0, F.lit(False)), 1.0).otherwise(0.0)
    return df.withColumns({f"up_{n}": rolling(F.avg, up, n) for n in ns})


def momentum_drawdown(df: DataFrame, *ns: int) -> DataFrame:
    """Momentum against its own maximum of the last n rows, as far as there are any."""
    out = momentum(df, *ns)
    return out.withColumns({f"dd_{n}": F.col(f"mom_{n}") - rolling(F.max, f"mom_{n}", n, 1) for n in ns})


def trend_slope(df: DataFrame, *ns: int) -> DataFrame:
    """Least-squares slope of log price on the row number."""
    numbered = df.withColumn("__i", F.row_number().over(W.by_key()).cast("double")).withColumn("__y", F.ln(F.when(F.col("price").isNotNull(), F.greatest("price", F.lit(1e-6)))))
    out = numbered.withColumns({f"slope_{n}": F.when(F.count("__y").over(trailing(n)) == n, F.regr_slope("__y", "__i").over(trailing(n))) for n in ns})
    return out.drop("__i", "__y")


def reversal(df: DataFrame, *ns: int) -> DataFrame:
    return df.withColumns({f"rev_{n}": -rolling(F.sum, "lr", n) for n in ns})


def volume_weighted_reversal(df: DataFrame, n: int = 3) -> DataFrame:
    return df.withColumn("vw_rev", -rolling(F.sum, "lr", n) * W.rank_pct("volume"))


def volume_price_divergence(df: DataFrame, k: int = 5) -> DataFrame:
    changed = df.withColumn("__p", W.change("price", k)).withColumn("__v", W.change("volume", k))
    return changed.withColumn("divergence", W.rank_pct("__p") - W.rank_pct("__v")).drop("__p", "__v")


def market_beta(df: DataFrame, *ns: int) -> DataFrame:
    """beta_n to the equal-weight market (population covariance over sample variance), idio_n residual volatility."""
    from pyspark.sql.window import Window

    out = df.withColumn("mkt", F.avg("lr").over(Window.partitionBy("date"))).withColumn("__xy", F.col("lr") * F.col("mkt"))
    for n in ns:
        cov = rolling(F.avg, "__xy", n) - rolling(F.avg, "lr", n) * rolling(F.avg, "mkt", n)
        out = out.withColumn(f"beta_{n}", F.try_divide(cov, rolling(F.var_samp, "mkt", n)))
        out = out.withColumn("__r", F.col("lr") - F.col(f"beta_{n}") * F.col("mkt")).withColumn(f"idio_{n}", rolling(F.stddev_samp, "__r", n) * A)
    return out.drop("__xy", "__r")


def entry_context(df: DataFrame) -> DataFrame:
    """What is known the row before: 63-row volatility, 126-row momentum, distance to the 252-row high (60 values at least)."""
    made = df.withColumn("__v", rolling(F.stddev_samp, "lr", 63) * A).withColumn("__m", rolling(F.sum, "lr", 126)).withColumn("__h", F.try_divide("price", rolling(F.max, "price", 252, 60)) - 1)
    return made.withColumns({"vol_63": lag("__v"), "mom_126": lag("__m"), "near_high": lag("__h")}).drop("__v", "__m", "__h")


def rolling_share(df: DataFrame, x: str, n: int = 252, least: int = 63, above: bool = False) -> DataFrame:
    """pct: share of the window at or below (``above``: at or above) the last value."""
    return with_shares(df, {"pct": x}, n, least, above)


def rolling_z(df: DataFrame, x: str, n: int = 252, least: int = 63) -> DataFrame:
    return df.withColumn("z", (F.col(x) - rolling(F.avg, x, n, least)) / (rolling(F.stddev_samp, x, n, least) + EPS))


def frac_weights(d: float, least: float = 1e-5, most: int = 400) -> list[float]:
    """Weights of fractional differencing until they fall under ``least``."""
    out = [1.0]
    for k in range(1, most):
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < least:
            break
        out.append(w)
    return out


def frac_diff(df: DataFrame, x: Column | str, d: float, least: float = 1e-3) -> DataFrame:
    """frac: fractional difference of order d over a fixed trailing window."""
    weights = frac_weights(d, least)
    n = len(weights)
    x = F.col(x) if isinstance(x, str) else x
    values = F.collect_list(x).over(trailing(n))
    dot = F.aggregate(F.zip_with(values, F.array(*[F.lit(w) for w in reversed(weights)]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("frac", F.when(F.count(x).over(trailing(n)) == n, dot))


def difference(df: DataFrame, x: str, k: int) -> DataFrame:
    return df.withColumn("diff", F.col(x) - lag(x, k))


def running(df: DataFrame, r: str = "lr") -> DataFrame:
    """cum: compounded value of returns (missing counts as 0); peak: its running maximum."""
    w = W.by_key().rowsBetween(W.Window.unboundedPreceding, 0)
    cum = df.withColumn("cum", F.exp(F.sum(F.log1p(F.expm1(F.coalesce(r, F.lit(0.0))))).over(w)))
    return cum.withColumn("peak", F.max("cum").over(w))
