"""Factor risk of given books: exposures, factor returns, covariance, attribution, stress.

All estimates are as of a date: they read the last 252 rows of the calendar up to it, by differences of running
sums, and nothing later.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.windows import by_key, lag

FACTORS = ["market", "size", "value", "momentum", "quality", "volatility"]
PAIRS = [(a, b) for a in FACTORS for b in FACTORS]


def _total(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def marked_returns(panel: DataFrame) -> DataFrame:
    """date, ticker, place of the date (from 0), r and m: the return and the mean return of all tickers.

    Both are null on dates on which some ticker has no return, as the estimates need a full cross-section.
    """
    names = panel.agg(F.count_distinct("ticker").alias("names"))  # one row
    dated = panel.groupBy("date").agg(F.count("lr").alias("n"), F.avg("lr").alias("mean")).crossJoin(names)  # one row per date
    dated = dated.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("place"), F.when(F.col("n") == F.col("names"), F.col("mean")).alias("m"))
    return panel.join(dated, "date").select("date", "ticker", "place", F.when(F.col("m").isNotNull(), F.col("lr")).alias("r"), "m")


def _rolling_sums(marked: DataFrame, rows: int, skip: int) -> DataFrame:
    """Sums over the last ``rows`` calendar rows as differences of running sums: n, s_r, s_m, s_rm, s_rr, s_mm; and ``last``, the sum of the last ``skip`` returns."""
    r, m = F.col("r"), F.col("m")
    terms = {"n": (r * 0 + 1), "r": r, "m": m, "rm": r * m, "rr": r * r, "mm": m * m}
    running = by_key().rowsBetween(Window.unboundedPreceding, 0)
    made = marked.withColumns({f"t_{c}": F.sum(F.coalesce(x, F.lit(0.0))).over(running) for c, x in terms.items()})
    made = made.withColumn("seen", F.when(r.isNotNull(), F.col("t_r")))
    before = "lag(seen, {}) IGNORE NULLS OVER (PARTITION BY ticker ORDER BY date)"
    made = made.withColumn("old", F.coalesce(F.when(r.isNotNull(), F.expr(before.format(skip))).otherwise(F.expr(before.format(skip + 1))), F.lit(0.0)))
    sums = {f"s_{c}": F.col(f"t_{c}") - F.coalesce(lag(f"t_{c}", rows), F.lit(0.0)) for c in terms}
    return made.withColumns({**sums, "last": F.col("t_r") - F.col("old")}).drop("seen", "old", *[f"t_{c}" for c in terms])


def exposures(panel: DataFrame, fundamentals: DataFrame, rows: int = 252, least: int = 63, skip: int = 21, full: int = 0) -> DataFrame:
    """date, ticker and a z-score of each factor over all tickers, from the last ``rows`` returns of each date.

    market: slope on the mean return (1 if that does not vary); momentum: sum of all but the last ``skip``
    returns; volatility: annual deviation.  ``fundamentals``: date, ticker, market_cap, pe, roe as known on that
    date; size is ln(market_cap), value 1/pe, quality roe, 0 where they are missing or not positive.  A factor that
    does not vary stays raw.  No rows for dates with fewer than ``least`` rows of prices or ``full``
    full cross-sections among their last ``rows``; nothing later than a date is read for it.
    """
    s = _rolling_sums(marked_returns(panel), rows, skip).where((F.col("place") >= least - 1) & (F.col("s_n") >= full)).withColumnRenamed("s_n", "k")
    k = F.col("k")
    spread = lambda a, b, ab: F.when(k > 1, (F.col(ab) - F.col(a) * F.col(b) / k) / (k - 1))
    own = s.withColumns({"cov": spread("s_r", "s_m", "s_rm"), "var": spread("s_m", "s_m", "s_mm"), "own": spread("s_r", "s_r", "s_rr")})
    known = own.join(fundamentals.select("date", "ticker", "market_cap", "pe", "roe"), ["date", "ticker"], "left")
    one = known.select(
        "date", "ticker", F.when(F.col("var") > 1e-14 * F.col("s_mm"), F.col("cov") / F.col("var")).otherwise(1.0).alias("market"), F.when(F.col("market_cap") > 0, F.ln("market_cap")).otherwise(0.0).alias("size"),
        F.when(F.col("pe") > 0, 1 / F.col("pe")).otherwise(0.0).alias("value"), F.when(k > skip, F.col("s_r") - F.col("last")).otherwise(0.0).alias("momentum"),
        F.coalesce("roe", F.lit(0.0)).alias("quality"), F.coalesce(F.sqrt(F.greatest("own", F.lit(0.0))) * math.sqrt(252), F.lit(0.0)).alias("volatility"),
    )
    whole = one.groupBy("date").agg(*[F.avg(c).alias(f"m_{c}") for c in FACTORS], *[F.stddev_samp(c).alias(f"s_{c}") for c in FACTORS])  # one row per date
    z = [F.coalesce(F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(F.col(c)), F.lit(0.0)).alias(c) for c in FACTORS]
    return one.join(whole, "date").select("date", "ticker", *z)


def specific_variance(panel: DataFrame, rows: int = 252, least: int = 63, full: int = 0) -> DataFrame:
    """date, ticker, spec_var: annualised mean square of the last ``rows`` returns of each date; no rows for dates with fewer than ``full`` full cross-sections among them."""
    made = _rolling_sums(marked_returns(panel), rows, 1).where((F.col("place") >= least - 1) & (F.col("s_n") >= full))
    return made.select("date", "ticker", (F.try_divide("s_rr", "s_n") * 252).alias("spec_var"))


#: Rows of the panel that one task of ``factor_estimates`` holds as arrays.
TASK_ROWS = 1 << 20


def factor_estimates(panel: DataFrame, exposed: DataFrame, rows: int = 252, halflife: float = 63.0, least: int = 20) -> DataFrame:
    """date, n, returns and cov: least-squares factor returns under each date's exposures, and their annual covariance.

    The exposures of a date hold for all of its last ``rows`` returns.  Tasks hold some tickers each, and add up
    their part of X = R B for the window and of B'B for each date (six numbers a date of the window, whatever the number of
    tickers); the sums of all tasks are then solved date by date.  Weights halve every ``halflife`` returns and means
    are plain; with ``least`` returns or fewer it is the sample covariance.  ``returns`` are those of the date
    itself, null if it has no full cross-section.
    """
    both = marked_returns(panel).join(exposed, ["date", "ticker"], "left").select("date", "ticker", "place", "r", *FACTORS)
    tasks = max(1, math.ceil(panel.count() / TASK_ROWS))
    width = len(FACTORS)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        ticker, place = pd.factorize(pdf["ticker"])[0], pdf["place"].to_numpy()
        shape = place.max() + 1, ticker.max() + 1
        r, b, dates = np.full(shape, np.nan), np.zeros((*shape, width)), np.empty(shape[0], dtype=object)
        r[place, ticker] = pdf["r"]
        b[place, ticker] = pdf[FACTORS].fillna(0.0)
        dates[place] = pdf["date"]
        full = np.flatnonzero(~np.isnan(r).all(axis=1))
        out = []
        for t in np.unique(place[pdf[FACTORS[0]].notna()]):
            window = full[np.searchsorted(full, t - rows + 1) : np.searchsorted(full, t, "right")]
            x = np.nan_to_num(r[window]) @ b[t]
            out.append((dates[t], bool(len(window) and window[-1] == t), (b[t].T @ b[t]).ravel(), x.ravel()))
        return pd.DataFrame(out, columns=["date", "own", "gram", "x"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram, x = np.sum(pdf["gram"].to_list(), axis=0).reshape(width, width), np.sum(pdf["x"].to_list(), axis=0).reshape(-1, width)
        found = x @ np.linalg.pinv(gram, hermitian=True)
        n, cov = len(found), None
        if n > least:
            weight = 0.5 ** (np.arange(n)[::-1] / halflife)
            centred = found - found.mean(axis=0)
            cov = (centred.T * (weight / weight.sum())) @ centred * 252
        elif n > 1:
            cov = np.cov(found.T) * 252
        return pd.DataFrame([(pdf["date"].iloc[0], n, found[-1] if pdf["own"].iloc[0] else None, None if cov is None else cov.ravel())], columns=["date", "n", "returns", "cov"])

    parts = both.groupBy(F.pmod(F.xxhash64("ticker"), F.lit(tasks)).alias("task")).applyInPandas(part, "date date, own boolean, gram array<double>, x array<double>")
    return parts.groupBy("date").applyInPandas(solve, "date date, n int, returns array<double>, cov array<double>")


def factor_returns(estimates: DataFrame) -> DataFrame:
    """date and the return of each factor, for dates with a full cross-section."""
    return estimates.where("returns is not null").select("date", *[F.element_at("returns", i + 1).alias(c) for i, c in enumerate(FACTORS)])


def factor_covariance(estimates: DataFrame) -> DataFrame:
    """date, a, b, cov."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.element_at("cov", i + 1).alias("cov")) for i, (a, b) in enumerate(PAIRS)]
    return estimates.where("cov is not null").select("date", F.inline(F.array(*cells)))


def book_exposures(book: DataFrame, exposed: DataFrame) -> DataFrame:
    return book.join(exposed, ["date", "ticker"]).groupBy("date").agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"x_{c}") for c in FACTORS])


def portfolio_risk(book: DataFrame, exposed: DataFrame, estimates: DataFrame, specific: DataFrame) -> DataFrame:
    """total_vol, factor_vol, specific_vol and the exposures of each date's book, by the estimates of that date."""
    own = book_exposures(book, exposed)
    terms = [F.col(f"x_{a}") * F.col(f"x_{b}") * F.element_at("cov", i + 1) for i, (a, b) in enumerate(PAIRS)]
    factor = own.join(estimates.where("cov is not null").select("date", "cov"), "date").withColumn("fv", _total(terms)).drop("cov")
    known = book.join(exposed.select("date", "ticker"), ["date", "ticker"]).join(specific, ["date", "ticker"], "left")
    spec = known.groupBy("date").agg(F.sum(F.pow("weight", F.lit(2)) * F.coalesce("spec_var", F.lit(0.0))).alias("sv"))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    return factor.join(spec, "date").withColumns({"total_vol": root(F.col("fv") + F.col("sv")), "factor_vol": root(F.col("fv")), "specific_vol": root(F.col("sv"))}).drop("fv", "sv")


def held_returns(book: DataFrame, panel: DataFrame) -> DataFrame:
    """date, before (the date of the book before), ticker, w (its weight there), r (simple return) of names with a return."""
    dates = book.select("date").distinct().withColumn("before", F.lag("date").over(Window.orderBy("date"))).where("before is not null")  # one row per date
    held = book.select(F.col("date").alias("before"), "ticker", F.col("weight").alias("w")).join(dates, "before")
    simple = panel.select("date", "ticker", (F.try_divide("price", lag("price")) - 1).alias("r")).where("r is not null")
    return held.join(simple, ["date", "ticker"]).select("date", "before", "ticker", "w", "r")


def attribution(held: DataFrame, exposed: DataFrame) -> DataFrame:
    """total, contribution of each factor, alpha, gross and net exposure of each date.

    Exposures are those of the date on which the book was made.  Factor returns are the least-squares fit of the
    held names' returns on them: Spark sums the normal equations, and a batch of dates is solved at once (the smallest
    solution if they are singular; all is alpha before the first estimate).
    """
    rows = held.join(exposed.withColumnRenamed("date", "before"), ["before", "ticker"], "left").fillna(0.0, FACTORS)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in PAIRS] + [F.sum(F.col(a) * F.col("r")).alias(f"{a}|r") for a in FACTORS] + [F.sum(F.col("w") * F.col(a)).alias(f"{a}|w") for a in FACTORS]
    table = rows.groupBy("date").agg(F.sum(F.col("w") * F.col("r")).alias("total"), F.sum(F.abs("w")).alias("gross_exposure"), F.sum("w").alias("net_exposure"), *sums)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gram = pdf[[f"{a}|{b}" for a, b in PAIRS]].to_numpy(float).reshape(len(pdf), len(FACTORS), len(FACTORS))
            fitted = np.einsum("nij,nj->ni", np.linalg.pinv(gram, hermitian=True), pdf[[f"{a}|r" for a in FACTORS]].to_numpy(float))
            parts = fitted * pdf[[f"{a}|w" for a in FACTORS]].to_numpy(float)
            out = pd.DataFrame(parts, columns=FACTORS)
            out.insert(0, "date", pdf["date"].to_numpy())
            out["total"] = pdf["total"].to_numpy(float)
            out["alpha"] = out["total"] - parts.sum(axis=1)
            yield out.assign(gross_exposure=pdf["gross_exposure"].to_numpy(float), net_exposure=pdf["net_exposure"].to_numpy(float))

    return table.mapInPandas(solve, "date date, " + ", ".join(f"{f} double" for f in FACTORS) + ", total double, alpha double, gross_exposure double, net_exposure double")


def contributors(held: DataFrame, n: int = 5) -> DataFrame:
    """The n positions with the largest and the n with the smallest contribution of each date (a top-k report)."""
    made = held.withColumn("pnl", F.col("w") * F.col("r"))
    high = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("pnl"), "ticker"))
    low = F.row_number().over(Window.partitionBy("date").orderBy(F.asc("pnl"), "ticker"))
    ends = made.withColumns({"high": high, "low": low})
    top = ends.where(F.col("high") <= n).select("date", F.lit("top").alias("side"), F.col("high").alias("place"), "ticker", "pnl")
    return top.unionByName(ends.where(F.col("low") <= n).select("date", F.lit("bottom").alias("side"), F.col("low").alias("place"), "ticker", "pnl"))


def attribution_summary(daily: DataFrame) -> DataFrame:
    """One row: days, totals of each factor, alpha and return, annual alpha, its Sharpe and hit rate, best and worst factor."""
    alpha = F.col("alpha")
    row = daily.agg(
        F.count("*").alias("n_days"), *[F.sum(c).alias(c) for c in FACTORS], F.sum("alpha").alias("alpha_total"), F.sum("total").alias("total"), (F.avg(alpha) * 252).alias("alpha_annual"),
        F.when(F.stddev_samp(alpha) > 0, F.avg(alpha) / F.stddev_samp(alpha) * math.sqrt(252)).otherwise(0.0).alias("alpha_sharpe"), F.avg((alpha > 0).cast("double")).alias("alpha_hit_rate"),
    )
    totals = F.array(*[F.struct(F.col(c).alias("v"), F.lit(c).alias("f")) for c in FACTORS])
    return row.withColumns({"best_factor": F.array_max(totals)["f"], "worst_factor": F.array_min(totals)["f"]})


def stress_betas(panel: DataFrame, market: DataFrame, rows: int = 252, least: int = 50) -> DataFrame:
    """ticker, beta: slope of simple returns on the market's over the last ``rows`` common rows; 1 with ``least`` or fewer.

    ``market``: date, level (one row per date).
    """
    moved = market.select("date", (F.try_divide("level", F.lag("level").over(Window.orderBy("date"))) - 1).alias("m"))
    own = panel.select("date", "ticker", (F.try_divide("price", lag("price")) - 1).alias("r"))
    both = own.join(moved, "date").where("r is not null and m is not null")
    last = both.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    recent = F.col("k") <= rows
    r, m = F.when(recent, F.col("r")), F.when(recent, F.col("m"))
    return last.groupBy("ticker").agg(F.when(F.count("*") > least, F.covar_samp(r, m) / (F.var_samp(m) + 1e-10)).otherwise(1.0).alias("beta"))


def stress(book: DataFrame, betas: DataFrame, target_vol: float = 0.1, floor: float = 0.3) -> DataFrame:
    """loss, worst position, halt flag and exposure left of the latest book in four scenarios.

    crash: market -10 %, by beta; correlation: net exposure falls 5 %; volatility: index at 80, exposure is scaled
    to the target and by 0.6, half of a 5 % day is lost; outage: gross exposure moves 4 % against the book.
    """
    last = book.join(book.agg(F.max("date").alias("date")), "date").join(betas, "ticker", "left").withColumn("hit", F.col("weight") * F.coalesce("beta", F.lit(1.0)) * -0.1)
    sums = last.agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"), F.sum("hit").alias("crash"), F.min_by("ticker", F.struct("hit", "ticker")).alias("worst"), F.min("hit").alias("worst_loss"))
    scaled = F.col("gross") * max(floor, target_vol / 0.8) * 0.6
    none, zero, never = F.lit(None).cast("string"), F.lit(0.0), F.lit(False)
    cases = [
        ("crash", F.col("crash"), F.col("worst").cast("string"), F.col("worst_loss"), F.lit(True), F.col("gross") * 0.5),
        ("correlation", F.col("net") * -0.05, none, zero, F.abs(F.col("net") * 0.05) > 0.03, F.col("gross")),
        ("volatility", scaled * 0.05 * 0.5, none, zero, never, scaled), ("outage", F.col("gross") * 0.04, none, zero, never, F.col("gross")),
    ]
    names = ("loss", "worst", "worst_loss", "halted", "exposure")
    made = F.array(*[F.struct(F.lit(c[0]).alias("scenario"), *[x.alias(n) for x, n in zip(c[1:], names)]) for c in cases])
    return sums.select(F.inline(made))
