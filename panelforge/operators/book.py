"""Rule-based book construction, P&L replay, risk, attribution and forensics on given books.

All forms are open loop: path-dependent steps take yesterday's table as an input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from panelforge.functions import windows as W
from panelforge.functions.windows import lag, rank_pct, rolling

A = math.sqrt(252)


def on_date(*more: str) -> WindowSpec:
    return Window.partitionBy("date", *more)


def eligible(df: DataFrame, most: dict[str, float], least: dict[str, float] | None = None, barred: list[str] | None = None) -> DataFrame:
    """can_short: no column is over its ``most`` or at or under its ``least``, and the sector is not barred; missing values do not exclude."""
    broken = [F.col(c) > x for c, x in most.items()] + [F.col(c) <= x for c, x in (least or {}).items()]
    if barred:
        broken.append(F.col("sector").isin(barred))
    bad = F.lit(False)
    for one in broken:
        bad = bad | F.coalesce(one, F.lit(False))
    return df.withColumn("can_short", ~bad)


def select_book(df: DataFrame, score: str, n_long: int, n_short: int) -> DataFrame:
    """side 1 for the n_long best, -1 for the n_short worst of each date; ties by ticker."""
    up = F.row_number().over(on_date().orderBy(F.desc(score), "ticker"))
    down = F.row_number().over(on_date().orderBy(F.asc(score), "ticker"))
    made = df.where(F.col(score).isNotNull()).withColumns({"rank": rank_pct(score), "__u": up, "__d": down})
    side = F.when(F.col("__u") <= n_long, 1).when(F.col("__d") <= n_short, -1)
    return made.withColumn("side", side).drop("__u", "__d").where("side is not null")


def hysteresis(df: DataFrame, score: str, n: int) -> DataFrame:
    """held: enter at place n or better, stay until the place is over 2n."""
    place = F.row_number().over(on_date().orderBy(F.desc_nulls_last(score), "ticker"))
    made = df.withColumn("place", F.when(F.col(score).isNotNull(), place))
    event = F.when(F.col("place") <= n, 1).when(F.col("place").isNull() | (F.col("place") > 2 * n), 0)
    made = made.withColumn("__e", event)
    return made.withColumn("held", F.coalesce(F.last("__e", ignorenulls=True).over(W.by_key().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("__e")


def weights(book: DataFrame, vol: str, gross_long: float = 0.45, gross_short: float = 0.25) -> DataFrame:
    """Signal times inverse volatility, normalised by side to the target gross."""
    v = F.coalesce(vol, "__med")
    raw = F.greatest(F.when(F.col("side") == 1, F.col("rank") - 0.5).otherwise(0.5 - F.col("rank")) / F.greatest(v, F.lit(0.05)), F.lit(0.0))
    made = W.with_medians(book, {"__med": vol}, "date").withColumn("__raw", raw)
    share = F.try_divide("__raw", F.sum("__raw").over(on_date("side")))
    return made.withColumn("weight", F.coalesce(share, F.lit(0.0)) * F.when(F.col("side") == 1, gross_long).otherwise(-gross_short)).drop("__raw", "__med")


def to_gross(book: DataFrame, gross_long: float = 0.45, gross_short: float = 0.25) -> DataFrame:
    """Scale each side back to its target gross, as after caps; a side without weight stays."""
    side = F.sum(F.abs("weight")).over(on_date("__s"))
    target = F.when(F.col("__s") > 0, gross_long).otherwise(gross_short)
    return book.withColumn("__s", F.signum("weight")).withColumn("weight", F.col("weight") * F.coalesce(F.try_divide(target, side), F.lit(1.0))).drop("__s")


def construct(candidates: DataFrame, score: str, vol: str, n_long: int, n_short: int, previous: DataFrame | None = None, sector: float = 0.15, position: float = 0.02, turnover: float = 0.6) -> DataFrame:
    """The whole book of each date: pick, weigh, cap sectors and positions, restore gross, limit turnover, drop dust.

    ``candidates``: date, ticker, sector, can_short, score and volatility; names that may not be short are
    left out of the short side only.  ``previous``: date, ticker, weight held on the date before.
    """
    picked = select_book(candidates, score, n_long, n_short).where((F.col("side") == 1) | F.col("can_short"))
    capped = sector_cap(weights(picked, vol), sector).drop("weight").withColumnRenamed("capped", "weight")
    full = to_gross(position_cap(capped, position)).select("date", "ticker", "weight")
    return drop_dust(full if previous is None else turnover_limit(full, previous, turnover).select("date", "ticker", "weight"))


def sector_cap(book: DataFrame, cap: float = 0.15) -> DataFrame:
    """Scale sectors over ``cap`` of gross; ``Unknown`` is exempt."""
    share = F.try_divide(F.sum(F.abs("weight")).over(on_date("sector")), F.sum(F.abs("weight")).over(on_date()))
    scale = F.when((F.col("sector") != "Unknown") & (share > cap), cap / share).otherwise(1.0)
    return book.withColumn("capped", F.col("weight") * scale)


def position_cap(book: DataFrame, cap: float = 0.02) -> DataFrame:
    return book.withColumn("weight", W.clip("weight", -cap, cap))


def turnover_limit(target: DataFrame, previous: DataFrame, most: float = 0.6) -> DataFrame:
    """Move from the previous book towards the target by as much as the turnover allows."""
    both = target.select("date", "ticker", F.col("weight").alias("t")).join(previous.select("date", "ticker", F.col("weight").alias("p")), ["date", "ticker"], "full").fillna(0.0)
    move = F.sum(F.abs(F.col("t") - F.col("p"))).over(on_date())
    return both.withColumn("weight", F.col("p") + (F.col("t") - F.col("p")) * F.when(move > most, most / move).otherwise(1.0))


def drop_dust(book: DataFrame) -> DataFrame:
    floor = F.greatest(F.lit(1e-5), F.least(F.lit(0.002), 0.1 * F.avg(F.abs("weight")).over(on_date())))
    return book.withColumn("__f", floor).where(F.abs("weight") >= F.col("__f")).drop("__f")


def trade_list(target: DataFrame, current: DataFrame, equity: float, least: float = 0.005) -> DataFrame:
    """Orders: sells in whole shares, buys in dollars, small differences left out."""
    both = target.select("date", "ticker", "price", F.col("weight").alias("t")).join(current.select("date", "ticker", F.col("weight").alias("c")), ["date", "ticker"], "left").fillna(0.0, ["c"])
    delta = both.withColumn("delta", F.col("t") - F.col("c")).where(F.abs("delta") > least)
    shares = F.floor(F.abs("delta") * equity / F.col("price"))
    sized = delta.withColumn("shares", F.when(F.col("delta") < 0, shares)).withColumn("notional", F.when(F.col("delta") > 0, F.col("delta") * equity))
    return sized.where("shares is null or shares >= 1")


def drawdown_scale(daily: DataFrame, start: float = -0.03, stop: float = -0.06, least: float = 0.5) -> DataFrame:
    """Exposure scale from the drawdown known the day before."""
    made = daily.withColumn("cum", F.product(1 + F.col("net")).over(_path()))
    made = made.withColumn("dd", F.col("cum") / F.greatest(F.max("cum").over(_path()), F.lit(1.0)) - 1)
    ramp = 1 - W.clip((start - lag("dd", 1, "run")) / (start - stop), 0.0, 1.0) * (1 - least)
    return made.withColumn("scale", F.coalesce(ramp, F.lit(1.0)))


def risk_scales(daily: DataFrame, target: float = 0.1, n: int = 63, limit: float = -0.08, least: float = 0.5) -> DataFrame:
    """Three scales of exposure from the returns up to each date.

    vol_scale: target over the annual deviation of n rows, in 0.3 to 2 (1 with fewer rows or none).
    dd_scale: beyond the limit, 1 less half of the excess in limits, at least ``least``.
    tail_scale, from 10 rows on: 0.5 if one of the last five lost over 3 %, else 0.6 if their deviation is
    over twice that of the last n (20 at least), else 0.7 after three losses, else 1.
    """
    window = lambda k: W.trailing(k, "run")
    vol = rolling(F.stddev_samp, "net", n, key="run") * A
    seen = F.count("net").over(_path())
    lively = F.try_divide(F.stddev_pop("net").over(window(5)), F.stddev_pop("net").over(window(n)))
    tail = F.when(seen < 10, 1.0).when(F.min("net").over(window(5)) < -0.03, 0.5).when((seen >= 20) & (lively > 2), 0.6).when(F.max("net").over(window(3)) < 0, 0.7).otherwise(1.0)
    made = daily.withColumn("__c", F.product(1 + F.col("net")).over(_path()))
    made = made.withColumn("__d", F.col("__c") / F.greatest(F.max("__c").over(_path()), F.lit(1.0)) - 1)
    deep = F.greatest(F.lit(least), 1 - (F.col("__d") / limit - 1) * 0.5)
    return made.withColumns({"vol_scale": F.when(vol > 0, W.clip(target / vol, 0.3, 2.0)).otherwise(1.0), "dd_scale": F.when(F.col("__d") < limit, deep).otherwise(1.0), "tail_scale": tail}).drop("__c", "__d")


def sector_neutral(book: DataFrame, band: float = 0.03) -> DataFrame:
    """Subtract a sector's net weight beyond the band equally from its members."""
    net, n = F.sum("weight").over(on_date("sector")), F.count("*").over(on_date("sector"))
    return book.withColumn("neutral", F.col("weight") - (net - W.clip(net, -band, band)) / n)


def factor_neutral(book: DataFrame, factor: str, rounds: int = 5) -> DataFrame:
    """Unrolled rounds that take 30 % of an exposure over 0.3 out along the factor."""
    out = book.withColumn("neutral", F.col("weight"))
    for _ in range(rounds):
        out = out.withColumn("__x", F.sum(F.col("neutral") * F.col(factor)).over(on_date())).withColumn("__b", F.sum(F.pow(factor, F.lit(2))).over(on_date()))
        out = out.withColumn("neutral", F.when(F.abs("__x") > 0.3, F.col("neutral") - 0.3 * F.col("__x") * F.col(factor) / F.col("__b")).otherwise(F.col("neutral")))
    return out.withColumn("neutral", W.clip("neutral", -0.1, 0.1)).drop("__x", "__b")


def regime_tilt(book: DataFrame, score: str) -> DataFrame:
    b = F.when(F.abs(score) < 0.01, 0.0).otherwise(F.least(2 * F.abs(score), F.lit(0.15))) * F.signum(score)
    return book.withColumn("tilted", F.col("weight") * F.when(F.col("weight") > 0, 1 + b).otherwise(1 - b))


def gross_cap(book: DataFrame, most: float = 1.6) -> DataFrame:
    """Dollar neutral at the smaller side (0.8 at most), gross held under ``most``."""
    long = F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).over(on_date())
    short = -F.sum(F.when(F.col("weight") < 0, F.col("weight")).otherwise(0.0)).over(on_date())
    side = F.least(long, short, F.lit(0.8), F.lit(most / 2))
    return book.withColumn("__l", long).withColumn("__s", short).withColumn("__t", side).withColumn("neutral", F.when(F.col("weight") > 0, F.try_divide(F.col("weight") * F.col("__t"), "__l")).otherwise(F.try_divide(F.col("weight") * F.col("__t"), "__s"))).drop("__l", "__s", "__t")


def risk_parity(book: DataFrame, vol: str) -> DataFrame:
    made = book.withColumn("__i", 1 / F.greatest(F.coalesce(vol, F.lit(0.05)), F.lit(0.05)))
    return made.withColumn("parity", F.col("side") * F.col("__i") / F.sum("__i").over(on_date("side"))).drop("__i")


def garch_fit(returns: list[np.ndarray], variance: np.ndarray, alphas: np.ndarray, betas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the likeliest pair (the last one of equals, to 9 digits), next variance and likelihood of each series: one pass over the rows for all series and pairs."""
    order = np.argsort([-len(r) for r in returns], kind="stable")
    sizes = np.array([len(returns[i]) for i in order])
    padded = np.zeros((max(sizes.max(), 1), len(order), 1))
    for at, i in enumerate(order):
        padded[: sizes[at], at, 0] = returns[i]
    v = variance[order][:, None]
    rest = v * (1 - alphas - betas)
    h, ll = np.repeat(v, len(alphas), axis=1), np.zeros((len(order), len(alphas)))
    for t, r in enumerate(padded):
        n = np.searchsorted(-sizes, -t)  # series that are longer than t, the first ones
        if not n:
            break
        old = h[:n]
        ll[:n] -= 0.5 * (np.log(old) + r[:n] * r[:n] / old)
        h[:n] = rest[:n] + alphas * r[:n] * r[:n] + betas * old
    rounded = np.nan_to_num(np.round(ll, 9), nan=np.inf)
    best = len(alphas) - 1 - np.argmax(rounded[:, ::-1], axis=1)
    out = np.empty((len(order), 2))
    rows = np.arange(len(order))
    out[order, 0], out[order, 1] = h[rows, best], ll[rows, best]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = best
    return place, out


def garch(df: DataFrame, r: str = "lr", least: int = 50, horizon: int = 10) -> DataFrame:
    """GARCH(1,1) by variance targeting: best pair of the 9 x 14 grid by Gaussian likelihood, for each ticker.

    vol is of the next row, forecast of each of the next ``horizon`` rows.  Under ``least`` returns, or if they do
    not vary, both are the deviation of the last 21 returns, and alpha, beta and ll are null.  A task goes along the rows
    of some hundred series at once, with all pairs.
    """
    x = F.when(F.col(r).isNotNull(), F.struct("date", F.col(r).alias("r")))
    series = df.groupBy("ticker").agg(F.sort_array(F.collect_list(x)).alias("s"), F.var_pop(r).alias("v"), F.count(r).alias("n"))
    series = series.select("ticker", "v", "n", F.col("s.r").alias("s"))
    last = F.slice("s", F.greatest(F.col("n") - 20, F.lit(1)).cast("int"), F.lit(21))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, e: acc + f(e))
    series = series.withColumn("__m", F.try_divide(total(last, lambda e: e), F.size(last)))
    series = series.withColumn("__m", F.try_divide(total(last, lambda e: (e - F.col("__m")) * (e - F.col("__m"))), F.size(last)))
    pairs = [(a, b) for a in [round(0.02 * i, 2) for i in range(1, 10)] for b in [round(0.7 + 0.02 * i, 2) for i in range(14)] if a + b < 0.999]
    alphas, betas = np.array(pairs).T
    fits = (F.col("n") >= least) & (F.col("v") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # a block whose arrays stay in the processor's cache
                part = batch.slice(at, 256)
                place, found = np.full(len(part), -1), np.full((len(part), 2), np.nan)
                if len(mine := np.flatnonzero(part.column("fits"))):
                    values = [part.column("s")[int(i)].values.to_numpy() for i in mine]
                    place[mine], found[mine] = garch_fit(values, part.column("v").take(pa.array(mine)).to_numpy(), alphas, betas)
                none = place < 0
                own = [pa.array(c, pa.float64(), mask=none) for c in (alphas[place], betas[place], *found.T)]
                yield pa.RecordBatch.from_arrays([part.column("ticker"), part.column("v"), part.column("__m"), *own], ["ticker", "v", "__m", "alpha", "beta", "h", "ll"])

    # The series are small and the fit is long: a number of partitions is given, or they would be merged to one.
    spread = series.select("ticker", "v", "__m", F.coalesce(fits, F.lit(False)).alias("fits"), F.when(fits, F.col("s")).alias("s")).repartition(df.sparkSession.sparkContext.defaultParallelism, "ticker")
    schema = StructType([StructField("ticker", df.schema["ticker"].dataType), *[StructField(c, DoubleType()) for c in ("v", "__m", "alpha", "beta", "h", "ll")]])
    fitted = spread.mapInArrow(run, schema)
    ahead = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: F.sqrt(F.col("v") + F.pow(F.col("alpha") + F.col("beta"), k) * (F.col("h") - F.col("v"))) * A)
    plain, done = F.sqrt("__m") * A, F.col("alpha").isNotNull()
    return fitted.select("ticker", "alpha", "beta", F.when(done, F.sqrt("h") * A).otherwise(plain).alias("vol"), "ll", F.when(done, ahead).otherwise(F.array_repeat(plain, horizon)).alias("forecast"))


def pretrade_checks(book: DataFrame, gross: float, names: int) -> DataFrame:
    by = book.groupBy("date").agg(F.sum(F.abs("weight")).alias("gross"), F.stddev_samp("rank").alias("sd"), F.count("*").alias("n"))
    return by.select("date", (F.col("gross") > gross).alias("over_gross"), F.coalesce(F.col("sd") < 1e-6, F.lit(True)).alias("flat_scores"), (F.col("n") < names).alias("too_few"))


def replay(book: DataFrame, panel: DataFrame, cost: float = 7e-4) -> DataFrame:
    """One row per book date but the first: the book before times the simple returns of the date, less costs.

    Returns run from the panel's date before; names without both prices earn and cost nothing.  Dates
    that the panel does not have are left out, and the next date follows from their book.
    """
    dates = book.select("date").distinct().withColumn("before", F.lag("date").over(Window.orderBy("date"))).where("before is not null")  # one row per date
    known = dates.join(panel.select("date").distinct(), "date")
    held = book.select(F.col("date").alias("before"), "ticker", F.col("weight").alias("w0")).join(known, "before")
    returns = panel.select("date", "ticker", (F.try_divide("price", lag("price")) - 1).alias("r"))
    today = book.select("date", "ticker", F.col("weight").alias("w1"))
    rows = held.join(returns, ["date", "ticker"], "left").join(today, ["date", "ticker"], "left")
    long, short, pnl = F.col("w0") > 0, F.col("w0") < 0, F.col("w0") * F.col("r")
    daily = rows.groupBy("date").agg(
        F.sum(pnl).alias("gross"), F.sum(F.when(F.col("r").isNotNull(), F.abs(F.coalesce("w1", F.lit(0.0)) - F.col("w0")))).alias("turnover"),
        F.sum(F.when(long, pnl)).alias("long_pnl"), F.sum(F.when(short, pnl)).alias("short_pnl"), F.count_if(long).alias("n_long"), F.count_if(short).alias("n_short"),
        F.sum(F.abs("w0")).alias("gross_exposure"), F.sum("w0").alias("net_exposure"),
    ).fillna(0.0, ["gross", "turnover", "long_pnl", "short_pnl"])
    return daily.withColumn("tc", F.col("turnover") * cost).withColumn("net", F.col("gross") - F.col("tc")).withColumn("run", F.lit("book"))


def _path() -> WindowSpec:
    return W.by_key("run").rowsBetween(Window.unboundedPreceding, 0)


def metrics(daily: DataFrame) -> DataFrame:
    """Total, annual, volatility, Sharpe, Sortino, drawdown, Calmar, win rate, profit factor of each run."""
    curve = daily.withColumn("__c", F.product(1 + F.col("net")).over(_path()))
    curve = curve.withColumn("__d", F.col("__c") / F.max("__c").over(_path()) - 1)
    r = F.col("net")
    m = curve.groupBy("run").agg(F.count("*").alias("n"), (F.product(1 + r) - 1).alias("total"), (F.stddev_samp(r) * A).alias("vol"), (F.stddev_samp(F.when(r < 0, r)) * A).alias("down"), F.min("__d").alias("max_dd"), F.avg((r > 0).cast("double")).alias("win"), F.try_divide(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))).alias("profit_factor"))
    # A run that lost more than all has no real power: NaN, and so have the ratios of it.
    m = m.withColumn("annual", F.pow(1 + F.col("total"), 252 / F.col("n")) - 1)
    return m.withColumns({"sharpe": F.try_divide("annual", "vol"), "sortino": F.try_divide("annual", "down"), "calmar": F.try_divide("annual", F.abs("max_dd"))})


def drawdown_spells(daily: DataFrame) -> DataFrame:
    """Longest and mean duration of spells under the running peak."""
    made = daily.withColumn("__c", F.round(F.product(1 + F.col("net")).over(_path()), 9))
    made = made.withColumn("__u", F.col("__c") < F.max("__c").over(_path())).withColumn("__g", F.sum((~F.col("__u")).cast("int")).over(_path()))
    spells = made.where("__u").groupBy("run", "__g").agg(F.count("*").alias("n"))
    return spells.groupBy("run").agg(F.max("n").alias("longest"), F.avg("n").alias("mean"))


def rolling_performance(daily: DataFrame, n: int = 63) -> DataFrame:
    made = daily.withColumn("sharpe", F.try_divide(rolling(F.avg, "net", n, key="run") * A, rolling(F.stddev_samp, "net", n, key="run"))).withColumn("cum", F.product(1 + F.col("net")).over(_path()) - 1)
    return made.withColumn("dd", (1 + F.col("cum")) / F.max(1 + F.col("cum")).over(_path()) - 1)


def summary(daily: DataFrame) -> DataFrame:
    month = daily.groupBy("run", F.date_trunc("month", "date").alias("m")).agg((F.product(1 + F.col("net")) - 1).alias("r"))
    by = month.groupBy("run").agg(F.max("r").alias("best_month"), F.min("r").alias("worst_month"), F.avg((F.col("r") > 0).cast("double")).alias("up_months"))
    return daily.groupBy("run").agg(F.avg("gross_exposure").alias("mean_gross"), F.avg("turnover").alias("mean_turnover"), F.sum("tc").alias("costs"), F.sum("long_pnl").alias("long_pnl"), F.sum("short_pnl").alias("short_pnl")).join(by, "run")


def compare(table: DataFrame, *names: str) -> DataFrame:
    """Metric by run, and the best run of each metric."""
    long = table.unpivot(["run"], list(names), "metric", "value")
    return long.groupBy("metric").agg(F.max_by("run", F.struct("value", "run")).alias("best"), F.max("value").alias("value"))


def excess(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    return daily.join(benchmark, "date").withColumn("excess", F.col("net") - F.col("bench"))


def period_report(daily: DataFrame, benchmark: DataFrame, start: str, end: str) -> DataFrame:
    """Summed return of each run and of the benchmark, extremes, exposure, and win rates by day, week and month."""
    part = daily.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(benchmark.select("date", "bench"), "date", "left")
    ordered = F.sort_array(F.collect_list("net"))  # the rows of one period of a run
    five = lambda xs: F.aggregate(F.slice(xs, 1, 5), F.lit(0.0), lambda a, x: a + x)
    by = part.groupBy("run").agg(
        F.count("*").alias("n"), F.sum("net").alias("total"), F.sum("bench").alias("bench_total"), F.min("net").alias("worst"), F.max("net").alias("best"), F.avg((F.col("net") > 0).cast("double")).alias("win"),
        F.avg("net_exposure").alias("exposure"), five(ordered).alias("worst_five"), five(F.reverse(ordered)).alias("best_five"),
    ).withColumn("relative", F.col("total") - F.col("bench_total"))
    for unit in ("week", "month"):
        sums = part.groupBy("run", F.date_trunc(unit, "date").alias("u")).agg(F.sum("net").alias("r"))
        by = by.join(sums.groupBy("run").agg(F.avg((F.col("r") > 0).cast("double")).alias(f"win_{unit}")), "run")
    return by


def period_months(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Summed returns of each run and of the benchmark by month."""
    both = daily.join(benchmark.select("date", "bench"), "date", "left")
    return both.groupBy("run", F.date_trunc("month", "date").cast("date").alias("month")).agg(F.sum("net").alias("total"), F.sum("bench").alias("bench_total"))


def position_events(book: DataFrame, panel: DataFrame) -> DataFrame:
    """open and close events of each ticker's holding spells, with prices."""
    grid = panel.select("date", "ticker", "price").join(book.select("date", "ticker", "side"), ["date", "ticker"], "left").withColumn("held", F.coalesce("side", F.lit(0)))
    made = grid.withColumn("before", F.coalesce(lag("held"), F.lit(0))).where("held <> before")
    kinds = F.array_compact(F.array(F.when(F.col("before") != 0, F.struct(F.lit("close").alias("kind"), F.col("before").alias("side"))), F.when(F.col("held") != 0, F.struct(F.lit("open").alias("kind"), F.col("held").alias("side")))))
    return made.select("date", "ticker", "price", F.explode(kinds).alias("e")).select("date", "ticker", "price", "e.kind", "e.side")


def position_context(events: DataFrame, context: DataFrame, *columns: str) -> DataFrame:
    """``events`` of ``position_events`` with entry_date, entry_price and entry_x for each x of ``columns``, on both ends of a spell; closes have exit_price and pnl too.

    ``context``: date, ticker and the columns as known on the date of an opening.  The state at an opening is
    carried to its close along the ticker's events; a close comes before an opening of the same date.
    """
    known = events.join(context.select("date", "ticker", *columns), ["date", "ticker"], "left")
    opened = F.when(F.col("kind") == "open", F.struct(F.col("date").alias("date"), F.col("price").alias("price"), *columns))
    so_far = Window.partitionBy("ticker").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    made = known.withColumn("__open", F.last(opened, ignorenulls=True).over(so_far))
    entry = {f"entry_{c}": F.col(f"__open.{c}") for c in ("date", "price", *columns)}
    exit_ = F.when(F.col("kind") == "close", F.col("price"))
    pnl = F.when(F.col("__open.price") > 0, F.col("side") * (exit_ / F.col("__open.price") - 1))
    return made.select("date", "ticker", "kind", "side", *[x.alias(c) for c, x in entry.items()], exit_.alias("exit_price"), pnl.alias("pnl"))


def match_trades(events: DataFrame) -> DataFrame:
    """First-in-first-out: the n-th close of a ticker ends its n-th open."""
    w = Window.partitionBy("ticker").orderBy("date")
    opens = events.where("kind = 'open'").select("ticker", "side", F.col("date").alias("entry"), F.col("price").alias("p0"), F.row_number().over(w).alias("n"))
    closes = events.where("kind = 'close'").select("ticker", F.col("date").alias("exit"), F.col("price").alias("p1"), F.row_number().over(w).alias("n"))
    return opens.join(closes, ["ticker", "n"]).withColumn("pnl", F.col("side") * (F.try_divide("p1", "p0") - 1)).withColumn("hold_days", F.datediff("exit", "entry"))


def track_predictions(df: DataFrame, score: str, h: int, n: int = 20, least: int = 5) -> DataFrame:
    """Rank correlation of scores with the next h rows' return by date, its rolling mean and a decay flag."""
    from panelforge.operators.labels import forward_return

    both = forward_return(df, h).where(F.col(score).isNotNull() & F.col("fwd").isNotNull()).withColumns({"__a": rank_pct(score), "__b": rank_pct("fwd")})
    ic = both.groupBy("date").agg(F.corr("__a", "__b").alias("ic"), F.count("*").alias("n")).where("n >= 10").withColumn("ticker", F.lit("all"))
    return ic.withColumn("ic_mean", rolling(F.avg, "ic", n, least)).withColumn("decayed", F.coalesce(F.col("ic_mean") < 0.02, F.lit(False)))


def stop_losses(book: DataFrame, panel: DataFrame, pct: float = 0.15, bar_days: int = 21) -> DataFrame:
    """First date of each short spell whose price is pct over its entry, and the date until which the name is barred."""
    grid = panel.select("date", "ticker", "price").join(book.select("date", "ticker", "side"), ["date", "ticker"], "left").withColumn("held", (F.coalesce("side", F.lit(0)) == -1).cast("int"))
    fresh = (F.col("held") == 1) & (F.coalesce(lag("held"), F.lit(0)) == 0)
    made = grid.withColumn("__f", fresh.cast("int")).withColumn("spell", F.sum("__f").over(W.by_key().rowsBetween(Window.unboundedPreceding, 0))).where("held = 1")
    entry = F.first("price").over(Window.partitionBy("ticker", "spell").orderBy("date"))
    return made.withColumn("p0", entry).where(F.col("price") > F.col("p0") * (1 + pct)).groupBy("ticker", "spell").agg(F.min("date").alias("stop")).withColumn("barred_until", F.date_add("stop", bar_days))


def without_barred(book: DataFrame, stops: DataFrame) -> DataFrame:
    """The book without short positions of names that are barred on the date (after a stop, up to its last day)."""
    days = stops.select("ticker", F.explode(F.sequence(F.date_add("stop", 1), F.col("barred_until"))).alias("date")).distinct()
    return book.where("side <> -1").unionByName(book.where("side = -1").join(days, ["ticker", "date"], "left_anti").select(*book.columns))
