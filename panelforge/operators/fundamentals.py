"""Features of facts, earnings, insider trades, grades and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.aggregates import quantiles
from panelforge.functions import windows as W
from panelforge.functions.scans import with_ranks
from panelforge.functions.windows import lag, rank_pct

#: Grade texts by score (fixed values).
GRADES = {
    5.0: ["strong buy", "strongbuy", "buy", "outperform", "overweight", "top pick"],
    4.0: ["moderate buy", "moderatebuy", "accumulate", "market outperform", "sector outperform", "add"],
    3.0: ["hold", "neutral", "market perform", "sector perform", "equal-weight", "equalweight", "equal weight", "perform", "peer perform", "in-line", "inline"],
    2.0: ["moderate sell", "moderatesell", "reduce", "underweight", "underperform"],
    1.0: ["sell", "strong sell", "strongsell"],
}
#: Words of an officer's title (fixed values).
OFFICERS = ("chief", "ceo", "cfo", "coo", "president", "chairman")


def yields(df: DataFrame, *ratios: str, positive_only: bool = False) -> DataFrame:
    """y_x = 1/x held in +-10; zero (or, for snapshots, not positive) ratios have none."""
    return df.withColumns({f"y_{r}": F.when((F.col(r) > 0) if positive_only else (F.col(r) != 0), W.clip(F.try_divide(F.lit(1.0), F.col(r)), -10.0, 10.0)) for r in ratios})


def quality_ranks(df: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """q_x: rank of each column on its date; those in ``down`` inverted.  All in one pass over a cross-section."""
    return with_ranks(df, {f"q_{c}": c for c in up + down}).withColumns({f"q_{c}": 1 - F.col(f"q_{c}") for c in down})


def size(df: DataFrame, cap: str) -> DataFrame:
    return df.withColumn("size", F.when(F.col(cap).isNotNull(), F.ln(F.greatest(F.col(cap), F.lit(1.0)))))


def target_upside(df: DataFrame, prices: DataFrame, target: str) -> DataFrame:
    """Target against each ticker's last price."""
    last = prices.where("price is not null").groupBy("ticker").agg(F.max_by("price", "date").alias("last_price"))
    return df.join(last, "ticker").withColumn("upside", F.try_divide(target, "last_price") - 1)


def piotroski(df: DataFrame, roe: str, roa: str, gm: str, cr: str, k: int = 63) -> DataFrame:
    """Number of passed tests; comparisons with nulls are not passed."""
    tests = [F.col(roe) > 0, F.col(roe) > lag(roe, k), F.col(roa) > 0, F.col(gm) > lag(gm, k), F.col(cr) > 1]
    return df.withColumn("piotroski", sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests[1:]), F.coalesce(tests[0], F.lit(False)).cast("int")))


def earnings_drift(panel: DataFrame, earnings: DataFrame) -> DataFrame:
    """Days since the last earnings date, return since, and whether it is recent (under 5 days)."""
    from panelforge.operators.asof import as_of, snap_forward

    slotted = snap_forward(earnings.where("date is not null"), panel.select("date").distinct(), "date").select("ticker", F.col("slot").alias("event")).where("event is not null").distinct()
    at = slotted.join(panel.select("ticker", F.col("date").alias("event"), F.col("price").alias("p0")), ["ticker", "event"], "left")
    found = as_of(panel, at.withColumn("seen", F.col("event")), "event", "seen", "p0")
    joined = panel.select("date", "ticker", "price").join(found, ["ticker", "date"])
    days = F.datediff("date", "seen")
    return joined.withColumns({"days_since": days, "ret_since": F.try_divide("price", "p0") - 1, "recent": (days < 5).cast("int")})


def post_earnings(panel: DataFrame, earnings: DataFrame) -> DataFrame:
    """Drift after the latest earnings date at or before each date, and the ranks of its parts on the date.

    days_since in calendar days; ret_since from the price of that date and earn_day, its log return, if it is a date of
    the panel (earn_day is 0 otherwise, and before the first); recent: under 5 days.
    """
    from panelforge.operators.asof import as_of

    traded = panel.select("ticker", F.col("date").alias("event"), F.col("price").alias("p0"), F.col("lr").alias("r0"), F.lit(True).alias("traded"))
    events = earnings.where("date is not null").select("ticker", F.col("date").alias("event")).distinct().join(traded, ["ticker", "event"], "left")
    found = as_of(panel, events.withColumn("seen", F.col("event")), "event", "seen", "p0", "r0", "traded")
    days = F.datediff("date", "seen")
    made = panel.select("date", "ticker", "price").join(found, ["ticker", "date"]).withColumns({
        "days_since": days, "ret_since": F.when(F.col("p0") > 0, F.col("price") / F.col("p0") - 1), "earn_day": F.when(F.col("traded"), F.col("r0")).otherwise(0.0), "recent": F.coalesce(days < 5, F.lit(False)).cast("int"),
    })
    return made.withColumns({f"cs_{c}": rank_pct(c) for c in ("days_since", "ret_since", "earn_day")}).drop("p0", "r0", "traded", "seen", "price")


def analyst_features(panel: DataFrame, ratings: DataFrame) -> DataFrame:
    """On every date of the panel: rank of the recommendation (inverted: 1 is the best grade), target upside against the last price with its rank, rank of coverage.

    ``ratings``: ticker, recommendation, target, coverage (one row a ticker).
    """
    upside = F.when((F.col("last_price") > 0) & (F.col("target") != 0), F.col("target") / F.col("last_price") - 1)
    last = panel.where("price is not null").groupBy("ticker").agg(F.max_by("price", "date").alias("last_price"))
    static = ratings.join(last, "ticker", "left").select("ticker", "recommendation", "coverage", upside.alias("upside"))
    made = panel.select("date", "ticker").join(static, "ticker", "left")
    return made.withColumns({"cs_rec": 1 - rank_pct("recommendation"), "cs_upside": rank_pct("upside"), "cs_coverage": rank_pct("coverage")})


def score_features(panel: DataFrame, scores: DataFrame, *columns: str) -> DataFrame:
    """Static scores of a ticker on every date with their ranks: x and cs_x of each column."""
    made = panel.select("date", "ticker").join(scores.select("ticker", *columns), "ticker", "left")
    return made.withColumns({f"cs_{c}": rank_pct(c) for c in columns})


def estimates(df: DataFrame, when: str) -> DataFrame:
    """Of tickers with two records or more: revisions of the latest against the one before, its dispersion and analysts.

    ``df``: ticker, eps_avg, eps_high, eps_low, revenue_avg, analysts; missing values count as 0, and a ratio to 0 is null.
    """
    known = df.fillna(0.0, ["eps_avg", "eps_high", "eps_low", "revenue_avg", "analysts"])
    w = Window.partitionBy("ticker").orderBy(F.desc(when))
    before = {c: F.lead(c).over(w) for c in ("eps_avg", "revenue_avg")}
    share = lambda a, b: F.when(b != 0, a / F.abs(b))
    made = known.withColumns({
        "eps_revision": share(F.col("eps_avg") - before["eps_avg"], before["eps_avg"]), "revenue_revision": share(F.col("revenue_avg") - before["revenue_avg"], before["revenue_avg"]),
        "dispersion": share(F.col("eps_high") - F.col("eps_low"), F.col("eps_avg")), "__n": F.row_number().over(w), "__all": F.count("*").over(Window.partitionBy("ticker")),
    })
    return made.where("__n = 1 and __all > 1").select("ticker", when, "eps_revision", "revenue_revision", "dispersion", "analysts")


def surprise(df: DataFrame) -> DataFrame:
    """surprise (a-e)/|e| (0 where e is 0), beat streak up to 8, revision against the estimate before."""
    w = Window.partitionBy("ticker").orderBy("date")
    a, e = F.col("eps_actual"), F.col("eps_estimated")
    made = df.withColumn("surprise", F.when(e == 0, 0.0).otherwise((a - e) / F.abs(e))).withColumn("__beat", F.coalesce(a > e, F.lit(False)))
    run = F.sum((~F.col("__beat")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    made = made.withColumn("__run", run)
    streak = F.sum(F.col("__beat").cast("int")).over(Window.partitionBy("ticker", "__run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("eps_estimated").over(w)
    return made.withColumn("streak", F.least(streak, F.lit(8)).cast("int")).withColumn("revision", F.when(before != 0, (e - before) / F.abs(before))).drop("__beat", "__run")


def earnings_alpha(panel: DataFrame, earnings: DataFrame) -> DataFrame:
    """Surprise on its first trading date, carried forward, and its rank."""
    from panelforge.operators.asof import as_of, snap_forward

    slotted = snap_forward(surprise(earnings), panel.select("date").distinct(), "date").where("slot is not null")
    found = as_of(panel, slotted.select("ticker", "slot", "surprise", F.col("date").alias("seen")), "slot", "surprise", tie="seen")
    return found.withColumn("cs_surprise", rank_pct("surprise"))


def snapshot(bars: DataFrame) -> DataFrame:
    """Last and previous close of each symbol and the change in percent (0 without a previous close)."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    two = bars.withColumn("prev", F.lead("close").over(w)).withColumn("n", F.row_number().over(w)).where("n = 1")
    return two.select("symbol", F.col("close").alias("price"), "prev", F.coalesce((F.try_divide("close", "prev") - 1) * 100, F.lit(0.0)).alias("change_pct"))


def insider_clean(raw: DataFrame) -> DataFrame:
    """Market trades of common stock: code A or D, a price, and a security that is unnamed, common or of a class.

    ``raw``: ticker, date, code, price, shares, security, reporter, owner.  Adds is_buy, usd and is_exec (the owner's
    title names a chief, president or chairman).
    """
    kind, owner = F.lower(F.coalesce("security", F.lit(""))), F.lower(F.coalesce("owner", F.lit("")))
    kept = raw.where(F.col("date").isNotNull() & F.col("code").isin("A", "D") & (F.coalesce("price", F.lit(0.0)) != 0) & ((kind == "") | kind.contains("common") | kind.contains("class")))
    exec_ = F.lit(False)
    for word in OFFICERS:
        exec_ = exec_ | owner.contains(word)
    return kept.select("ticker", "date", (F.col("code") == "A").alias("is_buy"), (F.col("price") * F.coalesce("shares", F.lit(0))).alias("usd"), "reporter", exec_.alias("is_exec"))


def insider_daily(trades: DataFrame) -> DataFrame:
    """Buy and sell dollars, distinct buyers and sellers, and whether an officer bought, by ticker and day."""
    buy = F.col("is_buy")
    return trades.groupBy("ticker", "date").agg(
        F.max((buy & F.col("is_exec")).cast("int")).alias("exec_buy"),
        F.sum(F.when(buy, F.col("usd")).otherwise(0.0)).alias("buy_usd"), F.sum(F.when(buy, 0.0).otherwise(F.col("usd"))).alias("sell_usd"),
        F.count_distinct(F.when(buy, F.col("reporter"))).alias("buyers"), F.count_distinct(F.when(~buy, F.col("reporter"))).alias("sellers"),
    )


def insider_features(grid: DataFrame, daily: DataFrame, n: int = 21) -> DataFrame:
    """n-row sums on the grid, the signed log of net dollars, ranks, and whether an officer bought in 3n rows."""
    from panelforge.operators.asof import on_grid

    filled = on_grid(grid, daily, "buy_usd", "sell_usd", "buyers", "sellers", "exec_buy")
    w = W.trailing(n)
    made = filled.withColumns({"net_usd": F.sum(F.col("buy_usd") - F.col("sell_usd")).over(w), "n_buyers": F.sum("buyers").over(w), "n_sellers": F.sum("sellers").over(w), "exec_flag": F.max("exec_buy").over(W.trailing(3 * n))})
    made = made.withColumns({"net_log": F.signum("net_usd") * F.log1p(F.abs("net_usd")), "net_count": F.col("n_buyers") - F.col("n_sellers")})
    return made.withColumns({"cs_net_log": rank_pct("net_log"), "cs_net_count": rank_pct("net_count")})


def insider_snapshot(trades: DataFrame) -> DataFrame:
    """Counts, net buy ratio (0.5 without trades), buy dollars and distinct buyers of each ticker."""
    buy = F.col("is_buy")
    by = trades.groupBy("ticker").agg(F.count_if(buy).alias("n_buys"), F.count_if(~buy).alias("n_sells"), F.sum(F.when(buy, F.col("usd")).otherwise(0.0)).alias("buy_usd"), F.count_distinct(F.when(buy, F.col("reporter"))).alias("buyers"))
    return by.withColumn("buy_ratio", F.coalesce(F.try_divide("n_buys", F.col("n_buys") + F.col("n_sells")), F.lit(0.5))).withColumn("buy_log", F.log1p("buy_usd"))


def grade_scores(df: DataFrame) -> DataFrame:
    """Scores of new and previous grade texts and up/down flags; a first grade counts by level."""
    names = F.create_map(*[F.lit(x) for value, texts in GRADES.items() for text in texts for x in (text, value)])
    score = lambda c: F.try_element_at(names, F.lower(F.trim(c)))
    made = df.withColumn("score", score("grade")).withColumn("prev_score", score("previous"))
    known = F.col("prev_score").isNotNull()
    return made.withColumn("is_up", F.coalesce(F.when(known, F.col("score") > F.col("prev_score")).otherwise(F.col("score") >= 4), F.lit(False))).withColumn("is_down", F.coalesce(F.when(known, F.col("score") < F.col("prev_score")).otherwise(F.col("score") <= 2), F.lit(False)))


def grade_features(grid: DataFrame, scored: DataFrame) -> DataFrame:
    """Up and down counts over 21 rows, net over 42, consensus over 63 (null without grades)."""
    from panelforge.operators.asof import on_grid

    daily = scored.groupBy("ticker", "date").agg(F.count_if("is_up").alias("ups"), F.count_if("is_down").alias("downs"), F.sum("score").alias("total"), F.count("score").alias("n"))
    filled = on_grid(grid, daily, "ups", "downs", "total", "n")
    return filled.withColumns({
        "up_21": F.sum("ups").over(W.trailing(21)), "down_21": F.sum("downs").over(W.trailing(21)),
        "net_42": F.sum(F.col("ups") - F.col("downs")).over(W.trailing(42)), "consensus": F.try_divide(F.sum("total").over(W.trailing(63)), F.sum("n").over(W.trailing(63))),
    })


def merge_statements(a: DataFrame, b: DataFrame, shared: str) -> DataFrame:
    """Outer merge of two statements by (ticker, period); of the shared column the first value that is neither null nor 0."""
    joined = a.join(b.withColumnRenamed(shared, "__b"), ["ticker", "period_date"], "full")
    return joined.withColumn(shared, F.coalesce(F.nullif(F.col(shared), F.lit(0.0)), F.col("__b"), F.col(shared))).drop("__b")


def earnings_quality(df: DataFrame, prices: DataFrame, income: str = "net_income", cash: str = "operating_cash_flow", assets: str = "total_assets", shares: str = "shares_out", paid: tuple[str, str] = ("dividends_paid", "stock_repurchases")) -> DataFrame:
    """Accruals, growth of assets against 4 records before, and shareholder yield, in filing order.

    ``paid``: dividends and buybacks as statements give them, outflows below zero.  The yield is
    what four records returned over the last price at or before the filing date times the shares;
    it is null without a price, where a record of the four has neither amount, where nothing was
    returned, and from 1 up.
    """
    from panelforge.operators.asof import as_of

    w = Window.partitionBy("ticker").orderBy("filing_date")
    four = w.rowsBetween(-3, 0)
    own, before = F.col(assets), F.lag(assets, 4).over(w)
    any_paid = F.coalesce(*paid).isNotNull()
    returned = -F.sum(F.coalesce(paid[0], F.lit(0.0)) + F.coalesce(paid[1], F.lit(0.0))).over(four)
    last = as_of(df.select("ticker", F.col("filing_date").alias("date")).distinct(), prices.where("price is not null").select("ticker", "date", F.col("price").alias("px")), "date", "px")
    made = df.withColumn("__returned", F.when((F.count_if(any_paid).over(four) == 4) & (returned > 0), returned))
    made = made.withColumns({"accruals": F.when(own > 0, (F.col(income) - F.col(cash)) / own), "growth": F.when((own > 0) & (before > 0), own / before - 1)})
    made = made.join(last.select("ticker", F.col("date").alias("filing_date"), "px"), ["ticker", "filing_date"], "left")
    value = F.when((F.col(shares) > 0) & (F.col("px") > 0), F.col("__returned") / (F.col("px") * F.col(shares)))
    return made.withColumn("holder_yield", F.when(value < 1, value)).drop("__returned", "px")


def option_skew(df: DataFrame, kind: str, iv: str, volume: str) -> DataFrame:
    """Median put less median call volatility, put/call volume, call volatility, of each ticker."""
    put, call = F.col(kind) == "put", F.col(kind) == "call"
    volumes = df.groupBy("ticker").agg((F.sum(F.when(put, F.col(volume)).otherwise(0.0)) / F.greatest(F.sum(F.when(call, F.col(volume)).otherwise(0.0)), F.lit(1.0))).alias("pc_ratio"))
    middle = quantiles(df.select("ticker", F.col(kind).alias("kind"), F.col(iv).alias("iv")), "iv", {"m": 0.5}, "ticker", "kind")
    both = middle.groupBy("ticker").agg(F.max(F.when(F.col("kind") == "put", F.col("m"))).alias("put_iv"), F.max(F.when(F.col("kind") == "call", F.col("m"))).alias("call_iv"))
    return volumes.join(both, "ticker", "left").withColumn("iv_skew", F.col("put_iv") - F.col("call_iv")).drop("put_iv")


def latest_change(df: DataFrame, when: str, *columns: str) -> DataFrame:
    """Latest record of each ticker, and each column's relative change from the one before."""
    w = Window.partitionBy("ticker").orderBy(F.desc(when))
    made = df.withColumns({f"{c}_rev": F.try_divide(F.col(c) - F.lead(c).over(w), F.abs(F.lead(c).over(w))) for c in columns}).withColumn("__n", F.row_number().over(w))
    return made.where("__n = 1").drop("__n")


def weighted_sentiment(df: DataFrame, s: str, c: str) -> DataFrame:
    return df.withColumn("ws", F.col(s) * F.col(c)).withColumn("cs_ws", rank_pct("ws"))
