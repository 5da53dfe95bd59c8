"""Structured Streaming forms of the panel operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from panelforge.functions.windows import clip


def bars(trades: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close, volume, VWAP and count of each symbol in tumbling windows.

    ``trades``: symbol, ts, price, size, seq.  Ties of time are ordered by seq.  The same
    plan serves a batch (the watermark is then ignored).
    """
    order = F.struct("ts", "seq")
    return trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"), F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"), F.count("*").alias("trade_count"),
    ).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "vwap", "trade_count")


def decayed_sentiment(articles: DataFrame, width: str, slide: str, half_life: float = 6.0, late: str = "1 hour") -> DataFrame:
    """Sentiment of each symbol in sliding windows, decayed to the window's end.  ``articles``: symbol, ts, score."""
    dated = articles.withWatermark("ts", late).select("symbol", "score", "ts", F.window("ts", width, slide).alias("w"))
    age = (F.unix_timestamp("w.end") - F.unix_timestamp("ts")) / 3600.0
    weight = clip(F.pow(F.lit(0.5), age / half_life), 0.01, 1.0)
    return dated.groupBy("symbol", "w").agg(F.try_divide(F.sum(F.col("score") * weight), F.sum(weight)).alias("sentiment"), F.count("*").alias("n")).select("symbol", F.col("w.end").alias("end"), "sentiment", "n")


def unseen(articles: DataFrame, late: str = "1 day") -> DataFrame:
    """Articles whose hash has not come before within the watermark.  ``articles``: hash, ts, ..."""
    return articles.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])


def score_outcomes(scores: DataFrame, outcomes: DataFrame, horizon: str, late: str = "1 day") -> DataFrame:
    """Interval join of scores with outcomes of the same ticker up to ``horizon`` later."""
    a = scores.select("ticker", F.col("ts").alias("score_ts"), "score").withWatermark("score_ts", late)
    b = outcomes.select(F.col("ticker").alias("t"), F.col("ts").alias("outcome_ts"), "outcome").withWatermark("outcome_ts", late)
    match = (F.col("ticker") == F.col("t")) & (F.col("outcome_ts") > F.col("score_ts")) & (F.col("outcome_ts") <= F.col("score_ts") + F.expr(f"interval {horizon}"))
    return a.join(b, match).drop("t")


def drawdowns(net: np.ndarray, cum: float, peak: float) -> tuple[np.ndarray, np.ndarray]:
    """Cumulated value and peak after each day, from those before the first."""
    value = cum * np.cumprod(1 + net)
    return value, np.maximum(peak, np.maximum.accumulate(value))


class _Drawdown(StatefulProcessor):
    """State of a run: cumulated value and peak of the closed days, and the days that are still open.

    A day stays open until the watermark has passed it, so days that come in another order, or late, are put in
    their place; then its timer closes all open days up to it, in order of date.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "cum double, peak double")
        self.open = handle.getListState("open", "day long, net double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            days = pdf["date"].astype("datetime64[ms]").astype("int64")
            self.open.appendList(list(zip(days.tolist(), pdf["net"].astype(float).tolist())))
            for day in days.unique():
                self.handle.registerTimer(int(day))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        days = sorted(self.open.get())
        ripe = [d for d in days if d[0] <= expiredTimerInfo.getExpiryTimeInMs()]
        if not ripe:  # an earlier timer of the same batch has closed them
            return
        cum, peak = self.closed.get() if self.closed.exists() else (1.0, 1.0)
        value, high = drawdowns(np.array([d[1] for d in ripe]), cum, peak)
        self.closed.update((float(value[-1]), float(high[-1])))
        left = days[len(ripe) :]
        self.open.put(left) if left else self.open.clear()
        dd = value / high - 1
        scale = 1 - np.clip((-0.03 - dd) / 0.03, 0.0, 1.0) * 0.5
        dates = pd.to_datetime([d[0] for d in ripe], unit="ms").date
        yield pd.DataFrame({"run": key[0], "date": dates, "dd": dd, "scale": scale})

    def close(self) -> None:
        pass


def running_drawdown(daily: DataFrame, late: str = "10 days") -> DataFrame:
    """Drawdown and exposure scale of each run by day, given out in order of date once the watermark passes a day (RocksDB state store).

    ``daily``: run, date (timestamp), net.  Days may come in any order within ``late``; later ones are dropped.
    """
    schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("date", T.DateType()), T.StructField("dd", T.DoubleType()), T.StructField("scale", T.DoubleType())])
    timed = daily.where("run is not null and date is not null and net is not null").withWatermark("date", late)
    return timed.groupBy("run").transformWithStateInPandas(_Drawdown(), schema, "Append", "EventTime")


def batch_drawdown(daily: DataFrame) -> DataFrame:
    """The same rows from a table of all days."""
    w = Window.partitionBy("run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.where("run is not null and date is not null and net is not null").withColumn("__c", F.product(1 + F.col("net")).over(w))
    dd = F.col("__c") / F.greatest(F.max("__c").over(w), F.lit(1.0)) - 1
    return rows.withColumn("dd", dd).select("run", F.col("date").cast("date").alias("date"), "dd", (1 - clip((-0.03 - F.col("dd")) / 0.03, 0.0, 1.0) * 0.5).alias("scale"))
