"""Targets, labels and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions import windows as W
from panelforge.functions.windows import EPS, lag, rank_pct, rolling
from panelforge.operators.crosssec import in_sector


def forward_return(df: DataFrame, h: int) -> DataFrame:
    """fwd: sum of the next h returns; the calendar's first h-1 rows have none."""
    w = W.by_key().rowsBetween(1, h)
    ok = (F.count("lr").over(w) == h) & (F.row_number().over(W.by_key()) >= h)
    return df.withColumn("fwd", F.when(ok, F.sum("lr").over(w)))


def rank_target(df: DataFrame, h: int) -> DataFrame:
    return forward_return(df, h).withColumn("target", rank_pct("fwd"))


def risk_target(df: DataFrame, h: int, n: int = 63) -> DataFrame:
    """Forward return over volatility (0 counts as missing and is carried forward), ranked."""
    vol = rolling(F.stddev_samp, "lr", n)
    made = forward_return(df, h).withColumn("__v", F.when(vol != 0, vol))
    carried = made.withColumn("__v", F.last("__v", ignorenulls=True).over(W.by_key().rowsBetween(Window.unboundedPreceding, 0)))
    return carried.withColumn("__t", F.col("fwd") / (F.col("__v") + EPS)).withColumn("target", rank_pct("__t")).drop("__v", "__t")


def sector_target(df: DataFrame, h: int) -> DataFrame:
    """Forward return less the sector mean (single members stay raw), ranked."""
    made = forward_return(df, h)
    rel = F.when(F.count("ticker").over(in_sector()) > 1, F.col("fwd") - F.avg("fwd").over(in_sector())).otherwise(F.col("fwd"))
    return made.withColumn("__t", rel).withColumn("target", rank_pct("__t")).drop("__t")


def triple_barrier(df: DataFrame, k: int = 10, width: float = 2.0, n: int = 63, least: int = 20) -> DataFrame:
    """label 1 / -1 for the first barrier of +-width * vol * sqrt(step) touched in the next k prices, else 0; ret: the return there.

    Rows without a price are left out.  vol: deviation of the simple returns between the n prices
    before (at least 0.005; 0.02 where there are fewer than ``least``).  The last price has 0 and 0.
    """
    own = df.where("price is not null").withColumn("__r", F.try_divide("price", lag("price")) - 1)
    before = F.count("price").over(W.by_key().rowsBetween(-n, -1))
    moved = F.stddev_samp("__r").over(W.by_key().rowsBetween(1 - n, -1))
    vol = F.when(before >= least, F.greatest(moved, F.lit(0.005))).otherwise(F.lit(0.02))
    ahead = F.collect_list("price").over(W.by_key().rowsBetween(1, k))  # k prices at most
    steps = F.transform("__a", lambda x, i: F.struct((x / F.col("price") - 1).alias("r"), (width * F.col("__vol") * F.sqrt(i + 1)).alias("b")))
    made = own.withColumn("__vol", vol).withColumn("__a", ahead).withColumn("__s", steps)
    made = made.withColumn("__h", F.get(F.filter("__s", lambda s: F.abs(s["r"]) >= s["b"]), F.lit(0))).withColumn("__e", F.try_element_at("__s", F.lit(-1)))
    ret = F.coalesce("__h.r", "__e.r", F.lit(0.0))
    return made.withColumn("label", F.coalesce(F.signum("__h.r"), F.lit(0.0)).cast("int")).withColumn("ret", ret).drop("__r", "__vol", "__a", "__s", "__h", "__e")


def meta_label(df: DataFrame, score: str) -> DataFrame:
    """1 if the score's sign is the label, else 0; a timeout is 0.5."""
    meta = F.when(F.col("label") == 0, 0.5).when(F.signum(score) == F.col("label"), 1.0).otherwise(0.0)
    return df.withColumn("meta", F.when(F.col("label").isNotNull() & F.col(score).isNotNull(), meta))


def uniqueness(df: DataFrame, days: int = 10) -> DataFrame:
    """Weight per date: 1 over (samples within +-days / number of dates), that ratio at least 0.1, mean 1 over rows."""
    by = df.groupBy("date").agg(F.count("*").alias("n")).withColumn("day", F.datediff("date", F.lit("1970-01-01")))
    near = F.sum("n").over(Window.orderBy("day").rangeBetween(-days, days))  # one row per date
    raw = by.withColumn("raw", 1 / F.greatest(near / F.count("*").over(Window.partitionBy()), F.lit(0.1)))
    mean = F.sum(F.col("raw") * F.col("n")).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    return df.join(raw.select("date", (F.col("raw") / mean).alias("weight")), "date")


def decay_weight(df: DataFrame) -> DataFrame:
    """exp(-1..0) by position in date order (dates share their first row's place), mean 1.

    The place of a date is the number of rows before it: a window over one row per date.
    """
    by = df.groupBy("date").agg(F.count("*").alias("n"))
    placed = by.withColumn("before", F.sum("n").over(Window.orderBy("date")) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    raw = placed.withColumn("raw", F.exp(F.try_divide("before", F.greatest(F.col("all") - 1, F.lit(1))) - 1))
    mean = F.sum(F.col("raw") * F.col("n")).over(Window.partitionBy()) / F.col("all")
    return df.join(raw.select("date", (F.col("raw") / mean).alias("weight")), "date")


def regime_weight(df: DataFrame, stress: str, low: float, high: float, least: float = 0.3) -> DataFrame:
    """1 up to ``low``, linear to ``least`` at ``high``; missing stress is 1."""
    x = W.clip((F.col(stress) - low) / (high - low), 0.0, 1.0)
    return df.withColumn("weight", F.coalesce(1 - x * (1 - least), F.lit(1.0)))
