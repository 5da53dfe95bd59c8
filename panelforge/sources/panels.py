"""Panels derived from the star-schema tables: weekly supplier prices and what goes with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.windows import by_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (Monday), ticker (supplier), price, volume."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("ticker")).agg(
        # Exact sums of cents: the price does not depend on the order of rows.
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("price"),
        F.sum("l_quantity").alias("volume"),
    )


def grid(df: DataFrame) -> DataFrame:
    """Every date of the table for every ticker.  The calendar has one row per date and is broadcast."""
    dates = df.select("date").distinct()
    return df.select("ticker").distinct().crossJoin(F.broadcast(dates)).join(df, ["date", "ticker"], "left")


def fill(df: DataFrame, *columns: str, limit: int = 3) -> DataFrame:
    """Carry the last value forward over at most ``limit`` missing rows of a ticker."""
    w = by_key().rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, price, volume, lr: dense, filled prices with log returns."""
    dense = fill(grid(prices(spark, sf_dir)), "price", "volume")
    return dense.withColumn("lr", F.ln(F.try_divide("price", F.lag("price").over(by_key()))))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector (region name) of each supplier: a dimension of one row per supplier."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))


def with_sector(df: DataFrame, dimension: DataFrame, default: str = "Unknown") -> DataFrame:
    """Left lookup with a default; the join is broadcast only if the optimiser finds it small."""
    return df.join(dimension, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit(default)))


def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, stress (mean discount): one row per week, without the prices."""
    return table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(F.avg("l_discount").alias("stress"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, mkt (mean price), stress (mean discount) and the mean price of each region: one row per week."""
    by_region = with_sector(panel(spark, sf_dir), sectors(spark, sf_dir)).groupBy("date")
    means = [F.avg(F.when(F.col("sector") == s, F.col("price"))).alias(c) for s, c in REGIONS.items()]
    return by_region.agg(F.avg("price").alias("mkt"), *means).join(stress(spark, sf_dir), "date").withColumn("ticker", F.lit("market"))


#: Region names and the series that stands for each.
REGIONS = {"AFRICA": "s_africa", "AMERICA": "s_america", "ASIA": "s_asia", "EUROPE": "s_europe", "MIDDLE EAST": "s_mideast"}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts of a ticker, known 45 days after the quarter's end."""
    lines = table(spark, sf_dir, "lineitem")
    quarter = F.date_trunc("quarter", "l_shipdate").cast("date")
    sums = lines.groupBy(F.col("l_suppkey").alias("ticker"), quarter.alias("start")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum("l_quantity").alias("shares"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cost"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax")
    )
    end = F.last_day(F.add_months("start", 2))
    return sums.select("ticker", end.alias("period_date"), F.date_add(end, 45).alias("filing_date"), "revenue", "shares", "cost", "tax")


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, eps_actual, eps_estimated: the estimate is the quarter before."""
    w = Window.partitionBy("ticker").orderBy("period_date")
    return facts(spark, sf_dir).select("ticker", F.col("filing_date").alias("date"), F.col("revenue").alias("eps_actual"), F.lag("revenue").over(w).alias("eps_estimated"))


def insider_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider-like records from events: purchases are acquisitions, signups disposals, the rest neither."""
    e = table(spark, sf_dir, "events")
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % n).cast("int"))
    code = F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "signup", "D").otherwise("M")
    return e.select(
        (F.col("user_id") % 50).alias("ticker"), F.to_date("ts").alias("date"), code.alias("code"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("price"), (F.col("event_id") % 97).alias("shares"),
        pick(4, "Common Stock", "Class A", "Preferred", "").alias("security"), (F.col("event_id") % 7).alias("reporter"), pick(5, "Director", "officer: CEO", "10 percent owner", "Vice President", "").alias("owner"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned insider trades."""
    from panelforge.operators.fundamentals import insider_clean

    return insider_clean(insider_records(spark, sf_dir))


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade changes from events: the JSON number, by bands, is a grade text."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    names = F.array(*[F.lit(x) for x in ("Sell", "Underperform", "Hold", "Buy", "Strong Buy", "Overweight", " market outperform", "Sector Perform", "In-Line", "Accumulate", "Reduce", "strongsell", "Top Pick", "Not Rated")])
    graded = e.select((F.col("user_id") % 50).alias("ticker"), F.col("ts"), "event_id", F.to_date("ts").alias("date"), F.get(names, F.pmod(k, F.lit(14)).cast("int")).alias("grade"))
    return graded.withColumn("previous", F.lag("grade").over(Window.partitionBy("ticker").orderBy("ts", "event_id")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: source is the symbol, one a minute from a fixed start."""
    d = table(spark, sf_dir, "documents")
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("headline"), F.col("text").alias("summary"), F.col("source").alias("symbol"), F.timestamp_seconds(start + F.col("doc_id") * 60).alias("created_at"))


def trade_calendar(df: DataFrame) -> DataFrame:
    """The table's own dates, dense for every ticker."""
    return df.select("ticker").distinct().crossJoin(F.broadcast(df.select("date").distinct()))
