"""Batch forms of the streaming operators (Z)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.plans.base import add
from panelforge.sources.panels import table
from panelforge.streaming import panel_streams as Z


def _trades(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))


add("z01_bars", "symbol start trade_count", "open high low close volume vwap", lambda s, d: Z.bars(_trades(s, d), "1 hour"),
    "SELECT user_id AS symbol, date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS trade_count, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, avg(value) AS vwap FROM events GROUP BY 1, 2")
add("z02_decayed_sentiment", "symbol until n", "sentiment", lambda s, d: Z.decayed_sentiment(table(s, d, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("score")), "2 hours", "1 hour").withColumnRenamed("end", "until"),
    "WITH e AS (SELECT event_type AS symbol, ts, value, unnest([date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 2 HOUR])::TIMESTAMP AS until FROM events), w AS (SELECT *, greatest(.01, least(1, pow(.5, (floor(epoch(until)) - floor(epoch(ts))) / 3600.0 / 6))) AS k FROM e) SELECT symbol, until, count(*) AS n, sum(value * k) / sum(k) AS sentiment FROM w GROUP BY 1, 2")


def _net(s, d):
    """Daily net results of a run: the mean event value of a type and day against the type's."""
    e = table(s, d, "events").groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    return e.withColumn("net", (F.col("v") / F.avg("v").over(Window.partitionBy("run")) - 1) * 0.1)


add("z03_running_drawdown", "run date", "dd scale", lambda s, d: Z.batch_drawdown(_net(s, d)),
    """WITH e AS (SELECT event_type AS run, ts::DATE AS date, avg(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT run, date, (v / avg(v) OVER (PARTITION BY run) - 1) * .1 AS net FROM e),
    c AS (SELECT *, product(1 + net) OVER (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM n), k AS (SELECT run, date, c / greatest(max(c) OVER (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM c)
    SELECT run, date, dd, 1 - greatest(0, least(1, (-.03 - dd) / .03)) * .5 AS scale FROM k""")  # fmt: skip
